"""Options of the session and of each plan, with types and defaults, and a command line made from them."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, dataclass, field, fields
from typing import Any, TypeVar, get_type_hints

from pyspark.sql import SparkSession

T = TypeVar("T")


@dataclass
class SessionOptions:
    """Where and how wide a job runs. An empty master leaves it to spark-submit."""

    master: str = ""
    app_name: str = "strandlake"
    num_workers: int = 3
    shuffle_partitions: int = 0
    experiments: list[str] = field(default_factory=list)  # key=value settings

    def session(self) -> SparkSession:
        builder = SparkSession.builder.appName(self.app_name).config("spark.sql.session.timeZone", "UTC")
        if self.master:
            if not self.master.startswith(("local", "spark://", "yarn", "k8s://")):
                raise ValueError(f"unknown master {self.master!r}")
            builder = builder.master(self.master)
        if self.shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(self.shuffle_partitions))
        for setting in self.experiments:
            key, _, value = setting.partition("=")
            builder = builder.config(key, value)
        return builder.config("spark.executor.instances", str(self.num_workers)).getOrCreate()


@dataclass
class JoinOptions:
    contigs: str = ""
    reads: str = ""
    mappings: str = ""
    output: str = ""
    min_contig_length: int = 0
    format: str = "parquet"  # of the records: parquet or avro


@dataclass
class AlignmentOptions:
    alignments: str = ""
    output_table: str = ""
    format: str = "parquet"


@dataclass
class CompareOptions:
    full_alignments: str = ""
    short_alignments: str = ""
    output_table: str = ""
    format: str = "parquet"


@dataclass
class GraphOptions:
    contigs: str = ""
    output: str = ""
    k: int = 0
    format: str = "parquet"  # of the records: parquet or avro


@dataclass
class ExportOptions:
    contigs: str = ""
    output_table: str = ""
    chunked: bool = True
    format: str = "parquet"  # of the records: parquet or avro


@dataclass
class SimulationOptions:
    sequences: str = ""
    output: str = ""
    fold_coverage: int = 10
    read_length: int = 100
    error_free: bool = True
    tool: str = ""  # path of an external simulator; empty: the built-in error-free one


def parse(kind: type[T], argv: list[str]) -> T:
    """An options object from ``--name value`` arguments; an unknown name or a wrong type is an error."""
    parser, hints = argparse.ArgumentParser(kind.__name__), get_type_hints(kind)
    for f in fields(kind):  # type: ignore[arg-type]
        default: Any = f.default if f.default is not MISSING else f.default_factory()  # type: ignore[misc]
        if hints[f.name] is bool:
            parser.add_argument(f"--{f.name}", type=lambda x: x.lower() in ("1", "true", "yes"), default=default)
        elif isinstance(default, list):
            parser.add_argument(f"--{f.name}", type=lambda x: [y for y in x.split(",") if y], default=default)
        else:
            parser.add_argument(f"--{f.name}", type=hints[f.name], default=default)
    return kind(**vars(parser.parse_args(argv)))
