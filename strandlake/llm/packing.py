"""Packing documents into fixed windows by Karmarkar-Karp differencing.

Each task encodes its documents, cuts every window's worth of ids off the front of a document as a window of its own,
and cuts what remains into pieces of a quarter window at most. As soon as enough pieces have gathered they are
differenced over ceil(ids / window) windows; while a window exceeds the capacity, the count rises by one. Windows of
differencing are near equal, so nearly full. Nothing shuffles, a task holds a bounded number of pieces and one batch of
texts, and what a lost task did is done again from its own input alone; it meets no other task's windows.

Ids: those of the tokenizer file for the text, then the end id. The encoder splits a batch of texts at the tokenizer's
own piece boundaries with array operations and has the tokenizer encode each distinct piece once.

Defined cases: a null or empty text is one end id; a very long one is encoded whole and fills windows of its own. Rows
equal in id and text are packed each for itself; pieces of equal size go in the order they came. An empty table gives an
empty result. Texts holding a special token's string are encoded whole by the tokenizer. Columns of the input may have
any names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.differencing import difference
from strandlake.llm.store import bounded_batches
from strandlake.llm.text import Hasher, bpe_pieces, chunks, code_points, give_back

#: Pieces differenced at a time.
GROUP_PIECES = 8192
#: Slots of an encoder's piece table, and ids that it keeps before starting anew.
SLOT_BITS = 21
SLOTS, POOL = 1 << SLOT_BITS, 3_000_000


class Encoder:
    """Byte-level BPE over batches, by a direct-mapped table from a piece's hash to its ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hasher = Hasher()
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(SLOTS, dtype=np.uint64)
        self.at = np.zeros(SLOTS, dtype=np.int64)
        self.length = np.zeros(SLOTS, dtype=np.int32)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.used += len(flat)
        return at, sizes

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if any("\0" in t or s in t for t in texts for s in self.special):
            found = [self.whole(t) for t in texts]
            return np.concatenate(found), np.array([len(x) for x in found])
        if self.used > POOL:
            self._reset()
        codes, firsts = code_points(texts)
        starts, ends = bpe_pieces(codes)
        keys = self.hasher.slices(codes, starts, ends)
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, length = self.at[slot], self.length[slot]
        missed = np.flatnonzero(self.keys[slot] != keys)
        if len(missed):
            new, where, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            own = missed[where]
            text = codes.tobytes()
            new_at, new_length = self._learn([text[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            at[missed], length[missed] = new_at[back], new_length[back]
            put = (new >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.keys[put], self.at[put], self.length[put] = new, new_at, new_length
        ends_at = np.cumsum(length, dtype=np.int64)
        total = int(ends_at[-1]) if len(ends_at) else 0
        ids = self.pool[np.repeat(at - ends_at + length, length) + np.arange(total)]
        bounds = np.concatenate(([0], ends_at))[np.searchsorted(starts, np.append(firsts, len(codes)))]
        return ids, np.diff(bounds)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own: its table is kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece, and how many there are: differencing over ever more windows until all fit."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        parts = difference(sizes, count)
        if np.bincount(parts, weights=sizes, minlength=count).max() <= capacity:
            return parts, count
        count += 1


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``tokenizer``: a file's path."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    piece = max(1, window // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get()
        serial = (task.partitionId() if task else 0) << 40
        out: list[tuple] = []
        loose: list[tuple] = []

        def level(rows: list[tuple]) -> None:
            nonlocal serial
            if not rows:
                return
            parts, count = windows(np.array([r[2] for r in rows]), window)
            filled = [0] * count
            for r, p in zip(rows, parts.tolist(), strict=True):
                out.append((*r, serial + p, filled[p]))
                filled[p] += r[2]
            serial += count

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=[doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
                out.clear()

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            names, column = batch.column(0), batch.column(1)
            for low in range(0, len(batch), 256):  # few texts at a time become Python strings
                texts = column.slice(low, 256).to_pylist()
                owners = names.slice(low, 256).to_pylist()
                for a, b in chunks(texts):
                    ids, sizes = encode.batch(texts[a:b])
                    ends = np.cumsum(sizes + 1)
                    full = np.full(int(ends[-1]), end_id, dtype="<u4")
                    keep = np.ones(len(full), dtype=bool)
                    keep[ends - 1] = False
                    full[keep] = ids
                    view = memoryview(full).cast("B")
                    for owner, last, size in zip(owners[a:b], ends.tolist(), (sizes + 1).tolist(), strict=True):
                        first, start = last - size, 0
                        while start < size:
                            n = window if size - start >= window else min(piece, size - start)
                            row = (owner, start, n, zlib.crc32(view[4 * (first + start) : 4 * (first + start + n)]), size)
                            if n == window:
                                out.append((*row, serial, 0))
                                serial += 1
                            else:
                                loose.append(row)
                            start += n
                    while len(loose) >= GROUP_PIECES:
                        level(loose[:GROUP_PIECES])
                        del loose[:GROUP_PIECES]
            yield from flush()
        level(loose)
        yield from flush()
        give_back()

    return docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, f"`{doc_id}` {kind}, {PIECE}")
