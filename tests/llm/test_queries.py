import os

import duckdb
import pytest

import corpus_pipeline
from strandlake.llm import exact_dedup, mixing, ngram_join, queries, store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, got = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, got.select(*columns).fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs = docs.collect()
        docs = store.stash(stage(spark, docs, SF), name)
        out = docs.collect()
        assert docs.columns == columns and {r.doc_id for r in out} <= before
        if name == "toxicity":
            bad = [r for r in inputs if {"idiot", "moron", "scum"} & set(r.text.lower().split())]
            assert 0.8 * len(inputs) < len(out) < len(inputs) and sum(r in out for r in bad) <= 0.2 * len(bad)
        elif name == "exact_dedup":
            best = {}
            for r in inputs:
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert sorted(r.doc_id for r in out) == sorted(best.values())
        elif name == "ngram_jaccard":
            again = {tuple(r) for r in ngram_join.join(docs).collect()}
            assert all(n == 0 for _, _, n in again)
        else:
            copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(inputs, docs.schema)).collect() if r.copies}
            assert sorted(r.doc_id for r in out) == sorted(i for i, n in copies.items() for _ in range(n))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in out}
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_pipeline_survives_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "x y z", "en", None, 5), (None, "x y z", "de", "b", 5), (4, "w " * 30000, "en", "a", 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("class_id", store.F.lit("clash"))
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            out.collect()
    assert exact_dedup.dedup(docs).columns == docs.columns
