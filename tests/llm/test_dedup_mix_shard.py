import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import exact_dedup, mixing, ngram_join, sharding, store
from strandlake.llm.differencing import difference

#: Names that the operators use themselves, planted as columns of the input with a value of their own each.
INNER = """_key _possible _block _bits _bit1 _salt _file _at _f _chunk _marks _lost _best _n _id _sid _u _z _size _p rate target source_size weight whole need
copies taken _cut _part _times _copy _copies _metadata _row row key n shard slot bucket base _set _links _text _rep _busy class_id""".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, " + ", ".join(f"`{c}` string" for c in [*INNER, "a.b"])


def planted(i):
    return [f"{c} of {i}" for c in [*INNER, "a.b"]]


def frame(spark, rows):
    """Documents (id, text, source) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 99, *planted(i)) for i, t, s in rows], DOCS)


def intact(rows):
    """Every planted value is still beside the id it was given to."""
    return all(list(r)[6:] == planted(r.doc_id) and r["size"] == 99 for r in rows)


ODD = [(1, "a b", "s1"), (2, "a b", "s2"), (3, None, "s1"), (4, "", None), (None, "a b", "s1"), (5, "c", "s1"), (5, "c", "s1"), (6, "w " * 5000, "s2"), (7, " \t\n", "")]


def expected_classes(rows):
    groups = defaultdict(list)
    for k, (i, t, _) in enumerate(rows):
        groups[t or ""].append((i is not None, i or 0, k))
    out = Counter()
    for t, members in groups.items():
        best = max(members)
        for j, m in enumerate(sorted(members)):
            out[(m[1] if m[0] else None, best[1] if best[0] else None, len(members), j == len(members) - 1, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("rows", [ODD, [], [(k, f"t{k % 7}" if k % 3 else f"u{k}", "s") for k in range(600)], [(k, "same", "s") for k in range(500)]])
def test_exact_dedup(spark, rows):
    got = exact_dedup.classes(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == expected_classes(rows)
    kept = exact_dedup.dedup(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t, _ in rows})
    assert intact(kept.collect())
    best = {t: i for i, _, _, last, t in expected_classes(rows) if last}
    assert all(best[hashlib.sha256((r.text or "").encode()).hexdigest()] == r.doc_id for r in kept.collect())


def test_unique_rows_do_not_shuffle(spark):
    docs = frame(spark, [(k, f"text {k % 900}", "s") for k in range(1000)])
    keys = store.stash(docs.select(exact_dedup.text_key().alias("_key"), "doc_id"))
    bloom, blocks = exact_dedup.repeated_filter(keys, "_key", keys.count())
    marked = exact_dedup.mark_possible(keys, "_key", bloom, blocks)
    possible = {r.doc_id for r in marked.filter("_possible").collect()}
    repeated = {k for k in range(1000) if k % 900 < 100}
    assert repeated <= possible and len(possible - repeated) < 60


def test_filter_joined_instead_of_broadcast(spark, monkeypatch):
    rows = [(k, f"t{k % 50}", "s") for k in range(80)]
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    assert Counter(map(tuple, exact_dedup.classes(frame(spark, rows)).collect())) == expected_classes(rows)


def exchanges(df):
    """What each exchange of a plan carries."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_texts_do_not_shuffle_whatever_the_bound(spark, tmp_path, monkeypatch):
    rows = [(k, f"some text {k % 50} of a number of words", f"s{k % 3}") for k in range(80)]
    path = str(tmp_path / "docs")
    frame(spark, rows).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    for module in (exact_dedup, store):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    for out, expect in ((exact_dedup.dedup(docs), 50), (ngram_join.keep_one(docs), 50), (mixing.mixed(docs), None)):
        carried = exchanges(out)
        assert all("BroadcastExchange" in x for x in carried), carried
        got = out.collect()
        assert intact(got) and (expect is None or len(got) == expect)


def test_pass_one_shuffles_as_many_rows_whatever_the_documents(spark):
    seen = []
    for n in (5_000, 50_000):
        keys = spark.range(0, n, 1, 4).select(F.unhex(F.sha2((F.col("id") % (n - n // 3)).cast("string"), 256)).alias("_key"))
        packed, _ = exact_dedup.packed_positions(keys, "_key", 50_000)
        seen.append(packed.count())
    assert max(seen) <= 4 * exact_dedup.GROUPS
    one = spark.range(0, 1000, 1, 4).select(F.unhex(F.sha2(F.lit("x"), 256)).alias("_key"))  # one key: no more than twice from a task
    packed, _ = exact_dedup.packed_positions(one, "_key", 1000)
    assert [r["size(_cells)"] for r in packed.select(F.size("_cells")).collect()] == [2] * 4


def test_rows_keep_their_place_in_any_scan(spark, tmp_path):
    df = spark.range(0, 70_000, 1, 3).select("id", F.lit("x").alias("_file"))
    df.write.parquet(str(tmp_path / "p"))
    for source in (spark.read.parquet(str(tmp_path / "p")).filter("id >= 10"), df.filter("id >= 10").unionAll(df.limit(0))):
        wide, file, at = store.addressed(source)
        assert (file, at) == ("__file", "_at") and wide.select(file, at).distinct().count() == 69_990
        bits = store.marks(wide, file, at, F.col("id") % 3 == 0, F.col("id") % 6 == 0)
        got = store.marked(wide, file, at, bits, 69_990, 2, "times")
        assert got.filter((F.col("id") % 3 == 0).cast("int") + (F.col("id") % 6 == 0).cast("int") != F.col("times")).count() == 0


def test_heavy_keys_meet_their_summary(spark, monkeypatch):
    monkeypatch.setattr(store, "HEAVY", 5)
    rows = spark.createDataFrame([("a" if k < 60 else None if k < 70 else f"k{k}", k) for k in range(100)], "k string, v long")
    summary = spark.createDataFrame([("a", 60, "x"), ("k80", 1, "y"), ("other", 1, "z")], "k string, n long, s string")
    got = {r.v: r.s for r in store.with_summary(rows, ["k"], summary, "n", 100).collect()}
    both = store.with_summary(rows, ["k"], summary, "n", 100, inner=True).collect()
    assert got == {k: "x" if k < 60 else "y" if k == 80 else None for k in range(100)}
    assert sorted(r.v for r in both) == [*range(60), 80]


def water(sizes, weights, total, most):
    left = dict(sizes)
    target, open_ = {}, set(sizes)
    while open_:
        share = total / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * share >= most * left[s]}
        if not full:
            target |= {s: weights[s] * share for s in open_}
            break
        for s in full:
            target[s] = most * left[s]
            total -= target[s]
        open_ -= full
    return target


def test_mixing_targets_and_takes(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "B", "ä", None, "big", "big", "big", ""])) for k in range(900)]
    got = mixing.mix(frame(spark, rows), cut_last=True).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    expect = water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - expect[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expect[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows).repartition(5), cut_last=True).collect()))


def brute_rank(rows, need, seed=0):
    """(rank, size, id, p) of a source's documents by the definition: p by size, its rate found by bisection."""
    sizes = [len(t.split()) for _, t in rows]
    low, high = 0.0, 1.0
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(n * min(1.0, rate * n) for n in sizes) < need else (low, rate)
    out = []
    for (i, _), n in zip(rows, sizes, strict=True):
        u = (int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = min(1.0, high * n)
        odds = 0.0 if p == 1.0 else (u / (1 - u)) / (p / (1 - p))
        out.append((odds, n, i, p))
    return sorted(out)


def test_mixing_is_a_pareto_sample(spark):
    """Certain copies for all; beyond them the prefix of odds over inclusion odds that is as near to the target as one can be."""
    rng = random.Random(5)
    rows = [(k, "w " * int(rng.paretovariate(1.2) * 5), "ab"[k % 2]) for k in range(400)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    for s in "ab":
        own = {r.doc_id: r for r in got if r.source == s}
        first = next(iter(own.values()))
        whole = int(first.target / first.source_size + 1e-12)
        need = first.target - whole * first.source_size
        ranked = brute_rank([(i, t) for i, t, x in rows if x == s], need)
        assert abs(sum(n * p for _, n, _, p in ranked) - need) < 1e-6
        assert all(abs(own[i].chance - p) < 1e-9 for _, _, i, p in ranked) and (need == 0 or len({round(p, 9) for _, _, _, p in ranked}) > 5)
        run, best = 0, 0
        for k, (_, n, _, _) in enumerate(ranked, 1):
            if abs(run + n - need) <= abs(run - need):
                best = k
            run += n
        assert {i for i, r in own.items() if r.copies > whole} == {i for _, _, i, _ in ranked[:best]}
        assert all(r.copies in (whole, whole + 1) for r in own.values())
    out = mixing.mixed(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter({r.doc_id: r.copies for r in got if r.copies}) and intact(out)


def test_documents_are_taken_as_often_as_their_inclusion_probability(spark):
    """600 sources of the same sizes, other ids: 600 draws of one sample."""
    sizes = [1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 24] * 4
    rows = [(rep * 1000 + k, "w " * n, f"s{rep}") for rep in range(600) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1.0,), share=0.3).collect()
    taken, chance = Counter(), {}
    for r in got:
        taken[r["size"]] += r.copies
        chance[r["size"]] = r.chance
    for n, p in chance.items():
        assert abs(taken[n] / (600 * 4) - p) < 0.05, (n, taken[n] / 2400, p)
    assert chance[24] > 4 * chance[5]


def test_mixing_with_many_sources_and_seeds(spark, monkeypatch):
    rows = [(k, "w " * (k % 17), f"s{k % 40}") for k in range(400)]
    plain = sorted(map(str, mixing.mix(frame(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(frame(spark, rows)).collect())) == plain
    assert sorted(map(str, mixing.mix(frame(spark, rows), seed=1).collect())) != plain


def test_mixing_odd_rows(spark):
    got = mixing.mix(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and mixing.mix(frame(spark, [])).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(frame(spark, [(1, None, "a"), (2, "", "b")])).collect())
    out = mixing.mixed(frame(spark, ODD))
    assert out.columns == frame(spark, ODD).columns and intact(out.collect())


def plain_kk(sizes, ways):
    heap = [sorted([s] + [0] * (ways - 1)) for s in sizes]
    while len(heap) > 1:
        heap.sort(key=lambda v: v[-1] - v[0])
        a, b = heap.pop(), heap.pop()
        heap.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    return heap[0][-1] - heap[0][0] if heap else 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(1, 1000), min_size=1, max_size=40, unique=True), st.integers(2, 7))
def test_differencing_equals_plain(sizes, ways):
    sums = np.bincount(difference(np.array(sizes), ways), weights=sizes, minlength=ways)
    assert len(sums) == ways and abs(np.ptp(sums) - plain_kk(sizes, ways)) < 1e-6


def test_anchor_fixes_the_order():
    parts = difference(np.array([5.0, 3.0, 2.0, 1.0]), 3, np.array([10.0, 0.0, 4.0]))
    sums = np.bincount(parts, weights=[5, 3, 2, 1], minlength=3) + np.array([10, 0, 4])
    assert sums.max() == 10 and difference(np.zeros(0), 3).size == 0 and set(difference(np.array([3.0, 2.0]), 1)) == {0}


def check_shards(got, rows, shards):
    by_text = defaultdict(set)
    slots = defaultdict(list)
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append((t or "").encode())
    for r in got:
        slots[r.shard].append(r.slot)
        assert any(zlib.crc32(t) == r.text_crc32 and len(t) + 8 == r["size"] for t in texts[r.doc_id])
        by_text[r.text_crc32].add(r.shard)
    assert len(got) == len(rows) and all(0 <= s < shards for s in slots)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in by_text.values())


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randrange(1, 3000), "s") for k in range(500)] + [(1000 + k, "copied text", "s") for k in range(300)]
    got = sharding.place(frame(spark, rows), 6).collect()
    check_shards(got, rows, 6)
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.001 * sum(sums.values())


def test_sharding_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 32)
    monkeypatch.setattr(sharding, "CLASS_RATIO", 8)
    rng = random.Random(2)
    rows = [(k, f"{k}" + "y" * int(rng.paretovariate(1.1) * 20), "s") for k in range(400)]
    got = sharding.place(frame(spark, rows), 4).collect()
    check_shards(got, rows, 4)
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.02 * sum(sums.values())


def test_sharding_odd_rows(spark):
    check_shards(sharding.place(frame(spark, ODD), 3).collect(), ODD, 3)
    assert sharding.place(frame(spark, []), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.place(frame(spark, ODD), 0)


def test_ordinals_and_lookup(spark):
    df = spark.createDataFrame([(x,) for x in "dbca"], "x string").repartition(3)
    assert sorted(map(tuple, store.ordinals(df, F.col("x").asc(), "n").collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").withColumn("s", store.row_salt("id"))
    got = store.group_lookup(rows, ["k"], "s", F.count("*").alias("n")).groupBy("k").agg(F.count("*"), F.max("n")).collect()
    assert sorted(map(tuple, got)) == [(0, 334, 334), (1, 333, 333), (2, 333, 333)]
