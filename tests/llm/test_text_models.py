import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import ngram_join, packing, store, text, topk, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "12", "é", "😀", "!", ".", " ", " ", "\0", "<|endoftext|>", "don't", "X", "中", "́", "½", "\r\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=6))
def test_encoder_equals_tokenizer(encoder, texts):
    ids, sizes = encoder.batch(texts)
    ends = np.cumsum(sizes)
    for t, e, n in zip(texts, ends, sizes, strict=True):
        assert ids[e - n : e].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(packing, "POOL", 50)
    small = packing.Encoder(PATH)
    for k in range(30):
        t = f"word{k} and more {k * k} words"
        assert small.batch([t, "", t])[0].tolist() == small.whole(t).tolist() * 2


DOCS = [(1, "a b c " * 900), (2, None), (3, ""), (None, "some text"), (4, "rep"), (4, "rep"), (5, "long " * 9000), *[(100 + k, f"word{k} " * (k % 90 * 7)) for k in range(200)]]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], "doc_id long, text string, lang string, start long, offset long")
    return df.repartition(parts)


def test_packing_covers_every_id_once(spark, encoder):
    got = packing.pack(frame(spark, DOCS), PATH, window=256).collect()
    ids = {}
    for i, t in DOCS:
        ids.setdefault(i, [*encoder.whole(t or "").tolist(), 1])
    seqs, starts = {}, {}
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(np.array(own[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        starts.setdefault(r.doc_id, []).append((r.start, r.length))
    for own in seqs.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 256
    for i, own in starts.items():
        copies = sum(1 for x, _ in DOCS if x == i)
        assert sorted(own)[::copies] == sorted(set(own)) and sum(n for _, n in own) == copies * len(ids[i])
    assert sum(r.length for r in got) > 0.97 * 256 * len(seqs)
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_window_count_rises():
    parts, count = packing.windows(np.array([6, 6, 6]), 10)
    assert count == 3 and sorted(parts.tolist()) == [0, 1, 2]


def brute_links(rows, n=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, least[find(k)] if i is not None else None, links[k]) for k, (i, _) in enumerate(rows)), key=str)


def near_rows(seed, groups, size, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.randrange(1, size)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((len(rows) + 10, " ".join(own)))
    rng.shuffle(rows)
    return rows


ODD = [(1, "one two"), (2, "one two"), (3, "one  two "), (4, None), (5, ""), (6, " \n"), (None, "one two"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "x " * 30000)]


@pytest.mark.parametrize("rows", [ODD + near_rows(1, 30, 8), near_rows(2, 1, 400), near_rows(3, 3, 200, words=25)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 16)  # many pairs of blocks
    monkeypatch.setattr(store, "HEAVY", 4)  # few heavy keys
    got = ngram_join.join(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_links(rows)
    kept = {r.doc_id for r in ngram_join.keep_one(frame(spark, rows)).collect()}
    assert kept == {i for i, c, _ in brute_links(rows) if i == c and i is not None} | ({None} if any(i is None for i, _ in rows) else set())


def test_ngram_join_ships_full_sets_once(spark, monkeypatch):
    written, stash = {}, ngram_join.stash
    monkeypatch.setattr(ngram_join, "stash", lambda df, name: written.setdefault(name, stash(df, name)))
    monkeypatch.setattr(ngram_join, "may_hold", lambda rows, *_: rows)  # a filter that lets all pass
    monkeypatch.setattr(ngram_join, "release", lambda *_: None)
    monkeypatch.setattr(ngram_join, "HELD_CHARACTERS", 2000)
    rows = ODD + near_rows(4, 30, 8)
    assert sorted((tuple(r) for r in ngram_join.join(frame(spark, rows)).collect()), key=str) == brute_links(rows)
    assert written["members"].count() > 0 and written["sets"].count() == 0  # those of small buckets are not written or joined before


def test_ngram_join_of_nothing(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0 and ngram_join.join(frame(spark, [(1, "a b c d e f")])).collect()[0].n_links == 0


def test_banding_meets_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.bands_for(threshold, 0.9999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.HASHES
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.01, 0.999999)


def brute_top(rows, asked, k):
    """``rows``: (id, vector), each a vector of its own."""
    out = []
    for q, (i, v) in enumerate(rows):
        if asked(i):
            scores = sorted((-int(np.dot(v, x)), j) for c, (j, x) in enumerate(rows) if c != q)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,scale", [(8192, 1024), (3, 1024), (8192, 10**8)])
def test_topk_equals_brute_force(spark, monkeypatch, block, scale):
    for name in ("QUERY_BLOCK", "CHUNK"):
        monkeypatch.setattr(topk, name, block)
    monkeypatch.setattr(topk, "SEEDS", 20)
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 12)) * rng.exponential(size=(300, 1))
    m[5:20] = m[5]  # ties
    rows = [(int(i), x.tolist()) for i, x in enumerate(m)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (None, [9.0] * 12), (410, [3.0, 2.0])]
    rows += [(7, m[7].tolist()), (7, m[40].tolist()), (20, m[20].tolist()), (20, m[41].tolist())]  # ids that repeat
    df = spark.createDataFrame([(i, v, 0, 1, "p", 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int, part string, length double").repartition(4)
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 10 == 0, 7, scale=scale).collect()))
    quant = [(i, np.array([int(np.floor(scale * x)) for x in v] + [0] * (12 - len(v)), dtype=object)) for i, v in rows if i is not None and i not in (400, 401, 402, 403)]
    assert got == brute_top(quant, lambda i: i % 10 == 0, 7)


def test_topk_plan_does_not_grow_with_the_queries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(200, 4)))], "vec_id long, embedding array<double>")
    size = lambda: len(topk.search(df, F.col("vec_id") % 2 == 0)._jdf.queryExecution().executedPlan().toString().splitlines())
    few = size()
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    assert size() == few


def test_topk_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.search(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 10 == 0).count() == 0
    few = topk.search(spark.createDataFrame([(0, [0.0]), (1, [0.0]), (3, [])], schema), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, few.collect())) == [(0, 1, 1, 0), (0, 2, 3, 0)]


BAD = ["idiot", "stupid", "moron", "worthless"]


def corpus(n=400, seed=9):
    rng = random.Random(seed)
    good = ["".join(rng.choice(["ha", "re", "on", "ti", "es", "an", "st"]) for _ in range(rng.randrange(1, 5))) for _ in range(500)]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(good) for _ in range(rng.randrange(5, 120))]
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    return toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), usable=~toxicity.held_out("_id"))


def test_held_out_accuracy_and_deobfuscation(spark, model):
    rows, labels = corpus()
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows), model).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == y for i, y in held]) > 0.95
    clean = "hareon tistan esha reti onhare tian sthare onti hare reon"
    hidden = ["1d10t 5tup1d m0r0n", "i.d.i.o.t s-t-u-p-i-d", "i d i o t! and s t u p i d and m o r o n", "idiiiiot stuuuupid moooron", "$tup!d !d!ot w0rthle$$", "1 d 1 0 t and 5 t u p 1 d"]
    scores = model.score([clean, *[f"{clean} {h} {clean}" for h in hidden]])
    assert scores[0] < 0.5 and (scores[1:] > 0.5).all(), scores


def test_decoding(model):
    for token, word in [("1d10t", "idiot"), ("5tup1d", "stupid"), ("m.o.r.o.n", "moron"), ("mooooron", "moron"), ("hareon", "hareon")]:
        assert toxicity.decode(token, model.costs) == word
    assert toxicity.decode("idiotmoron", model.costs, spaced=True) == "idiot moron"


def test_words_joined_by_marks(model):
    for mark in "-/,:!|":
        assert toxicity.decode(f"hareon{mark}1d10t", model.costs) == "hareon idiot"
        assert toxicity.decode(f"5tup1d{mark}m0r0n", model.costs) == "stupid moron"
    clean = "hareon tistan esha reti onhare tian sthare onti hare reon"
    joined = ["reon-1d10t/m0r0n", "hare,5tup1d,1d10t", "m0r0n:1d10t", "hare/w0rthl355/5tup1d"]
    scores = model.score([f"{clean} {j} {clean}" for j in joined])
    assert (scores > 0.5).all(), scores


def test_other_letters_use_all_symbols():
    symbol = toxicity._tables()["symbol"]
    other = [ord(c) for c in "áàâäãåçéèêëíìîïñóòôöõúùûüßαβγδежз"]
    assert len(set(symbol[other].tolist())) >= 15 and set(symbol[0x400:0x500].tolist()) == set(range(27, toxicity.SYMBOLS)) | {0}


def test_tokens_of_any_length_and_full_leet(model):
    hidden = {
        "y.o.u.s.t.u.p.i.d.w.o.r.t.h.l.e.s.s": "youstupid", "id" + "i" * 40 + "ot": "idiot", "hareontistanesharetionharetian/5tup1d": "stupid", "i " * 3 + "d i o t": "idiot",
        "1d107": "idiot", "#1d107!!!": "idiot", "57up1d2024": "stupid", "h473": "hate", "1 d 1 0 7": "idiot", "5 7 u p 1 d!": "stupid",
    }
    for token, word in hidden.items():
        assert word in model_words(model, token), token
    clean = "hareon tistan esha reti onhare tian sthare onti hare reon"
    scores = model.score([f"{clean} {h} {h} {clean}" for h in ("1d107", "57up1d2024", "1 d 1 0 7 and", "#1d107!!!")])
    assert (scores > 0.5).all(), scores
    whole = toxicity.decode("m.0" * 20_000, model.costs.tolist())
    assert whole.replace(" ", "") == "mo" * 20_000


def model_words(model, token):
    codes, kind, _ = toxicity._lowered([token])
    _, a, b, spelled = toxicity.obfuscated(codes, kind)
    costs = model.costs.tolist()
    spans = ["".join(map(chr, codes[p:q])) for p, q in zip(a, b, strict=True)]
    return [w for s in spans for r in toxicity.readings(s, costs) for w in r.split()] + [w for _, s in spelled for w in toxicity.decode(s, costs, True).split()]


def brute_decode(token, costs, spaced=False):
    """All likeliest readings of a token, by trying every choice at every character: letters that it may stand for, repetitions
    dropped, marks dropped or taken as word ends, and, where letters are spaced, word ends between any two."""
    sym = toxicity._tables()["symbol"]
    found = []

    def walk(i, out, cost, a, b):
        if i == len(token):
            found.append((cost + (float(costs[a, b, 0]) if b else 0.0), out.strip()))
            return
        c = token[i]
        options = [(x, toxicity.LOOK) for x in toxicity.LOOKS.get(c, "")] or ([(c, 0.0)] if c.isalpha() else [])
        tripled = any(token[k : k + 3] == c * 3 for k in (i - 2, i - 1) if k >= 0) or (i > 0 and token[i - 1 : i + 2] == c * 3)
        for x, extra in options:
            s = int(sym[ord(x)])
            walk(i + 1, out + x, cost + extra + float(costs[a, b, s]), b, s)
            if out.endswith(x):
                walk(i + 1, out, cost + extra + (toxicity.REPEAT if tripled else toxicity.DOUBLE), a, b)
            if spaced and b:
                walk(i + 1, out + " " + x, cost + extra + toxicity.BREAK + float(costs[a, b, 0]) + float(costs[0, 0, s]), 0, s)
        drop = toxicity.DROP if c in toxicity.SEPARATORS else toxicity.STRAY
        if not options:
            walk(i + 1, out, cost + drop, a, b)
        if (not options or c in toxicity.MARKS) and (b or options):
            walk(i + 1, out + " " if b else out, cost + drop + (float(costs[a, b, 0]) if b else 0.0), 0, 0)

    walk(0, "", 0.0, 0, 0)
    return {out for cost, out in found if cost < min(found)[0] + 1e-5}


@settings(max_examples=60, deadline=None)
@given(st.text("abt1$6hs", min_size=1, max_size=6))
def test_viterbi_equals_enumeration(model, token):
    assert toxicity.decode(token, model.costs) in brute_decode(token, model.costs)


@settings(max_examples=80, deadline=None)
@given(st.text("ado1.-!#", min_size=1, max_size=6), st.booleans())
def test_viterbi_equals_enumeration_with_marks_and_spaces(model, token, spaced):
    assert toxicity.decode(token, model.costs, spaced) in brute_decode(token, model.costs, spaced)


def test_long_disguises_score_as_toxic(model):
    clean = "hareon tistan esha reti onhare tian sthare onti hare reon"
    hidden = ["idi" + "o" * 30 + "t", "i.d.i.o.t." * 5, "s.t.u.p.i.d.m.o.r.o.n.i.d.i.o.t", "s.t.u.p.i.d." * 40, "m" + "o" * 500 + "ron"]
    scores = model.score([f"{clean} {h} {h} {clean}" for h in hidden])
    assert (scores > 0.5).all(), scores


def plain_features(words):
    """(text, whether a beginning) of each word and its beginnings, counted."""
    return Counter([(w, False) for w in words] + [(w[:n], True) for w in words for n in toxicity.BEGINNINGS if len(w) > n])


def test_scores_equal_a_plain_version(model):
    """Clear words and restored ones, counted one by one; hashes only name the features."""
    def hashed(x, beginning):
        codes = np.array([ord(c) for c in x], dtype=np.uint32)
        h = text.Hasher().slices(codes, np.array([0]), np.array([len(codes)]))[0]
        return int(h ^ np.uint64(0x5851F42D4C957F2D)) if beginning else int(h)

    places = {int(h): k for k, h in enumerate(model.features)}
    cases = ["you idiot", "a 5tup1d m0r0n, hare reon", "reon 1d10t reon 1d10t tian", "", "hare reon tian", "w0rthl355"]
    got = model.score(cases)
    for t, score in zip(cases, got, strict=True):
        own = [w for w in "".join(c if c.isalpha() else " " for c in t).split()]
        counts = plain_features(own)
        for token in t.replace(",", " ").split():
            if any(c.isalpha() for c in token) and any(c in toxicity.LOOKS for c in token):
                clear = plain_features("".join(c if c.isalpha() else " " for c in token).split())
                restored = Counter()
                for reading in toxicity.readings(token, model.costs.tolist()):
                    restored |= plain_features(reading.split())
                counts += restored - clear
        x = np.zeros(len(model.features) + 2)
        for (f, beginning), n in counts.items():
            k = places.get(hashed(f, beginning))
            if k is not None:
                x[k] = max(0.0, np.log(n / (len(own) * model.rates[k] + 0.3)))
        x[-2:] = np.log1p(len(own)) / 5, 1.0
        assert abs(1 / (1 + np.exp(-x @ model.weights)) - score) < 1e-9, t


def test_toxicity_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "idiot moron stupid"), (3, "x " * 40000), (3, "x " * 40000), (4, "\0 1 2 3 \U0001d7d9")]
    got = toxicity.score(frame(spark, rows), model, name="tox").collect()
    assert len(got) == len(rows) and all(0 <= r.tox <= 1 for r in got)
    assert toxicity.score(frame(spark, []), model).count() == 0
    clash = frame(spark, rows).withColumn("SCORE", F.lit("theirs")).withColumn("a.b", F.lit("dot"))
    again = toxicity.score(clash, model)
    assert again.columns == [*frame(spark, rows).columns, "a.b", "score"] and sorted(r.score for r in again.collect()) == sorted(r.tox for r in got)
    schema = "doc_id long, quality int, toxic int"
    none = toxicity.fit(frame(spark, rows), spark.createDataFrame([], schema))
    assert none.score(["idiot"])[0] < 1e-9
    one = toxicity.fit(frame(spark, rows), spark.createDataFrame([(1, 1, 1), (None, 1, 0), (2, 0, None)], schema))
    assert one.score(["idiot"])[0] == 1
    empty = toxicity.fit(frame(spark, []), spark.createDataFrame([(1, 1, 1), (2, 1, 0)], schema))
    assert 0 <= empty.score(["idiot"])[0] <= 1


def test_hashes_tell_slices_apart():
    codes, firsts = text.code_points(["ab ba", "ab", "a\0b"])
    h = text.Hasher().slices(codes, firsts, firsts + 2)
    assert h[0] == h[1] != h[2]
