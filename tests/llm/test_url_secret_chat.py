import hashlib
import random
import re

import duckdb
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import chat_format, components, queries, secret_scan, url_filter

RULES = queries.URL_RULES
PAGES = "page_id long, url string, html string, rule string, host string, component string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)


def link(to):
    return f'<html><link href="{to}" rel="canonical"><p>text</p></html>'


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "https://Blog.EXAMPLE.com/en/71?x=http://a.b/#t", ""), (2, "http://example.com/en/8", None), (3, "http://a.org/es/", ""), (4, "http://xorg/es/", ""),
        (5, "no scheme", ""), (6, None, None), (7, "http://example.net/de/8/x", ""), (8, "http://a.net/de/8", ""), (9, "ftp://net?x=/de/", ""), (10, "http://É.com/en/", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages(spark, rows), RULES).collect()}
    assert got[1] == ("blog.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[2] == ("example.com", "/en/8", "com/en/", "block")
    assert got[3] == ("a.org", "/es/", "org/es/", "block") and got[4] == ("xorg", "/es/", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("example.net/de/8", "block") and got[8][2:] == ("net/de/", "allow")
    assert got[9] == ("net", "", None, "allow") and got[10] == ("É.com", "/en/", "com/en/", "block")


def test_blocks_reach_aliases_and_allows_come_first(spark):
    rows = [
        (1, "http://a.site/1", link("http://x.com/en/1")),  # alias of a blocked URL that is no page here
        (2, "http://b.site/1#top", '<META http-equiv=refresh content="0; URL=http://a.site/1#f">'),  # alias of an alias
        (3, "http://c.site/1", link("http://y.com/en/1")), (4, "http://d.net/de/1", link("http://c.site/1")),  # block and allow
        (5, "http://e.site/x", link("/y")), (6, "http://e.site/y", ""),  # relative, nothing decided
        (7, "http://z.org/es/1", link("http://d.net/de/1")),  # a rule of its own
        (8, "http://r.site/", ""), (8, "http://r.site/", ""),
    ]
    redirects = spark.createDataFrame([("http://r.site/", "http://q.com/en/"), (None, "http://q.com/en/")], "src string, dst string")
    got = sorted((r.page_id, r.verdict, r.by_alias) for r in url_filter.judge(pages(spark, rows), RULES, redirects).collect())
    assert got == [(1, "block", True), (2, "block", True), (3, "allow", True), (4, "allow", False), (5, "allow", False), (6, "allow", False), (7, "block", False), (8, "block", True), (8, "block", True)]
    assert sorted(r.page_id for r in url_filter.kept(pages(spark, rows[:7]), RULES).collect()) == [3, 4, 5, 6]
    assert url_filter.judge(pages(spark, []), RULES).count() == 0


PLANTED = [
    (1, "http://A.site/p/q?x=1", '<link rel="canonical" href="r">'), (2, "http://a.site/p/r", link("http://x.com/en/1")),  # beside the page, host case
    (3, "HTTP://B.site/", link("http://c.com/en/9")), (4, "http://e.site/1", link("http://b.site/")),
    (5, "http://f.site/", '<link href="http://y.com/en/1" rel="alternate canonical">'), (6, "http://g.site/", "<!-- " + link("http://y.com/en/1") + " -->"),
    (7, "http://h.site/", "<link rel=canonical href=http://z.com/en/1>"), (8, "http://i.site/a/b/c", link("../../d/./e")), (9, "http://i.site/d/e", link("//j.org/es/")),
    (10, "http://k.site/", link("http://l.com/en/?a=1&amp;b=2")), (11, "http://l.com/en/?a=1&b=2", None), (12, "http://m.site/x?y", link("?z")), (13, "http://m.site/x?z", link("http://n.com/en/")),
    (14, "http://o.site/", "<link rel='canonicals' href='http://y.com/en/1'>"), (15, "http://p.site/", "<!-- open " + link("http://y.com/en/1")), (16, None, link("http://y.com/en/1")),
    (17, "http://q.site/#a", link("#b")), (18, "http://r.site/a/..", link("..")), (19, "http://s.site/long", "x" * 300_000 + link("http://y.com/en/2")), (20, "http://t.site/" + "p/" * 50_000, link("http://y.com/en/3")),
]


def test_links_and_verdicts_equal_sql(spark, tmp_path):
    pages(spark, PLANTED).coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    expect = con.sql(queries.OP1_SQL)
    got = url_filter.judge(spark.read.parquet(str(tmp_path / "pages")), RULES).select(*expect.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expect.fetchall()))
    blocked = {r.page_id for r in got if r.verdict == "block"}
    assert blocked == {1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 19, 20}


def test_rules_of_many_hosts_and_equal_lengths(spark, monkeypatch):
    rules = [("a.b.c.d/x", "block"), ("d/", "block"), ("c.d/xyz", "allow"), ("b.c.d/x", "allow"), ("c.d/ab", "block"), ("c.d/ac", "allow"), ("c.d/ab", "allow"), ("h/", "allow")]
    rows = [(k, u, None) for k, u in enumerate(["http://a.b.c.d/xyz", "http://z.c.d/xyz", "http://z.c.d/x", "http://b.c.d/x", "http://c.d/ab", "http://d", "http://e.d/", "http://xc.d/ab", "http://h"])]
    want = ["a.b.c.d/x", "c.d/xyz", "d/", "b.c.d/x", "c.d/ab", None, "d/", "d/", None]
    for bound in (1 << 20, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", bound)
        got = {r.page_id: r for r in url_filter.judge(pages(spark, rows), rules).collect()}
        assert [got[k].rule for k in range(len(rows))] == want and got[4].verdict == "allow"
    assert {r.verdict for r in url_filter.judge(pages(spark, rows), []).collect()} == {"allow"}


def test_components_equal_plain_search(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2100)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train(secret_scan.sample_findings(spark, 1500), trees=20)


def other_findings(n=600, seed=3):
    """(text, path, start, secret) of forms that no training finding has."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["customer", "invoice", "Report", "Summary", "handler", "Service", "Factory", "account", "Payment", "window", "Builder", "street"]
    out = []
    for k in range(n):
        kind = k % 10
        uuid = "-".join(pick(hexes, m) for m in (8, 4, 4, 4, 12))
        lead, key, close = [
            ("AWS_SECRET_ACCESS_KEY=", pick(b64[:62], 40), "\n"), ('{"client_secret": "', pick(b64, 32), '"}'), ("Authorization: Bearer ", pick(b64[:62], 36), "\n"),
            ("my.private_key = '", pick(hexes, 48), "'"), ("export DB_PASSWORD='", pick(b64[:62], 24), "'"),
            ("git checkout ", pick(hexes, 40), " and"), ("sha256sum: ", pick(hexes, 64), "  file"), ("row id ", uuid, ","),
            ("call ", "".join(rng.choice(words).capitalize() for _ in range(4)), "()"), ("phone ", pick("0123456789", 18), "."),
        ][kind]
        before = " ".join(rng.choice(words) for _ in range(3)) + "\n" + lead
        out.append((before + key + close + " " + rng.choice(words), f"deploy/{rng.choice(words)}.env", len(before), kind < 5))
    return out


def test_forest_on_findings_of_other_forms(spark, forest):
    """Precision and recall on forms that training has not seen."""
    rows = [(k, *r) for k, r in enumerate(other_findings())]
    held = spark.createDataFrame(rows, "doc_id long, text string, path string, labelled long, label boolean")
    got = secret_scan.scan(held, forest).join(held.select("doc_id", "labelled", "label"), "doc_id").filter("start = labelled").collect()
    assert len(got) == len(rows)
    hit = sum(r.secret and r.label for r in got)
    precision, recall = hit / max(1, sum(r.secret for r in got)), hit / sum(r.label for r in got)
    print("precision", precision, "recall", recall)
    assert precision > 0.9 and recall > 0.8, (precision, recall)


def brute_candidates(text):
    """(start, candidate, before, after) by Python's own regular expressions."""
    found = list(regex.finditer(secret_scan.CANDIDATE, text))  # looks behind by varying lengths
    ends = [0, *[m.end() for m in found]]
    for k, m in enumerate(found):
        then = text[m.end() : found[k + 1].start()][: secret_scan.CONTEXT] + found[k + 1].group() if k + 1 < len(found) else text[m.end() :]
        yield m.start(), m.group(), text[ends[k] : m.start()][-secret_scan.CONTEXT :], then[: secret_scan.CONTEXT]


def brute_features(c, before, after, path, words):
    low, n = c.lower(), len(c)
    runs = lambda pattern, x=c: len(re.findall(pattern, x)) / n
    near = before + " " + after
    covered = n - len(re.sub("|".join(sorted(words, key=lambda w: (-len(w), w))), "", low))
    return [
        n, sum(x in "0123456789" for x in c) / n, sum("A" <= x <= "Z" for x in c) / n, sum(x in "+/_-=" for x in c) / n,
        sum(a.isdigit() != b.isdigit() and (a + b).isalnum() for a, b in zip(c, c[1:])) / n, sum(a.islower() and b.isupper() or a.isupper() and b.islower() for a, b in zip(c, c[1:])) / n,
        sum(a == b for a, b in zip(c, c[1:])) / n, len(set(c)) / n, all(x in "0123456789abcdef" for x in low), c.isdigit(),
        re.fullmatch("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low) is not None, covered / n, sum(x in "aeiou" for x in low) / n,
        any(x in path.lower() for x in ("test", "example", "fixture", "mock", "doc")), path.count("/"), len(path),
        re.search(secret_scan.NAMES_SECRET, before) is not None, re.search(secret_scan.NAMES_OTHER, near) is not None,
        re.search("[=:]\\s*[\"'`]?$", before) is not None, before[-1:] in "\"'`" and before != "" and after[:1] in "\"'`" and after != "",
    ]


def test_candidates_and_features_equal_plain_versions(spark):
    texts = [t for t, _, _, _ in other_findings(60, 8)] + ["", 'password = "hunter2x9"; pwd: Tr0ub4dor&3\npasswd=é token:= a=b== secret => x', "key: a tokens: token=" + "z" * 50 + " auth=[b] my_secret_name_2 :'q r'", "é" * 50 + " tokenA1" * 3 + " " + "Ab1" * 200 + "==", " ".join(f"k{k}=" + "aB3" * 8 for k in range(700))]
    docs = spark.createDataFrame([(k, t, f"src/test{k % 3}/a.py") for k, t in enumerate(texts)], "doc_id long, text string, path string")
    words = ["account", "count", "invoice", "pay"]
    got = sorted((r.doc_id, r.start, r.candidate, r.before, r.after, *[r[f] for f in secret_scan.FEATURES]) for r in secret_scan.described(secret_scan.candidates(docs), words).collect())
    want = sorted((k, *c, *map(float, brute_features(*c[1:], f"src/test{k % 3}/a.py", words))) for k, t in enumerate(texts) for c in brute_candidates(t))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:]), (g, w)


def test_dictionary_is_the_corpus_own(spark):
    rows = [("The Report report-REPORTS", 1), ("report window", 2), (None, 3), ("averyverylongword abc", 4)]
    assert secret_scan.corpus_words(spark.createDataFrame(rows, "text string, w int")) == ["report", "reports", "window"]
    assert secret_scan.corpus_words(spark.createDataFrame([], "text string")) == []
    few = secret_scan.sample_findings(spark, 300)
    assert secret_scan.train(few, [], trees=2, most=50).numClasses == 2


def test_assigned_values_of_any_length(spark, forest):
    """Short passwords, with letters only or broken up by other marks, reach the forest; plain words beside them are dropped."""
    secrets = ["hunter2x9", "Tr0ub4dor&3", "qzkwvxj", "p@55", "AbcdefGh1234567890!x", "S3cr.t-99"]
    others = ["null", "required", "name", "config.value", "the"]
    forms = ['db password = "{}" end', "set pwd: {}\nnext", "DB_PASSWORD={} next", "{{'auth_secret': '{}'}}"]
    rows = [(k, f.format(v), v, v in secrets) for k, (v, f) in enumerate((v, f) for v in secrets + others for f in forms)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string, label boolean").withColumn("path", F.lit("src/a.py"))
    got = secret_scan.scan(docs, forest).join(docs.select("doc_id", "value", "label"), "doc_id").filter("candidate = value").collect()
    assert len(got) == len(rows)
    hit, of = sum(r.secret for r in got if r.label), sum(r.label for r in got)
    false = sum(r.secret for r in got if not r.label)
    print("assigned values: found", hit, "of", of, "false", false, "of", len(got) - of)
    assert hit > 0.8 * of and false < 0.2 * (len(got) - of), [(r.value, r.probability) for r in got if r.secret != r.label]


def test_scan_places_and_odd_rows(spark, forest):
    key = hashlib.sha1(b"k").hexdigest()
    text = f'é token = "{key}" and 4111111111111111 then\nreadTheFileNameFromUserList end token = "{key}"'
    rows = [(1, text, None), (2, None, "p"), (3, "", "p"), (1, text, None), (4, "word " * 20000 + f' token = "{key}" ', "src/a.py"), (5, key, "")]
    docs = spark.createDataFrame([(i, t, p, "q", 0.5) for i, t, p in rows], "doc_id long, text string, path string, candidate string, probability double")
    got = secret_scan.scan(docs, forest).collect()
    for r in got:
        own = next(t for i, t, _ in rows if i == r.doc_id)
        assert own[r.start : r.start + r.length] == r.candidate
    found = sorted((r.doc_id, r.secret) for r in got if r.candidate == key and r.doc_id != 5)
    assert found == [(1, True)] * 4 + [(4, True)]
    assert not any(r.secret for r in got if r.candidate in ("4111111111111111", "readTheFileNameFromUserList"))
    assert secret_scan.scan(docs.limit(0), forest).count() == 0


CONTROL = st.sampled_from(["<", "|", "\\", "<|end|>\n", "<|", "</s>", "<s>", "[INST]", "[/INST]", "[", "a", "\n", "<\\|", "<|start|>", "<|body|>", "é", "s>", "/", "😀"])


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(CONTROL, max_size=8).map("".join), min_size=250, max_size=250))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e")))
    for r in out.collect():
        assert r.u == r.t and not any(c in r.e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


ROWS = [
    (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "<|end|>\n<|start|>x"), (1, 2, "assistant", "é😀"), (2, 0, None, None), (2, 1, "assistant", ""),
    (None, 5, "user", "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, None, "system", "first"), (4, 0, "we<|body|>ird", "y"),
    (5, 0, "assistant", "long <|end|> " * 40_000), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie too"),
]


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, t int")


def test_chats_read_back(spark):
    df = chat_format.format_chats(chats(spark, ROWS))
    df = df.withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.masked(F.col("turns"), F.col("loss_spans")))
    got = {r.conv_id: r for r in df.collect()}
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        r = got[conv]
        assert [(t.role, t.content) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own] and r.n_turns == len(own)
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        for s in r.loss_spans:
            assert r.formatted[s.start : s.start + s.length] == r.turns[s.turn_index].raw
    assert len(got) == 6 and chat_format.format_chats(chats(spark, [])).count() == 0


def test_typed_parts(spark):
    parts = [("text", "look <|image|>", None, None), ("image", None, "a.png", 2.0), None, ("audio", None, "b.wav", 1.5), ("document", None, None, None), ("video", None, "c.mp4", 3.0), ("text", "end", None, None)]
    rows = [(1, 0, "user", "ignored", parts), (1, 1, "assistant", "plain", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content {chat_format.PARTS}")
    r = chat_format.format_chats(df, parts="content").first()
    assert r.formatted == "<|start|>user<|body|>look <\\|image|><|image|><|audio|><|document|><|other|>end<|end|>\n<|start|>assistant<|body|>plain<|end|>\n"
    assert [tuple(a) for a in r.attachments] == [(0, "image", "a.png", 512), (0, "audio", "b.wav", 38), (0, "document", None, 700), (0, "other", "c.mp4", 3)]
    assert r.expanded_tokens == 6 + 512 + 38 + 700 + 3 + 1 + 1
