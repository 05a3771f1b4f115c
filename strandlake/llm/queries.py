"""The registered queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import chat_format, exact_dedup, mixing, ngram_join, packing, secret_scan, sharding, topk, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("path"))
    words = secret_scan.corpus_words(docs)
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.sample_findings(spark), words), words)
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "secret")


def op3_typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    chats = chat_format.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    back = chats.withColumn("turns", chat_format.read_back(F.col("formatted")))
    back = back.withColumn("loss", chat_format.masked(F.col("turns"), F.col("loss_spans")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "expanded_tokens",
    )


def op4_toxicity_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out("_id"))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op6_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), window=2048, end_id=1)


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), cut_last=True).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE rules(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
bodies AS (SELECT url, regexp_replace(coalesce(html, ''), '(?s)<!--.*?(?:-->|\z)', '', 'g') AS body FROM pages),
tags AS (SELECT url, regexp_extract(unnest(regexp_extract_all(body, '(?is)<link\b[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"[^>]*|''(?:[^''>]*\s)?canonical(?:\s[^''>]*)?''[^>]*|canonical(?:[\s/][^>]*)?)>')), '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1) AS t FROM bodies
  UNION ALL SELECT url, regexp_extract(unnest(regexp_extract_all(body, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1) FROM bodies),
links AS (SELECT url, regexp_replace(t, '&(amp;|#38;|#[xX]26;)', '&', 'g') AS t, regexp_extract(url, '^[^:/?#]*:') AS scheme, regexp_extract(url, '^[^:/?#]*://[^/?#]*') AS origin,
  CASE WHEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END AS path,
  regexp_extract(substr(url, position('://' IN url) + 3), '(?s)^[^?#]*(\?[^#]*)?', 1) AS query FROM tags WHERE contains(url, '://')),
dotted AS (SELECT *, CASE WHEN starts_with(t, '/') THEN t ELSE regexp_extract(path, '(?s)^.*/') || t END AS whole FROM links),
cut AS (SELECT *, regexp_extract(whole, '(?s)^[^?]*') AS pb, regexp_extract(whole, '(?s)\?.*$') AS pq FROM dotted),
tidied AS (SELECT *, list_reduce(list_prepend('', string_split(substr(pb, 2), '/')), lambda o, x: CASE WHEN x = '..' THEN regexp_replace(o, '/[^/]*$', '') WHEN x = '.' THEN o ELSE o || '/' || x END) AS kept FROM cut),
paths AS (SELECT *, CASE WHEN regexp_matches('/' || pb || '/', '/\.\.?/') THEN CASE WHEN kept = '' THEN '/' WHEN regexp_matches(pb, '/\.\.?$') THEN kept || '/' ELSE kept END ELSE pb END || pq AS tidy FROM tidied),
targets AS (SELECT url AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN t WHEN starts_with(t, '//') THEN scheme || t WHEN starts_with(t, '?') THEN origin || path || t WHEN starts_with(t, '#') THEN origin || path || query ELSE origin || tidy END AS b FROM paths),
ends AS (SELECT translate(regexp_extract(a, '^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(a, length(regexp_extract(a, '^.*?://[^/?#]*')) + 1), '(?s)^[^#]*') AS a,
  translate(regexp_extract(b, '^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(b, length(regexp_extract(b, '^.*?://[^/?#]*')) + 1), '(?s)^[^#]*') AS b FROM targets WHERE contains(b, '://')),
edges AS (SELECT a, b FROM ends WHERE a <> b),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
urls AS (SELECT url AS u FROM pages UNION SELECT b FROM reach),
parsed AS (SELECT u, CASE WHEN contains(u, '://') THEN substr(u, position('://' IN u) + 3) END AS rest FROM urls),
split AS (SELECT u, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parsed),
ruled AS (SELECT s.u, s.host, s.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM split s
  LEFT JOIN rules r ON (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1))) AND starts_with(s.path, substr(r.rule, position('/' IN r.rule))) GROUP BY 1, 2, 3),
near AS (SELECT r.a, bool_or(d.verdict = 'allow') AS allowed, bool_or(d.verdict = 'block') AS blocked FROM reach r JOIN ruled d ON d.u = r.b GROUP BY 1)
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule,
  coalesce(r.verdict, CASE WHEN n.allowed THEN 'allow' WHEN n.blocked THEN 'block' ELSE 'allow' END) AS verdict, (r.verdict IS NULL AND (coalesce(n.allowed, false) OR coalesce(n.blocked, false))) AS by_alias
FROM pages p LEFT JOIN ruled r ON r.u = p.url LEFT JOIN near n ON n.a = translate(regexp_extract(p.url, '^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(p.url, length(regexp_extract(p.url, '^.*?://[^/?#]*')) + 1), '(?s)^[^#]*')
"""

OP3_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\2\\\3', 'g') AS et, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\2\\\3', 'g') AS er FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(25 + length(et) + length(er)) AS BIGINT) AS formatted_chars,
  CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))) AS BIGINT) AS expanded_tokens
FROM e GROUP BY conv_id
"""

OP6_SQL = """
WITH u AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS own, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.own, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM u q JOIN u c ON q.own <> c.own WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], chr(10))) WHEN len(t) > 0 THEN [array_to_string(t, chr(10))] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE both_have >= 0.8 * (x.n + y.n - both_have) - 1e-9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links FROM documents d
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    (CAST('0x' || substr(sha256('0:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
f AS (SELECT *, source_size::DOUBLE * 2.0 AS cap, sum(source_size) OVER ()::DOUBLE * 1.5 AS total, row_number() OVER (ORDER BY source_size::DOUBLE * 2.0 / weight, source NULLS LAST) AS k FROM s),
l AS (SELECT *, greatest(0.0, total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
lev AS (SELECT arg_min(level, k) AS level FROM l WHERE weight * level < cap),
t AS (SELECT l.source, source_size, least(cap, coalesce(weight * (SELECT level FROM lev), cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t),
need AS (SELECT *, greatest(0.0, target - whole * source_size) AS need FROM p),
v AS (SELECT source, size, sum(count(*) * size) OVER w - count(*) * size AS above, sum(count(*) * size * size) OVER (PARTITION BY source) - sum(count(*) * size * size) OVER w + count(*) * size * size AS upto
  FROM d WHERE size > 0 GROUP BY source, size WINDOW w AS (PARTITION BY source ORDER BY size DESC)),
r AS (SELECT v.source, arg_max((need - above::DOUBLE) / upto::DOUBLE, size) AS rate FROM v JOIN need n ON n.source IS NOT DISTINCT FROM v.source
  WHERE (need - above::DOUBLE) / upto::DOUBLE >= 0 AND (need - above::DOUBLE) / upto::DOUBLE * size <= 1.0 GROUP BY v.source),
m AS (SELECT d.*, n.source_size, n.target, n.whole, n.need, least(1.0, coalesce(r.rate, 1.0) * d.size) AS chance FROM d JOIN need n ON n.source IS NOT DISTINCT FROM d.source LEFT JOIN r ON r.source IS NOT DISTINCT FROM d.source),
z AS (SELECT *, CASE WHEN chance > 0 THEN CAST(floor(u * (1.0 - chance) / (u * (1.0 - chance) + (1.0 - u) * chance) * 4503599627370496.0) AS BIGINT) END AS z FROM m),
x AS (SELECT *, sum(CASE WHEN z IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY z NULLS LAST) AS run, sum(size) OVER (PARTITION BY source, z) AS tied FROM z),
c AS (SELECT *, CASE WHEN z IS NULL OR need <= 0 THEN 0.0 WHEN run <= need THEN 1.0 WHEN run - tied < need THEN (need - (run - tied)) / tied ELSE 0.0 END AS part FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + round(size * part) AS BIGINT) AS taken, source, CAST(whole + CASE WHEN part > 0 THEN 1 ELSE 0 END AS INT) AS copies FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_redirect_url_filter": op1_redirect_url_filter,
        "op2_forest_secret_scan": op2_forest_secret_scan,
        "op3_typed_chat": op3_typed_chat,
        "op4_toxicity_viterbi": op4_toxicity_viterbi,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op6_norm_topk": op6_norm_topk,
        "op5_kk_packing": op5_kk_packing,
        "op8_pareto_mixing": op8_pareto_mixing,
        "op9_kk_sharding": op9_kk_sharding,
        "op10_bloom_dedup": op10_bloom_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_redirect_url_filter": OP1_SQL, "op3_typed_chat": OP3_SQL, "op6_norm_topk": OP6_SQL, "op7_ngram_jaccard": OP7_SQL, "op8_pareto_mixing": OP8_SQL, "op10_bloom_dedup": OP10_SQL}
