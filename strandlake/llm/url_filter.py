r"""URL filters with redirect equivalence, in DataFrame functions only.

A rule names a host and a path prefix; it fits that host and its subdomains, and the longest rule wins (at equal length
an allow). Rules are rows, not code: those of a host form one row, which a page meets by an equi-join for each number of
labels that rule hosts have, so a list of any length costs as many joins; up to ``BROADCAST_BYTES`` it is broadcast.

URLs joined by a redirect or a canonical link are aliases; aliases form the connected components of the edges.
A URL without a rule of its own is allowed if an alias has an allow rule, else blocked if an alias has a block rule, else
allowed. A rule of its own always decides.

Edges come from the pages (canonical links and refresh redirects in the HTML, comments aside) and from an optional table
of redirects. A URL is a node by its text without fragment, scheme and host in lower case. Link targets are resolved
against the page as RFC 3986 has it: with a scheme, from ``//``, from ``/``, or from the page's folder, dot segments
removed; character references for ``&`` are decoded. Pages and decisions are narrow rows: HTML is read once and not
shuffled. Only URLs that have edges meet the components. A URL that a third of the pages share is one node; its pages
are spread over salted keys.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is no node. A very long
URL or page is read whole. Repeated rows each get their verdict. An empty table gives an empty result. Columns of the
input may have any names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.components import components
from strandlake.llm.store import BROADCAST_BYTES, group_lookup, row_salt, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"[^>]*|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'[^>]*|canonical(?:[\s/][^>]*)?)>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    start = F.regexp_extract(url, r"^.*?://[^/?#]*", 0)
    return F.when(F.locate("://", url) > 0, F.concat(F.translate(start, UPPER, LOWER), F.regexp_extract(F.substring(url, F.length(start) + 1, F.length(url)), r"(?s)^[^#]*", 0)))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what a query holds is left alone."""
    body, query = F.regexp_extract(path, r"(?s)^[^?]*", 0), F.regexp_extract(path, r"(?s)\?.*$", 0)
    parts = F.split(F.substring(body, F.lit(2), F.length(body)), "/")  # after the leading slash
    ends = F.element_at(parts, -1).isin(".", "..")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    tidy = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), "/").otherwise(""))
    return F.concat(F.when(F.concat(F.lit("/"), body, F.lit("/")).rlike(r"/\.\.?/"), tidy).otherwise(body), query)


def resolved(page: Column, target: Column) -> Column:
    """The URL that a link target of a page names."""
    to = F.regexp_replace(target, r"&(amp;|#38;|#[xX]26;)", "&")
    scheme = F.regexp_extract(page, r"^[^:/?#]*:", 0)
    origin, path = F.regexp_extract(page, r"^[^:/?#]*://[^/?#]*", 0), path_of(page)
    path = F.when(path == "", "/").otherwise(path)
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    query = F.regexp_extract(after_scheme(page), r"(?s)^[^?#]*(\?[^#]*)?", 1)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), to)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("/"), F.concat(origin, without_dots(to)))
        .when(to.startswith("?"), F.concat(origin, path, to))
        .when(to.startswith("#"), F.concat(origin, path, query))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, to))))
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(_host, _labels, _rules): a host's rules as (path prefix, rule, verdict), the first that fits being the one that wins."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[1] != ALLOW, r[0])):
        host, _, rest = text.partition("/")
        by_host.setdefault(host.translate(str.maketrans(UPPER, LOWER)), []).append(("/" + rest, text, said))
    rows = [{"_host": host, "_labels": host.count(".") + 1, "_rules": [dict(zip(("prefix", "rule", "said"), r, strict=True)) for r in own]} for host, own in by_host.items()]
    kind = "array<struct<_host:string,_labels:int,_rules:array<struct<prefix:string,rule:string,said:string>>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def with_rules(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``rows`` (with ``host`` and ``path``) with ``rule`` and ``_said``, the winning rule and its verdict, or nulls."""
    table = rule_table(rows.sparkSession, rules)
    small = sum(4 * len(text) + 64 for text, _ in rules) <= BROADCAST_BYTES
    out, found = rows, []
    for n in sorted({text.partition("/")[0].count(".") + 1 for text, _ in rules}):
        own = table.filter(F.col("_labels") == n).select(F.col("_host").alias("_suffix"), F.col("_rules").alias(f"_rules{n}"))
        out = out.withColumn("_suffix", F.substring_index("host", ".", -n)).join(F.broadcast(own) if small else own, "_suffix", "left").drop("_suffix")
        fits = F.filter(f"_rules{n}", lambda r: F.col("path").startswith(r["prefix"]))
        found.append(F.get(fits, F.lit(0)))
    if not found:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "_said": F.lit(None).cast("string")})
    order = [F.struct(F.length(r["rule"]).alias("n"), (r["said"] == ALLOW).alias("allow"), r["rule"].alias("rule"), r["said"].alias("said")) for r in found]
    best = F.array_max(F.filter(F.array(*[F.when(r.isNotNull(), o) for r, o in zip(found, order, strict=True)]), lambda x: x.isNotNull()))
    return out.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "_said": F.col("_best.said")}).select(*rows.columns, "rule", "_said")


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's URL and each canonical or refresh target in its HTML."""
    own = pages.filter(F.col(html).rlike("(?i)canonical|refresh")).select(F.col(url).alias("_url"), F.regexp_replace(html, COMMENT, "").alias("_body"))
    targets = lambda tag, where: F.transform(F.regexp_extract_all("_body", F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, where, 1))
    # explode would infer a filter on the targets and so search each page twice
    links = own.select("_url", F.explode_outer(F.concat(targets(CANONICAL_TAG, HREF), targets(REFRESH_TAG, REFRESH_URL))).alias("_to")).filter("_to IS NOT NULL")
    return links.select(node_of(F.col("_url")).alias("a"), node_of(resolved(F.col("_url"), F.col("_to"))).alias("b")).dropna()


def judge(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: id, host, path, rule, verdict, by_alias. ``redirects``: columns (src, dst), or none."""
    links = page_edges(pages, url, html)
    if redirects is not None:
        links = links.unionAll(redirects.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).dropna())
    alias = stash(components(links), "aliases")

    u = F.col("_url")
    judged = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url")).withColumns({"host": host_of(u), "path": path_of(u), "_node": node_of(u)})
    judged = with_rules(judged.drop("_url"), rules)

    # decisions of nodes, also of those that are no page here, reach all nodes of the component
    said_of = with_rules(alias.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules).withColumn("_salt", row_salt("node"))
    spread = group_lookup(said_of, ["component"], "_salt", F.bool_or(F.col("_said") == ALLOW).alias("_a"), F.bool_or(F.col("_said") == BLOCK).alias("_b"))
    verdicts = stash(spread.filter("_a OR _b").select(F.col("node").alias("_node"), F.when(F.col("_a"), ALLOW).otherwise(BLOCK).alias("_alias")), "verdicts")
    out = judged.join(verdicts, "_node", "left")
    by_alias = F.col("_said").isNull() & F.col("_alias").isNotNull()
    return out.select(F.col("_id").alias(page_id), "host", "path", "rule", F.coalesce("_said", "_alias", F.lit(ALLOW)).alias("verdict"), by_alias.alias("by_alias"))


def kept(pages: DataFrame, rules: list[tuple[str, str]], **names: str) -> DataFrame:
    """The pages whose verdict is allow, all their columns; ids must be unique."""
    page_id = names.get("page_id", "page_id")
    blocked = judge(pages, rules, **names).filter(F.col("verdict") == BLOCK).select(page_id)
    return pages.join(blocked, page_id, "left_anti")
