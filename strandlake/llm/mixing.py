r"""Mixing sources to target weights by Pareto order sampling.

Targets are water-filled: sources share the total by weight, none above ``max_copies`` times its own size, the excess
going to the others by weight. A source whose target is r times its size takes every document floor(r) times for
certain; what is left of the target is an unequal-probability sample of fixed size, measured in words as the targets are.

1. Inclusion probabilities go by size: p = min(1, rate * size), each source's rate being the one at which the expected
   words meet what is left of its target. It follows in one step from the words and squared words of each distinct size.
2. Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), u from a hash of the id.
   Documents with p = 1 come first.
3. The sample is the prefix of that ranking whose words meet what is left of the target. The last document is cut there
   (``cut_last``), or is in whole or out, whichever is nearer.

The rank is used as odds / (1 + odds), a number in [0, 1), in steps of 2 ** -52. The place where the prefix ends is found
without sorting a source in one task: three rounds each add up the words of 1024 equal ranges and enter the range where
the target falls, then the few rows left there are ordered. Rows are narrow, written once, and never shuffled by source
while sources are few; texts never shuffle, their copies come back as bitmaps of row places (``store.marked``).

Defined cases: a null text has size 0, a very long one its full size; a document of size 0 is taken by certain copies
only. A null source is a source of its own, last in order; a null id is ranked by the text's hash. Rows equal in id and
text rank equally and are taken or left together; other ties of rank likewise. An empty table, or one without words,
takes nothing. Columns of the input may have any names and keep their values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.store import addressed, fresh, marked, marks, ordinals, own, stash

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a rank that a round fixes, rounds, and bits of a rank.
STEP, ROUNDS, BITS = 10, 3, 52
#: Broadcast of one row a source: up to this many sources (under 100 bytes each); beyond, narrow rows meet in an ordinary join.
BROADCAST_SOURCES = 100_000
EXACT = "decimal(38,0)"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, total: float, max_copies: float) -> DataFrame:
    """(source, source_size, weight) with ``target``: each round caps what is above and shares the rest by weight."""
    cap = F.col("source_size") * F.lit(float(max_copies))
    left, capped = None, -1
    level = None
    while True:
        is_capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        row = sources.agg(
            F.sum(F.when(is_capped, cap).otherwise(0.0)).alias("full"), F.sum(F.when(is_capped, 0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(is_capped, 1)).alias("n")
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, left = row["n"], max(0.0, total - row["full"])
        level = left / row["open"]
    wanted = cap if level is None or not row["open"] else F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", wanted.cast("double"))


def uniform(seed: int, doc_id: str, text: str) -> Column:
    """A number in (0, 1) for each id (for a null one, each text): the middle of one of 2 ** 52 steps."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, BITS // 4), 16, 10).cast("long")
    return (drawn.cast("double") + 0.5) / float(1 << BITS)


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, x, as x / (1 + x) in steps of 2 ** -BITS; null if p is not above 0."""
    high = u * (1.0 - p)
    return F.when(p > 0, F.floor(high / (high + (1.0 - u) * p) * float(1 << BITS)).cast("long"))


def _meet(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(per_source) if few else per_source, "_sid")


def _rates(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``plan`` with ``rate``: where words(sizes above v) + rate * squares(sizes up to v) = need for the largest v with rate * v <= 1.

    Sums are exact; a source has as many rows here as it has distinct sizes.
    """
    sizes = rows.filter("_size > 0").groupBy("_sid", "_size").agg(F.count("*").alias("_n"))
    v, n = F.col("_size").cast(EXACT), F.col("_n").cast(EXACT)
    falling = Window.partitionBy("_sid").orderBy(F.desc("_size"))
    words, squares = (n * v).cast(EXACT), (n * v * v).cast(EXACT)
    above = F.sum(words).over(falling).cast(EXACT) - words
    beyond = F.sum(squares).over(falling).cast(EXACT) - squares
    each = sizes.withColumns({"_above": above.cast(EXACT), "_upto": (F.sum(squares).over(Window.partitionBy("_sid")) - beyond).cast(EXACT)})
    rate = (F.col("need") - F.col("_above").cast("double")) / F.col("_upto").cast("double")
    fits = _meet(each, plan.select("_sid", "need"), few).withColumn("_rate", rate).filter((F.col("_rate") >= 0) & (F.col("_rate") * F.col("_size") <= 1.0))
    best = fits.groupBy("_sid").agg(F.max_by("_rate", "_size").alias("rate"))
    return plan.join(F.broadcast(best) if few else best, "_sid", "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))


def _ranked(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """(_sid, _size, ...) of ``rows`` with ``_p`` and ``_z``."""
    met = _meet(rows, plan, few).withColumn("_p", F.least(F.lit(1.0), F.col("rate") * F.col("_size")))
    return met.withColumn("_z", pareto_rank(F.col("_u"), F.col("_p")))


def _narrow(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, *more: str) -> DataFrame:
    """_id, _sid, _size, _u and ``more``. A null source cannot meet itself in a join: "-" stands for it, "+" precedes others."""
    sid = F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))
    return docs.select(F.col(doc_id).alias("_id"), sid.alias("_sid"), word_count(text).alias("_size"), uniform(seed, doc_id, text).alias("_u"), *more)


def _sample(rows: DataFrame, weights: tuple[float, ...], share: float, max_copies: float, cut_last: bool) -> tuple[DataFrame, bool]:
    """One row a source: what it takes; and whether the sources are few enough to broadcast."""
    sizes = rows.groupBy("_sid").agg(F.sum("_size").alias("source_size"))
    order = F.when(F.col("_sid") == "-", F.lit(None).cast("string")).otherwise(F.col("_sid")).asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights)).cast("int") + 1)
    per_source = stash(ordinals(sizes, order, "_at").withColumn("weight", weight), "sources")
    seen = per_source.agg(F.sum("source_size").alias("all"), F.count("*").alias("n")).first()
    few = seen["n"] <= BROADCAST_SOURCES
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets(per_source, share * (seen["all"] or 0), max_copies).withColumn("whole", F.floor(ratio + 1e-12).cast("int"))
    plan = plan.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = _rates(rows, stash(plan.select("_sid", "source_size", "target", "whole", "need"), "plan"), few)
    plan = stash(plan.withColumns({"_low": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")}), "plan")

    width = 1 << BITS
    near = lambda wide: _ranked(rows, plan.select("_sid", "rate", "_low"), few).filter((F.col("_z") >= F.col("_low")) & (F.col("_z") < F.col("_low") + F.lit(wide)))
    wanted = lambda: F.broadcast(plan.select("_sid", "need", "_before")) if few else plan.select("_sid", "need", "_before")
    for _ in range(ROUNDS):  # [_low, _low + width) is the range of ranks where the target falls, _before the words below it
        narrower = width >> STEP
        cells = near(width).groupBy("_sid", F.floor((F.col("_z") - F.col("_low")) / narrower).alias("_cell")).agg(F.sum("_size").alias("_words"))
        run = F.sum("_words").over(Window.partitionBy("_sid").orderBy("_cell"))
        entered = cells.withColumn("_run", run).join(wanted(), "_sid")
        entered = entered.filter(F.col("_before") + F.col("_run") > F.col("need")).groupBy("_sid").agg(F.min(F.struct("_cell", (F.col("_run") - F.col("_words")).alias("_under"))).alias("_at2"))
        plan = plan.join(F.broadcast(entered) if few else entered, "_sid", "left").withColumns(
            {"_low": F.coalesce(F.col("_low") + F.col("_at2._cell") * narrower, F.col("_low")), "_before": F.coalesce(F.col("_before") + F.col("_at2._under"), F.col("_before"))}
        )
        plan, width = stash(plan.drop("_at2"), "plan"), narrower

    ties = near(width).groupBy("_sid", "_z").agg(F.sum("_size").alias("_words"))
    run = F.sum("_words").over(Window.partitionBy("_sid").orderBy("_z"))
    ends = ties.withColumn("_run", run).join(wanted(), "_sid")
    short = F.col("need") - (F.col("_before") + F.col("_run") - F.col("_words"))
    ends = ends.filter(F.col("_before") + F.col("_run") > F.col("need")).groupBy("_sid").agg(F.min(F.struct(F.col("_z").alias("z"), (short / F.col("_words")).alias("part"))).alias("_end"))
    # whole below _end.z; there, the part of its words that is left of the target, rounded unless the last may be cut
    part = F.col("_end.part") if cut_last else F.round("_end.part")
    none = F.col("_end").isNull() | (F.col("need") <= 0)
    plan = plan.join(F.broadcast(ends) if few else ends, "_sid", "left")
    plan = stash(plan.withColumns({"_cut": F.when(none, F.lit(-1).cast("long")).otherwise(F.col("_end.z")), "_part": F.when(none, 0.0).otherwise(part)}).drop("_end"), "plan")
    return plan.select("_sid", "source_size", "target", "whole", "rate", "_cut", "_part"), few


def _copies() -> Column:
    more = F.when(F.col("_z") < F.col("_cut"), 1).when(F.col("_z") == F.col("_cut"), (F.col("_part") > 0).cast("int")).otherwise(0)
    return (F.col("whole") + more).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_copies: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, cut_last: bool = False) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, copies (int), taken (its words in the mix) and chance, the inclusion
    probability of what it may be taken beyond certain copies.

    ``cut_last``: the last document of a source's sample is cut where the target falls; else it is in whole or out,
    whichever is nearer.
    """
    rows = stash(_narrow(docs, doc_id, text, source, seed), "mixing")
    plan, few = _sample(rows, weights, share, max_copies, cut_last)
    ranked = _ranked(rows, plan, few)
    more = F.when(F.col("_z") < F.col("_cut"), F.col("_size")).when(F.col("_z") == F.col("_cut"), F.round(F.col("_size") * F.col("_part")).cast("long")).otherwise(0)
    name = F.when(F.col("_sid") == "-", F.lit(None).cast("string")).otherwise(F.substring(F.col("_sid"), F.lit(2), F.length("_sid")))
    taken = F.col("whole") * F.col("_size") + more
    return ranked.select(F.col("_id").alias(doc_id), name.alias(source), F.col("_size").alias("size"), "source_size", "target", _copies().alias("copies"), taken.cast("long").alias("taken"), F.col("_p").alias("chance"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_copies: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, whole, with all its columns. No whole row shuffles."""
    wide, file, at = addressed(docs)
    rows = stash(_narrow(wide, doc_id, text, source, seed, F.col(file).alias("_file"), F.col(at).alias("_at")), "mixing")
    plan, few = _sample(rows, weights, share, max_copies, False)
    levels = math.ceil(max_copies)
    taken = marks(_ranked(rows, plan, few).withColumn("_times", _copies()), "_file", "_at", *[F.col("_times") > k for k in range(levels)])
    times, copy = fresh(wide, "_times", "_copy")
    met = marked(wide, file, at, taken, rows.count(), levels, times).filter(F.col(times) > 0)
    return met.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*own(docs))
