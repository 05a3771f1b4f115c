"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Each document becomes its set of n-grams of words (runs without white space), hashed; sets that are equal are one
   class of copies, of which only a representative goes on.
2. MinHash signatures are cut into bands. The band count and the rows of a band follow from the wanted recall at the
   similarity: with r rows, b bands miss a pair at the threshold with probability (1 - s^r)^b.
3. Representatives shuffle on band hashes. Buckets of one are dropped, and of buckets with the same members all but the
   first band's.
4. A bucket that fits a block, bounded in members and n-grams, is compared there: a pair of sets in the first band where
   it meets, exactly, by its full sets. In a larger bucket every member first meets one leader, the least set of its
   buckets: members within half the allowed Jaccard distance of the same leader are all linked to one another, as that
   distance is a metric; so they are counted, not compared, and a bucket of near copies of one text costs no more than
   its members. Only pairs of blocks not proven so are compared. What leaves a comparison is a count of links for each set
   and a spanning forest, so no more rows than members; pairs are never written out.
5. Connected components of the forests give the classes.

Every link counts: ``n_links`` is the number of other documents with similarity ``threshold`` or more, copies included,
up to the recall of the bands. No bucket is capped.

Defined cases: a null or empty text, or one of white space, has no n-gram: it links to nothing and is a class of its own.
A text of fewer words than n is one n-gram of all its words; a very long one gives all its n-grams. Rows with a null id are
links to nobody: class null, no links. Rows that repeat an id are documents of their own and share the id's name; of rows
that tie for the least id of a class the first in its file stays. An empty table gives an empty result. Columns of the
input may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.components import components
from strandlake.llm.exact_dedup import may_hold
from strandlake.llm.store import SALTS, addressed, batches_of, bounded_batches, fresh, group_lookup, marked, marks, own, release, row_salt, stash, with_summary
from strandlake.llm.text import EDGE, SPACE, Hasher, char_class, chunks, code_points, give_back, mixed

#: Hash functions at most; members and n-grams of a block.
HASHES, BLOCK_MEMBERS, BLOCK_GRAMS = 128, 256, 1 << 18
#: Characters of texts that are made into full sets at a time, and the last text's.
HELD_CHARACTERS = 1 << 22


def bands_for(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall at the threshold within the hash budget."""
    for rows in range(16, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no banding reaches this recall within the hash budget")


_hasher = Hasher()


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, one after the other, and where each text's begin (and the end)."""
    codes, firsts = code_points(texts)
    kind = char_class()[codes]
    step = np.diff(np.concatenate(([0], ((kind != SPACE) & (kind != EDGE)).astype(np.int8), [0])))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    words = _hasher.slices(codes, starts, ends)
    bounds = np.searchsorted(starts, np.append(firsts, len(codes)))
    count = np.diff(bounds)
    with np.errstate(over="ignore"):
        grams = np.zeros(len(words), dtype=np.uint64)
        factor = np.uint64(1)
        for k in range(n):  # words beyond the end of a text count as none
            shifted = np.concatenate((words[k:], np.zeros(min(k, len(words)), dtype=np.uint64)))
            left = np.repeat(bounds[1:], count) - np.arange(len(words))
            grams += np.where(left > k, shifted, np.uint64(0)) * factor
            factor *= np.uint64(0x9E3779B97F4A7C15)
        grams = mixed(grams)
        whole = (np.repeat(bounds[1:], count) - np.arange(len(words)) >= n) | (np.repeat(count, count) < n) & (np.arange(len(words)) == np.repeat(bounds[:-1], count))
    owner = np.repeat(np.arange(len(texts)), count)[whole]
    grams = grams[whole]
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    owner, grams = owner[new], grams[new]
    return grams, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_keys(grams: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes that name each set; None for an empty one."""
    some = np.flatnonzero(np.diff(at) > 0)
    out: list[bytes | None] = [None] * (len(at) - 1)
    if len(some):
        with np.errstate(over="ignore"):
            a = mixed(np.add.reduceat(mixed(grams), at[some]))
            b = mixed(np.add.reduceat(mixed(grams ^ np.uint64(0x2545F4914F6CDD1D)), at[some]))
        raw = np.stack((a, b), axis=1).astype(">u8").tobytes()
        for k, i in enumerate(some.tolist()):
            out[i] = raw[16 * k : 16 * k + 16]
    return out


def signatures(grams: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes: one row for each non-empty set."""
    starts = at[:-1][np.diff(at) > 0]
    r = np.random.default_rng(977)
    factors = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adds = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, (f, a) in enumerate(zip(factors, adds, strict=True)):
            least = np.minimum.reduceat(grams * f + a, starts)
            out[:, k // rows] = mixed(out[:, k // rows] ^ mixed(least + np.uint64(k)))
    return out


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                texts = batch.column(1).slice(low, 512).to_pylist()
                for a, b in chunks(texts):
                    grams, at = gram_sets(texts[a:b], n)
                    keys, some = set_keys(grams, at), np.diff(at) > 0
                    signed = signatures(grams, at, bands, rows) if some.any() else np.zeros((0, bands), dtype=np.uint64)
                    lists = _lists(signed.ravel(), np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))))
                    whose = [batch.column(k).slice(low + a, b - a) for k in (0, 2, 3)]
                    yield pa.RecordBatch.from_arrays([whose[0], pa.array(keys, pa.binary()), pa.array(np.diff(at).astype(np.int64)), lists, *whose[1:]], names=["_id", "_set", "_grams", "_bands", "_file", "_at"])
        give_back()

    return docs.mapInArrow(run, f"_id {kind}, _set binary, _grams long, _bands array<long>, _file long, _at long")


def _full_sets(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(_set, _all, _bands) of (_text), whose texts have n-grams; texts are gathered, as the batches may be of few rows."""

    def work(found: list[str]) -> Iterator[pa.RecordBatch]:
        for a, b in chunks(found):
            grams, at = gram_sets(found[a:b], n)
            signed = signatures(grams, at, bands, rows)
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(grams, at), pa.binary()), _lists(grams, at), _lists(signed.ravel(), np.arange(b - a + 1) * bands)], names=["_set", "_all", "_bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text)
                size += len(text)
                if len(held) == 512 or size >= HELD_CHARACTERS:
                    yield from work(held)
                    held, size = [], 0
        if held:
            yield from work(held)
        give_back()

    return texts.mapInArrow(run, "_set binary, _all array<long>, _bands array<long>")


class _Members:
    """One block as arrays. A member is one item, or two: one of its place alone, one of its full set alone.

    Full sets of no member came through the filter by chance and are left out.
    """

    def __init__(self, items: pa.StructArray) -> None:
        self.keys = items.field("_set").to_pylist()
        full, placed = items.field("_all").is_valid(), items.field("_copies").is_valid()
        self.copies, self.near = items.field("_copies").fill_null(0).to_numpy(), items.field("_near").fill_null(0).to_numpy()
        if full.false_count or placed.false_count:
            place = {self.keys[k]: k for k in np.flatnonzero(placed.to_numpy(zero_copy_only=False)).tolist()}
            some = [k for k in np.flatnonzero(full.to_numpy(zero_copy_only=False)).tolist() if self.keys[k] in place]
            if len(some) != len(place):
                raise ValueError(f"{len(some)} full sets for {len(place)} members of a bucket")
            at = np.array([place[self.keys[k]] for k in some], dtype=np.int64)
            self.keys, self.copies, self.near = [self.keys[k] for k in some], self.copies[at], self.near[at]
            items = items.take(pa.array(some, pa.int64()))
        bands, grams = items.field("_bands"), items.field("_all")
        self.bands = bands.flatten().to_numpy().reshape(len(self.keys), -1)
        self.grams, self.at = grams.flatten().to_numpy(), grams.offsets.to_numpy() - grams.offsets[0].as_py()
        self.sizes = np.diff(self.at)


def overlaps(a: _Members, b: _Members, mask: np.ndarray) -> np.ndarray:
    """Common n-grams of the pairs in ``mask``; other cells are undefined."""
    if mask.sum() <= 8:
        out = np.zeros(mask.shape, dtype=np.int64)
        for i, j in zip(*np.nonzero(mask), strict=True):
            out[i, j] = len(np.intersect1d(a.grams[a.at[i] : a.at[i + 1]], b.grams[b.at[j] : b.at[j + 1]], assume_unique=True))
        return out
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    pick = lambda m, own: (np.concatenate([m.grams[m.at[i] : m.at[i + 1]] for i in own]), np.repeat(np.arange(len(own)), m.sizes[own]))
    (ga, oa), (gb, ob) = pick(a, rows), pick(b, cols)
    common = np.intersect1d(ga, gb)  # n-grams of one side only add nothing
    total = np.zeros((len(rows), len(cols)), dtype=np.float32)
    ia, ib = np.searchsorted(common, ga), np.searchsorted(common, gb)
    ina = (ia < len(common)) & (common[np.minimum(ia, len(common) - 1)] == ga) if len(common) else np.zeros(len(ga), dtype=bool)
    inb = (ib < len(common)) & (common[np.minimum(ib, len(common) - 1)] == gb) if len(common) else np.zeros(len(gb), dtype=bool)
    ia, oa, ib, ob = ia[ina], oa[ina], ib[inb], ob[inb]
    for low in range(0, len(common), 4096):
        width = min(4096, len(common) - low)
        x, y = np.zeros((len(rows), width), dtype=np.float32), np.zeros((len(cols), width), dtype=np.float32)
        m = (ia >= low) & (ia < low + width)
        x[oa[m], ia[m] - low] = 1
        m = (ib >= low) & (ib < low + width)
        y[ob[m], ib[m] - low] = 1
        total += x @ y.T
    out = np.zeros(mask.shape, dtype=np.int64)
    out[np.ix_(rows, cols)] = np.rint(total).astype(np.int64)
    return out


def linked(a: _Members, b: _Members, same: bool, band: int, threshold: float) -> np.ndarray:
    """Pairs of sets, met first in this band and not known to be linked, whose similarity reaches the threshold."""
    mask = ((a.near[:, None] != b.near[None, :]) | (a.near[:, None] == 0)) & (a.bands[:, band, None] == b.bands[None, :, band])
    if same:
        mask = np.triu(mask, 1)
    for k in range(band):
        mask &= a.bands[:, k, None] != b.bands[None, :, k]
    low, high = np.minimum(a.sizes[:, None], b.sizes[None, :]), np.maximum(a.sizes[:, None], b.sizes[None, :])
    mask &= low >= threshold * high - 1e-9
    if not mask.any():
        return mask
    both = overlaps(a, b, mask)
    return mask & (both >= threshold * (a.sizes[:, None] + b.sizes[None, :] - both) - 1e-9)


def _compare(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): links to add for set a, or with b an edge of a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, left, right, same = batch.column(0).to_numpy(), batch.column(1), batch.column(2), batch.column(3).to_pylist()
            for row in range(len(batch)):
                one = lambda c, row=row: _Members(c.slice(row, 1).flatten())
                a = one(left)
                b = a if same[row] else one(right)
                hit = linked(a, b, same[row], int(bands[row]), threshold)
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                for_a = np.bincount(i, weights=b.copies[j], minlength=len(a.keys))
                for_b = np.bincount(j, weights=a.copies[i], minlength=len(b.keys))
                counts = [(k, int(x)) for m, c in ((a, for_a), (b, for_b)) for k, x in zip(m.keys, c.tolist(), strict=True) if x]
                root: dict[bytes, bytes] = {}

                def find(x: bytes, root: dict = root) -> bytes:
                    while root.setdefault(x, x) != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                edges = []
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = find(a.keys[x]), find(b.keys[y])
                    if p != q:
                        root[p] = q
                        edges.append((a.keys[x], b.keys[y]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in counts] + [x for x, _ in edges], pa.binary()), pa.array([None] * len(counts) + [y for _, y in edges], pa.binary()), pa.array([n for _, n in counts] + [0] * len(edges), pa.int64())], names=["a", "b", "links"]
                )
        give_back()

    return blocks.mapInArrow(run, "a binary, b binary, links long")


def _close(hot: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(_set, _home, _copies): members of large buckets and, if they are close to it, the least of the sets that lead these buckets.

    Jaccard distance is a metric, so two sets within half the allowed distance of a third are linked to one another.
    """
    leader = hot.groupBy("_band", "_hash").agg(F.min("_set").alias("_leader"), F.count("*").alias("_members"))
    led = with_summary(hot, ["_band", "_hash"], stash(leader, "leaders"), "_members", hot.count(), inner=True)
    home = led.groupBy("_set").agg(F.min("_leader").alias("_home"), F.first("_copies").alias("_copies")).withColumn("_s", row_salt("_set"))
    home = stash(home, "home")
    leaders = home.select("_home", "_s").distinct().join(sets.select(F.col("_set").alias("_home"), F.col("_all").alias("_lead")), "_home")
    met = home.join(sets.select("_set", "_all"), "_set").join(leaders, ["_home", "_s"])
    both = F.size(F.array_intersect("_all", "_lead"))
    return met.filter(both >= (1 + threshold) / 2 * (F.size("_all") + F.size("_lead") - both)).select("_set", "_home", "_copies")


def _close_links(close: DataFrame) -> DataFrame:
    """(a, b, links) of the pairs of sets that are close to the same set: their counts, and an edge of each to that set."""
    met = group_lookup(close.withColumn("_s", row_salt("_set")), ["_home"], "_s", F.sum("_copies").alias("_all"))
    counts = met.filter("_all > _copies").select(F.col("_set").alias("a"), F.lit(None).cast("binary").alias("b"), (F.col("_all") - F.col("_copies")).alias("links"))
    return counts.unionAll(close.filter("_set <> _home").select(F.col("_set").alias("a"), F.col("_home").alias("b"), F.lit(0).cast("long").alias("links")))


def _classed(wide: DataFrame, file: str, at: str, doc_id: str, text: str, n: int, threshold: float, recall: float) -> DataFrame:
    """(_id, _file, _at, _best, _links): each row with the first row of its class (null: alone) and its number of links."""
    spark = wide.sparkSession
    bounded_batches(spark)
    bands, rows = bands_for(threshold, recall)
    own_texts = wide.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(file).alias("_file"), F.col(at).alias("_at"))
    signed = stash(_signed(own_texts, n, bands, rows), "signed")
    total = signed.count()
    some = signed.filter("_set IS NOT NULL AND _id IS NOT NULL")
    first = F.min(F.struct("_id", "_file", "_at")).alias("_rep")
    reps = stash(some.groupBy("_set").agg(first, F.count("*").alias("_copies"), F.first("_grams").alias("_grams"), F.first("_bands").alias("_bands")), "reps")

    # buckets of two and more; of those with the same members the first band's
    member = reps.select("_set", "_grams", "_copies", "_rep._file", "_rep._at", F.posexplode("_bands").alias("_band", "_hash"))
    mark = F.xxhash64("_set")
    buckets = member.groupBy("_band", "_hash").agg(F.count("*").alias("_n"), F.sum("_grams").alias("_weight"), F.bit_xor(mark).alias("_x"), F.sum(mark.bitwiseAND(F.lit((1 << 40) - 1))).alias("_y"))
    buckets = buckets.filter("_n >= 2").groupBy("_n", "_x", "_y").agg(F.min_by(F.struct("_band", "_hash", "_weight"), F.struct("_band", "_hash")).alias("_b")).select("_n", "_b.*")
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK_MEMBERS), F.ceil(F.col("_weight") / BLOCK_GRAMS)).cast("int")
    buckets = stash(buckets.select("_band", "_hash", "_n", blocks.alias("_blocks")), "buckets")
    maybe = stash(may_hold(member, ["_band", "_hash"], buckets, buckets.count()), "maybe")
    met = stash(with_summary(maybe, ["_band", "_hash"], buckets, "_n", maybe.count(), inner=True).drop("_n"), "members")

    # full sets of the representatives that met anyone, from their texts, which are found by place and do not shuffle
    large = F.col("_blocks") > 1
    near = marked(own_texts, "_file", "_at", marks(met, "_file", "_at", F.lit(True), large), total, 2, "_busy")
    hot_sets = stash(_full_sets(near.filter("_busy > 1").select("_text"), n, bands, rows), "sets")

    close = stash(_close(met.filter(large), hot_sets, threshold), "close")
    known_links = _close_links(close)
    near_to = close.select("_set", "_home", F.xxhash64("_home").alias("_near"))
    placed = stash(met.select("_band", "_hash", "_blocks", "_set", "_grams", "_copies").join(near_to, "_set", "left").withColumn("_near", F.coalesce("_near", F.lit(0).cast("long"))), "placed")
    item = F.struct("_set", "_copies", "_bands", "_all", "_near")
    # a set in small buckets only goes from its text straight to them: its bands say where, and a filter which of them are left
    alone = placed.filter("_blocks = 1").select("_band", "_hash", "_set", "_copies", "_near")
    few = buckets.filter("_blocks = 1")
    cold = _full_sets(near.filter("_busy = 1").select("_text"), n, bands, rows).select("_set", F.posexplode("_bands").alias("_band", "_hash"), "_bands", "_all")
    cold = may_hold(cold, ["_band", "_hash"], few, 4 * few.count())
    full = cold.unionByName(alone.select("_band", "_hash", "_set").join(hot_sets, "_set"))
    alone = alone.unionByName(full, allowMissingColumns=True).groupBy("_band", "_hash").agg(F.collect_list(item).alias("_items"), F.count("_copies").alias("_n")).filter("_n > 0")
    alone = alone.select(F.col("_band").cast("long"), "_items", F.lit(None).cast(alone.schema["_items"].dataType).alias("_other"), F.lit(True).alias("_same"))
    # large buckets: blocks by what their members are close to; blocks close to the same set are not compared
    hot = placed.filter("_blocks > 1")
    parts = hot.groupBy("_band", "_hash", "_home").agg(F.count("*").alias("_n"), F.sum("_grams").alias("_weight"))
    parts = parts.withColumn("_own", F.greatest(F.ceil(F.col("_n") / BLOCK_MEMBERS), F.ceil(F.col("_weight") / BLOCK_GRAMS)).cast("int"))
    bucket = Window.partitionBy("_band", "_hash")
    parts = parts.withColumns({"_end": F.sum("_own").over(bucket.orderBy(F.asc_nulls_first("_home"))).cast("int"), "_total": F.sum("_own").over(bucket).cast("int")})
    parts = stash(parts.withColumn("_until", F.when(F.col("_home").isNull(), F.lit(None).cast("int")).otherwise(F.col("_end"))), "parts")
    start = (F.col("_end") - F.col("_own")).alias("_start")
    hot = hot.withColumn("_h", F.coalesce(F.hex("_home"), F.lit("")))
    spans = parts.select("_band", "_hash", F.coalesce(F.hex("_home"), F.lit("")).alias("_h"), start, "_own", "_until", "_total", F.col("_n").alias("_members"))
    hot = with_summary(hot.select("_band", "_hash", "_h", "_set", "_copies", "_near"), ["_band", "_hash", "_h"], spans, "_members", placed.count(), inner=True)
    hot = hot.withColumn("_block", (F.col("_start") + F.pmod(F.xxhash64(F.lit(3), "_set"), F.col("_own"))).cast("int"))
    numbers = hot.select("_band", "_hash", "_block", F.coalesce("_until", "_block").alias("_from"), "_total").distinct().filter("_from < _total")
    pairs = stash(numbers.select("_band", "_hash", F.col("_block").alias("_i"), F.explode(F.sequence("_from", F.col("_total") - 1)).alias("_j")), "pairs")
    used = pairs.select("_band", "_hash", F.explode(F.array("_i", "_j")).alias("_block")).distinct()
    many = hot.select("_band", "_hash", "_block", "_set", "_copies", "_near").join(used, ["_band", "_hash", "_block"]).join(hot_sets.select("_set", "_bands", "_all"), "_set")
    many = stash(many.groupBy("_band", "_hash", "_block").agg(F.collect_list(item).alias("_items")), "blocks")
    left = pairs.join(many.select("_band", "_hash", F.col("_block").alias("_i"), "_items"), ["_band", "_hash", "_i"])
    right = many.select("_band", "_hash", F.col("_block").alias("_j"), F.col("_items").alias("_other"))
    both = left.join(right, ["_band", "_hash", "_j"]).select(F.col("_band").cast("long"), "_items", "_other", (F.col("_i") == F.col("_j")).alias("_same"))
    with batches_of(spark, 16):  # of pairs of blocks
        found = stash(_compare(alone.unionAll(both), threshold).unionAll(known_links), "found")
    release(buckets, maybe, met, hot_sets, close, placed, parts, pairs, many)

    classes = components(found.filter("b IS NOT NULL"))
    # a set that many blocks were compared with has a row for each of them: added up over salted keys first
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("_set"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_s")).agg(F.sum("links").alias("_links"))
    links = links.groupBy("_set").agg(F.sum("_links").alias("_links"))
    named = classes.join(reps.select(F.col("_set").alias("node"), "_rep"), "node")
    met_class = group_lookup(named.withColumn("_s", row_salt("node")), ["component"], "_s", F.min("_rep").alias("_class"))
    class_of = met_class.select(F.col("node").alias("_set"), "_class")
    known = reps.select("_set", "_rep", "_copies").join(links, "_set", "left").join(class_of, "_set", "left").filter("_copies > 1 OR _links IS NOT NULL")
    known = known.select("_set", F.coalesce("_class", "_rep").alias("_best"), (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"), "_copies")
    each = signed.select("_id", F.when(F.col("_id").isNotNull(), F.col("_set")).alias("_set"), "_file", "_at")
    return with_summary(each, ["_set"], stash(known, "known"), "_copies", total).select("_id", "_file", "_at", "_best", "_links")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, class_id (the least id of its class) and n_links."""
    out = _classed(*addressed(docs.select(doc_id, text)), doc_id, text, n, threshold, recall)
    return out.select(F.col("_id").alias(doc_id), F.coalesce("_best._id", "_id").alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each class one of those with the least id; unlinked ones all. No whole row shuffles."""
    wide, file, at = addressed(docs)
    rows = stash(_classed(wide, file, at, doc_id, text, n, threshold, recall), "classes")
    gone = rows.filter("_best IS NOT NULL AND (_best._file <> _file OR _best._at <> _at)")
    (lost,) = fresh(wide, "_lost")
    return marked(wide, file, at, marks(gone, "_file", "_at", F.lit(True)), rows.count(), 1, lost).filter(F.col(lost) == 0).select(*own(docs))
