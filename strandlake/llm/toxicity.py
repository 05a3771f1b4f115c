"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over the words of all documents.
2. Obfuscated tokens (letters mixed with digits or symbols, letters set apart by dots or spaces, letters repeated) are
   read as lattices: each character may stand for the letters it looks like, separators and repetitions may be dropped,
   and a word may end between letters set apart by spaces, and at separators and other marks. Viterbi decoding under the trigram model restores the words.
3. Features are the words of the text and the restored ones, with their beginnings, so that inflected and compounded
   forms count too. The features most typical of toxic training rows are chosen by the likelihood ratio statistic; a
   feature's value is the log of how often it occurs over how often a clean text of that length would hold it.
4. A logistic regression over them gives the score.

The language model covers all documents, and every whole text is scored. Only the classifier is fitted on a sample: at
most ``TRAIN_PER_CLASS`` labelled rows a class, by hash of the id. Scores use the text alone.

Defined cases: a null text is empty and gets the score of a text without any feature. Rows equal in id and text get
equal scores. Labels with null fields do not count; an id with several labels is toxic if one says so. Without labelled
rows of both classes the score is the share of toxic ones (0 without any). An empty table gives an empty result. Tokens
of any length are decoded, and very long texts are read whole. A token without any letter, or a spelled run without one,
is a number and not decoded. Columns of the input may have any names; one named as the score is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandlake.llm.store import bounded_batches, stash
from strandlake.llm.text import EDGE, LETTER, OTHER, SPACE, Hasher, char_class, chunks, code_points, give_back, mixed

#: Labelled rows that the classifier is fitted on, for each class; features it uses; least statistic of a feature.
TRAIN_PER_CLASS, FEATURES, LEAST_G2 = 6000, 512, 9.0
#: Symbols of the character model: 0 ends a word, 1 to 26 are a to z, the rest stand for all other letters.
SYMBOLS = 48
#: Characters up to which the worker remembers what a token decodes to (longer ones are decoded anew each time), and tokens it remembers.
REMEMBERED, KNOWN = 30, 50_000
BEGINNINGS = (4, 5, 6)
#: What characters may stand for (fixed values, common usage).
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c",
}
SEPARATORS = "._-*~'`^:/\\"
#: Look-alikes that are punctuation as well, and so may also stand between words or beside them.
MARKS = "!|(<+"
#: Costs in nats: a look-alike, a dropped separator, other symbol or repetition, a word end between spaced letters.
LOOK, DROP, STRAY, REPEAT, DOUBLE, BREAK = 0.7, 0.4, 1.5, 0.2, 3.0, 1.0


@lru_cache(1)
def _tables() -> dict[str, np.ndarray]:
    n = 1 << 16
    lower = np.arange(n, dtype=np.uint32)
    for c in range(n):
        if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1 and ord(x) < n:
            lower[c] = ord(x)
    symbol = np.zeros(n, dtype=np.int64)
    letters = np.flatnonzero(char_class()[:n] == LETTER)
    symbol[letters] = 27 + (letters * 8) % (SYMBOLS - 27)
    symbol[97:123] = np.arange(1, 27)
    look, separator = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    look[[ord(c) for c in LOOKS]] = True
    separator[[ord(c) for c in SEPARATORS]] = True
    return {"lower": lower, "symbol": symbol, "look": look, "separator": separator}


def _lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, their classes, and where texts start."""
    codes, firsts = code_points(texts)
    kind = char_class()[codes]
    return np.where(codes < 65536, _tables()["lower"][codes & 0xFFFF], codes), kind, firsts


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def trigram_counts(texts: list[str]) -> np.ndarray:
    codes, kind, _ = _lowered(texts)
    s = np.where(kind == LETTER, _tables()["symbol"][codes & 0xFFFF], 0)
    before = np.concatenate(([0], s[:-1]))
    before2 = np.where(before == 0, 0, np.concatenate(([0], before[:-1])))
    own = (s != 0) | (before != 0)
    return np.bincount(((before2 * SYMBOLS + before) * SYMBOLS + s)[own], minlength=SYMBOLS**3)


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), each order smoothed by the one below."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 2 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 2)
    return (-np.log(p3)).astype(np.float32)


def _joined(text: tuple | None) -> tuple | None:
    """A chain whose letters since the last joining are one string, so that long tokens take little memory."""
    out, node = [], text
    while node and len(node[1]) == 1:
        node, x = node
        out.append(x)
    return (node, "".join(reversed(out))) if len(out) > 1 else text


def decode(token: str, costs: np.ndarray | list, spaced: bool = False) -> str:
    """The likeliest words behind a token; ``spaced``: its characters stood apart, so words may end anywhere, else at marks."""
    symbol = _tables()["symbol"]
    # state: last two symbols and last letter -> (cost, text so far as a chain of the text before and a letter)
    now: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    none = (math.inf, None)
    for i, c in enumerate(token):
        options = [(x, int(symbol[ord(x) & 0xFFFF]), LOOK) for x in LOOKS.get(c, "")]
        if not options and c.isalpha():
            options = [(c, int(symbol[ord(c) & 0xFFFF]), 0.0)]
        run = i > 0 and token[i - 1] == c and (i > 1 and token[i - 2] == c or i + 1 < len(token) and token[i + 1] == c)
        again = REPEAT if run else DOUBLE
        drop = DROP if c in SEPARATORS else STRAY
        mark = not options or c in MARKS
        nxt: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for key, (cost, text) in now.items():
            a, b, last = key
            row = costs[a][b]
            for x, s, extra in options:
                other = cost + extra + float(row[s])
                if other < nxt.get((b, s, x), none)[0]:
                    nxt[b, s, x] = (other, (text, x))
                if x == last and cost + extra + again < nxt.get(key, none)[0]:
                    nxt[key] = (cost + extra + again, text)
                if spaced and b:
                    other = cost + extra + BREAK + float(row[0]) + float(costs[0][0][s])
                    if other < nxt.get((0, s, x), none)[0]:
                        nxt[0, s, x] = (other, ((text, " "), x))
            if mark:
                if not options and cost + drop < nxt.get(key, none)[0]:
                    nxt[key] = (cost + drop, text)
                if b or options:
                    other = cost + drop + (float(row[0]) if b else 0.0)
                    if other < nxt.get((0, 0, ""), none)[0]:
                        nxt[0, 0, ""] = (other, (text, " ") if b else text)
        now = nxt if i % 4096 != 4095 else {k: (cost, _joined(text)) for k, (cost, text) in nxt.items()}
    best = min(((cost + (float(costs[a][b][0]) if b else 0.0), text) for (a, b, _), (cost, text) in now.items()), key=lambda e: e[0], default=(0.0, None))[1]
    out = []
    while best:
        best, x = best
        out.append(x)
    return "".join(reversed(out)).strip()


def readings(token: str, costs: np.ndarray | list) -> list[str]:
    """The likeliest words, and those of each part between marks: a mark may set letters apart or join words."""
    parts = "".join(c if c.isalpha() or c in LOOKS else " " for c in token).split()
    whole = decode(token, costs)
    apart = " ".join(decode(p, costs) for p in parts) if len(parts) > 1 else whole
    return [whole] if apart == whole else [whole, apart]


def obfuscated(codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Numbers, starts and ends of tokens to decode, some with and without their ends, and (position, characters) of letters set apart by spaces."""
    t = _tables()
    low = codes & 0xFFFF
    letter = kind == LETTER
    look = t["look"][low] & ~letter & (codes < 65536)
    starts, ends = _runs((kind != SPACE) & (kind != EDGE))
    if not len(starts):
        return starts, starts, ends, []
    total = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    letters = total(letter)
    some = letters[ends] > letters[starts]
    where = np.flatnonzero(letter)
    first = np.where(some, where[np.minimum(letters[starts], max(len(where) - 1, 0))] if len(where) else starts, starts)
    last = np.where(some, where[np.maximum(letters[ends] - 1, 0)] if len(where) else starts, starts)
    # look-alikes before the first or after the last letter may be letters or decoration: each end is read both ways
    hard = look & (codes != 33)
    hards, looks = total(hard), total(look)
    lead, trail = np.flatnonzero(letter | look), np.flatnonzero(letter | hard)
    low_end = np.where(some, lead[np.minimum((letters + looks)[starts], len(lead) - 1)] if len(lead) else starts, starts)
    high_end = np.where(some, trail[np.maximum((letters + hards)[ends] - 1, 0)] + 1 if len(trail) else starts, starts)
    after, before = np.concatenate((letter[1:], [False])), np.concatenate(([False], letter[:-1]))
    apart = total(t["separator"][low] & (codes < 65536) & after & before)
    same = np.concatenate(([False], codes[1:] == codes[:-1])) & letter
    triple = total(same & np.concatenate(([False], same[:-1])))
    ways = [np.empty((0, 3), dtype=np.int64)]
    for begin in (low_end, first):
        for end in (high_end, last + 1):
            odd = (looks[end] > looks[begin]) | (apart[end] > apart[begin]) | (triple[end] > triple[begin])
            pick = some & odd & (end - begin >= 3)
            ways.append(np.stack((np.flatnonzero(pick), begin[pick], end[pick]), axis=1))
    spans = np.unique(np.concatenate(ways), axis=0)
    alone = (letters[ends] - letters[starts] == 1) & (first == starts) & (ends - last <= 2) & (hards[ends] == hards[starts])
    marked = (ends - starts == 1) | ((ends - starts == 2) & (kind[ends - 1] == OTHER) & ~hard[ends - 1])
    single = alone | (marked & look[starts])
    # letters set apart, the last with a mark at most; the NUL between texts parts them
    text_of = np.cumsum(kind == EDGE)[starts]
    spelled = []
    a, b = _runs(single)
    cut = np.flatnonzero(np.diff(text_of) != 0) + 1
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        inner = cut[np.searchsorted(cut, x, side="right") : np.searchsorted(cut, y, side="left")].tolist()
        for p, q in zip([x, *inner], [*inner, y], strict=True):
            if q - p >= 3:
                text = "".join(map(chr, codes[starts[p:q]].tolist()))
                if any(map(str.isalpha, text)):
                    spelled.append((int(starts[p]), text))
    return spans[:, 0], spans[:, 1], spans[:, 2], spelled


class Reader:
    """Feature hashes of texts, restored words included. Decoded tokens are remembered by the worker, up to a bound."""

    def __init__(self, costs: np.ndarray) -> None:
        self.nested, self.hasher = costs.tolist(), Hasher()
        self.known: dict[tuple[str, bool], Counter[int]] = {}

    def _features(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each feature of the words [a, b), and the index of its word."""
        found = [self.hasher.slices(codes, a, b)]
        whose = [np.arange(len(a))]
        for n in BEGINNINGS:
            longer = np.flatnonzero(b - a > n)
            found.append(self.hasher.slices(codes, a[longer], a[longer] + n) ^ np.uint64(0x5851F42D4C957F2D))
            whose.append(longer)
        return np.concatenate(found), np.concatenate(whose)

    def _counted(self, texts: list[str]) -> list[Counter[int]]:
        codes, kind, firsts = _lowered(texts)
        a, b = _runs(kind == LETTER)
        hashes, word = self._features(codes, a, b)
        out: list[Counter[int]] = [Counter() for _ in texts]
        for k, h in zip((np.searchsorted(firsts, a, side="right") - 1)[word].tolist(), hashes.tolist(), strict=True):
            out[k][h] += 1
        return out

    def _restored(self, keys: list[tuple[str, bool]]) -> list[Counter[int]]:
        """Features of what each token (spaced or not) decodes to, without those that its letters have as they stand."""
        new = [k for k in dict.fromkeys(keys) if k not in self.known]
        read = [[" ".join(t), decode(t, self.nested, True)] if spaced else [t, *readings(t, self.nested)] for t, spaced in new]
        counts = iter(self._counted([x for r in read for x in r]))
        fresh: dict[tuple[str, bool], Counter[int]] = {}
        for key, r in zip(new, read, strict=True):
            own, found = next(counts), Counter()
            for _ in r[1:]:
                found |= next(counts)
            fresh[key] = found - own
        out = [fresh[k] if k in fresh else self.known[k] for k in keys]
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known.update((k, f) for k, f in fresh.items() if len(k[0]) <= REMEMBERED)
        return out

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all features, the text of each, and the number of words of each text."""
        codes, kind, firsts = _lowered(texts)
        a, b = _runs(kind == LETTER)
        owner = np.searchsorted(firsts, a, side="right") - 1
        hashes, word = self._features(codes, a, b)
        number, begin, end, spelled = obfuscated(codes, kind)
        more, whose = [], []
        raw = codes.astype("<u4").tobytes()
        spans = [(raw[4 * p : 4 * q].decode("utf-32-le", "surrogatepass"), False) for p, q in zip(begin.tolist(), end.tolist(), strict=True)]
        found = self._restored(spans + [(token, True) for _, token in spelled])
        ways = zip(number.tolist(), begin.tolist(), found[: len(spans)], strict=True)
        for _, same in groupby(ways, key=lambda w: w[0]):  # what a token's ways to be read have in common counts once
            own: Counter[int] = Counter()
            for _, p, way in same:
                own |= way
            more += own.elements()
            whose += [p] * own.total()
        for (p, _), own in zip(spelled, found[len(spans) :], strict=True):
            more += own.elements()
            whose += [p] * own.total()
        extra = np.searchsorted(firsts, np.array(whose, dtype=np.int64), side="right") - 1
        return np.concatenate((hashes, np.array(more, dtype=np.uint64))), np.concatenate((owner[word], extra)), np.bincount(owner, minlength=len(texts))


@dataclass
class Model:
    costs: np.ndarray
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def __post_init__(self) -> None:
        self.order = np.argsort(self.features)
        self.sorted = self.features[self.order]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_reader"}

    def matrix(self, texts: list[str]) -> np.ndarray:
        """Values of each text's features, a length term and a constant."""
        if "_reader" not in self.__dict__:
            self._reader = Reader(self.costs)
        hashes, whose, words = self._reader.read(texts)
        n = len(self.features)
        out = np.zeros((len(texts), n + 2))
        if n:
            at = np.minimum(np.searchsorted(self.sorted, hashes), n - 1)
            hit = np.flatnonzero(self.sorted[at] == hashes)
            counts = np.bincount(whose[hit] * n + self.order[at[hit]], minlength=len(texts) * n).reshape(len(texts), n)
            r, c = np.nonzero(counts)
            out[r, c] = np.maximum(0.0, np.log(counts[r, c] / (words[r] * self.rates[c] + 0.3)))
        out[:, n] = np.log1p(words) / 5
        out[:, n + 1] = 1.0
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.matrix(texts) @ self.weights, -500, 500)))


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 15) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w, total = np.zeros(x.shape[1]), weight.sum()
    penalty = np.full(x.shape[1], ridge)
    penalty[-2:] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x / total + np.diag(penalty), x.T @ (weight * (p - y)) / total + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch, a few at a time, with the index of the first."""
    for low in range(0, len(batch), 512):
        texts = batch.column(column).slice(low, 512).to_pylist()
        for a, b in chunks(texts):
            yield low + a, texts[a:b]


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram costs from the words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for _, texts in _texts(batch, 0):
                total += trigram_counts(texts)
        give_back()
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()  # at most SYMBOLS ** 3 cells
    return trigram_costs(counts)


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, usable: Column) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of the sample, written; and how many labelled rows each class has."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(toxic).cast("int").alias("_y")).dropna().filter(usable).groupBy("_id").agg(F.max("_y").alias("_y"))
    known = stash(known, "labels")
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    few = lambda y: known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_PER_CLASS)
    ids = few(0).unionAll(few(1))
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(ids), "_id")
    return stash(own.select("t", "_y"), "training"), sizes


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", usable: Column | None = None) -> Model:
    """``usable``: a condition on ``_id`` that labels must meet to be learned from."""
    bounded_batches(docs.sparkSession)
    costs = language_model(docs, text)
    rows, sizes = training_rows(docs, labels, doc_id, text, toxic, F.lit(True) if usable is None else usable)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not (sizes.get(0) and sizes.get(1)):
        return Model(costs, weights=np.array([0.0, math.inf if share == 1 else -math.inf]))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(costs)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for low, texts in _texts(batch, 0):
                hashes, whose, words = reader.read(texts)
                label = y[low + whose]
                each, first = np.unique(mixed(hashes ^ mixed(whose.astype(np.uint64) + np.uint64(1))), return_index=True)
                key, back = np.unique(hashes, return_inverse=True)
                once = np.zeros(len(hashes), dtype=bool)
                once[first] = True
                add = lambda mask, back=back, n=len(key): np.bincount(back[mask], minlength=n)
                clean = int(words[y[low : low + len(texts)] == 0].sum())
                columns = [np.append(key.view(np.int64), 0), np.append(add(once & (label == 1)), 0), np.append(add(once & (label == 0)), 0), np.append(add(label == 0), clean)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "pos", "neg", "seen"])

    sums = stash(rows.mapInArrow(presence, "h long, pos long, neg long, seen long").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "seen")]), "features")
    got = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = got.get(1, 0), got.get(0, 0)
    if not (n1 and n0):
        return Model(costs, weights=np.array([0.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9))]))
    pos, neg = F.col("pos"), F.col("neg")
    part = lambda seen, row, col: F.when(seen > 0, seen * F.log(seen * (n1 + n0) / (row * col))).otherwise(0.0)
    both, none = pos + neg, n1 + n0 - pos - neg
    g2 = 2 * (part(pos, both, n1) + part(neg, both, n0) + part(n1 - pos, none, n1) + part(n0 - neg, none, n0))
    best = sums.filter((F.col("h") != 0) & (pos * n0 > neg * n1)).withColumn("g2", g2).filter(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "h").limit(FEATURES).collect()
    clean = sums.filter("h = 0").agg(F.sum("seen")).first()[0] or 0
    features = np.array([r["h"] for r in best], dtype=np.int64).view(np.uint64)
    rates = (np.array([r["seen"] for r in best], dtype=float) + 0.5) / (clean + 1)
    model = Model(costs, features, rates)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for low, texts in _texts(batch, 0):
                x = model.matrix(texts).astype(np.float32)
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([pa.array(y[low : low + len(texts)], pa.int32()), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(x, at, strict=True)], pa.list_(pa.float32()))], names=["y", "at", "x"])

    got_rows = rows.mapInArrow(values, "y int, at array<int>, x array<float>").toArrow()  # the bounded sample
    x, y = np.zeros((got_rows.num_rows, len(features) + 2)), got_rows["y"].to_numpy().astype(float)
    for k, (at, v) in enumerate(zip(got_rows["at"].to_pylist(), got_rows["x"].to_pylist(), strict=True)):
        x[k, at] = v
    weight = np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    model.weights = regression(x, y, weight / weight.mean())
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double ``name``: the score of each whole text. All columns pass through, but one of that name is replaced; nothing shuffles."""
    bounded_batches(docs.sparkSession)
    replaced = [c for c in docs.columns if c.lower() == name.lower()]
    if replaced and text in replaced:
        raise ValueError(f"the scores cannot replace the texts they are read from: {name}")
    docs = docs.drop(*replaced)
    at = docs.columns.index(text)
    names = [f"c{k}" for k in range(len(docs.columns))]  # plain ones on the way through Python
    schema = StructType([*docs.toDF(*names).schema.fields, StructField("s", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                texts = [t or "" for t in part.column(at).to_pylist()]
                found = [model.score(texts[a:b]) for a, b in chunks(texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(found))], names=[*names, "s"])
        give_back()

    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, name)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
