"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learnt first: words and word beginnings whose share of labelled toxic documents is far above
that of the others. The dense features are lexicon counts, densities and weights, hits near a second
person, capitals, punctuation, obfuscation and repetition rates, and lengths. Boosted trees of depth 3 are fitted
to the logistic loss on part of a bounded sample, and pooled adjacent violators calibrate on the rest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pomona.llm.common import carried, filled, fold_of, shared_checkpoint, text_slices, words

#: Labelled documents that the classifier is fitted on at most (a fixed hash of the id decides).
SAMPLE = 12_000
#: Most lexicon entries, least toxic documents that hold one, least log odds and z score. Entries rank by toxic documents
#: times log odds: a z score alone would favour frequent, vague ones.
LEXICON, LEAST_DF, LEAST_ODDS, LEAST_Z = 800, 5, 3.0, 3.5
ROUNDS, DEPTH, RATE, BINS = 80, 3, 0.15, 32
NEAR = 4
#: Second-person pronouns in four languages.
SECOND_PERSON = frozenset(b"you your yours yourself u ya du dich dir dein deine deinen ihr euch tu toi te ton ta tes vous votre vos usted ustedes ti tuyo tuya vosotros".split())
_STRIP = b" .,;:!?\"'()[]{}<>*_-~#$%&|/\\+="
_LEET = bytes.maketrans(b"01345@$7", b"oieasast")
FEATURES = ("hits", "density", "weight", "weight_density", "top", "distinct_hits", "near_you", "you_rate", "capital_rate", "shout_rate", "punct_rate", "mark_rate", "obfuscated_rate", "repeat_rate", "log_words", "word_length", "digit_rate", "high_rate")


def units(word: bytes) -> tuple[bytes, ...]:
    """Lexicon entries that a lower-cased word can match: itself without marks and look-alikes, and its beginnings."""
    w = word.strip(_STRIP).translate(_LEET, b"*_-.'")
    return (w, b"^" + w[:4], b"^" + w[:5], b"^" + w[:6]) if len(w) > 4 else (w,)


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CAPITAL, _DIGIT, _HIGH = _lut(bytes(range(65, 91))), _lut(b"0123456789"), _lut(bytes(range(128, 256)))
_PUNCT, _MARK = _lut(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), _lut(b"!?")
_LOWER = _lut(bytes(range(97, 123)))


def dense(texts: pa.Array, lexicon: dict[bytes, float]) -> np.ndarray:
    """Features of each text, (texts, FEATURES)."""
    texts = filled(texts)
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    offsets, ids, distinct = words(texts)
    n_words = np.diff(offsets)
    values = distinct.to_pylist()
    weight, you, odd = np.zeros(len(values)), np.zeros(len(values), bool), np.zeros(len(values), bool)
    length = np.fromiter(map(len, values), np.int64, len(values))
    get = lexicon.get
    for i, w in enumerate(values):
        u = units(w)
        weight[i] = max(get(x, 0.0) for x in u)
        you[i] = u[0] in SECOND_PERSON
        inner = w.strip(_STRIP)
        odd[i] = not inner.isalpha() and inner.isascii() and any(97 <= c <= 122 for c in inner) and any(c in b"0134578@$*!_" for c in inner[1:])
    owner = np.repeat(np.arange(n), n_words)
    per = lambda x: np.bincount(owner, weights=x, minlength=n)
    hit = weight[ids] > 0
    many = np.maximum(n_words, 1)
    out[:, 0], out[:, 2] = per(hit), per(weight[ids])
    out[:, 1], out[:, 3] = per(hit) / many, per(weight[ids]) / many
    np.maximum.at(out[:, 4], owner[hit], weight[ids][hit])
    pairs = np.unique(owner[hit] * (len(values) + 1) + ids[hit])
    out[:, 5] = np.bincount(pairs // (len(values) + 1), minlength=n)
    at_hit, at_you = np.flatnonzero(hit), np.flatnonzero(you[ids])
    if len(at_hit) and len(at_you):
        j = np.searchsorted(at_you, at_hit)
        near = np.zeros(len(at_hit), bool)
        for k in (np.maximum(j - 1, 0), np.minimum(j, len(at_you) - 1)):
            near |= (np.abs(at_you[k] - at_hit) <= NEAR) & (owner[at_you[k]] == owner[at_hit])
        out[:, 6] = np.bincount(owner[at_hit[near]], minlength=n)
    out[:, 7], out[:, 12] = per(you[ids]) / many, per(odd[ids]) / many
    out[:, 14], out[:, 15] = np.log1p(n_words), per(length[ids]) / many
    raw = texts.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    size, full = np.maximum(np.diff(at), 1), np.flatnonzero(np.diff(at))

    def share(mask: np.ndarray) -> np.ndarray:
        part = np.zeros(n)
        if len(full):
            part[full] = np.add.reduceat(mask, at[:-1][full], dtype=np.int64)
        return part / size

    capital, lower = _CAPITAL[data], _LOWER[data]
    out[:, 8] = share(capital) / np.maximum(share(capital) + share(lower), 1e-9)
    inside = np.ones(len(data), bool)  # a text's first byte has nothing before it
    inside[at[:-1][full]] = False
    if len(data):
        out[:, 9] = share(inside & np.r_[False, capital[1:] & capital[:-1]])
        out[:, 13] = share(inside & np.r_[False, data[1:] == data[:-1]])
    out[:, 10], out[:, 11] = share(_PUNCT[data]), share(_MARK[data])
    out[:, 16], out[:, 17] = share(_DIGIT[data]), share(_HIGH[data])
    return out


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


@dataclass
class Boosted:
    """Trees of one depth, as arrays; node i's children are 2i + 1 and 2i + 2."""

    prior: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a trace of the uncalibrated one keeps an order inside its steps."""
        p = 1 / (1 + np.exp(-self.raw(x)))  # raw is far from overflow, or -inf without labels
        if self.steps is None:
            return p
        return np.clip(0.98 * np.interp(p, *self.steps) + 0.02 * p, 0, 1)


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Histogram boosting for the logistic loss, level by level."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(rate / (1 - rate))))
    edges = _edges(x)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    score, inner = np.full(len(x), model.prior), 2**DEPTH - 1
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p) + 1e-6
        node, feature, cut, at = np.zeros(len(x), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (node - first) * BINS + binned[:, f]
                gs = np.bincount(cell, weights=g, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(cell, weights=h, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = gain[:, : len(e)]
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                for w in np.flatnonzero(top > best):
                    best[w], feature[first + w], cut[first + w], at[first + w] = top[w], f, e[b[w]], b[w]
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > at[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=2**DEPTH), np.bincount(leaf, weights=h, minlength=2**DEPTH)
        values = -RATE * gs / (hs + 1)
        score += values[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(values)
    return model


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: the knots of a non-decreasing function of p."""
    order = np.argsort(p, kind="stable")
    stack: list[list[float]] = []  # sum, weight, first p, last p
    for a, b in zip(p[order].tolist(), y[order].tolist()):
        stack.append([b, 1.0, a, a])
        while len(stack) > 1 and stack[-2][0] / stack[-2][1] >= stack[-1][0] / stack[-1][1]:
            s, w, _, last = stack.pop()
            stack[-1][0] += s
            stack[-1][1] += w
            stack[-1][3] = last
    xs = np.array([v for s in stack for v in (s[2], s[3])])
    # a little smoothing keeps a pure block from claiming certainty
    ys = np.array([(s[0] + 0.02) / (s[1] + 0.04) for s in stack for _ in range(2)])
    return xs, np.maximum.accumulate(ys)


def _lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Log odds of the entries that mark labelled toxic documents; at most LEXICON of them."""
    totals = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["t"], totals["n"] - totals["t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {0: Counter(), 1: Counter()}
        for b in text_slices(batches, "raw", 4 << 20):
            offsets, ids, distinct = words(b.column("raw"))
            entries = [units(w) for w in distinct.to_pylist()]
            for y, a, z in zip(b.column("toxic").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                found[y].update({u for i in set(ids[a:z].tolist()) for u in entries[i]})
        keys = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], names=["entry", "t", "c"])

    df = sample.select("raw", "toxic").mapInArrow(run, "entry binary, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    df = df.where(F.length("entry") > 2).where(F.col("t") >= LEAST_DF).withColumn("odds", odds).withColumn("z", z).where((F.col("odds") > LEAST_ODDS) & (F.col("z") > LEAST_Z))
    return {bytes(r["entry"]): float(r["odds"]) for r in df.orderBy(F.desc(F.col("t") * F.col("odds")), "entry").limit(LEXICON).collect()}


@dataclass
class Toxicity:
    lexicon: dict[bytes, float]
    trees: Boosted

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.trees.score(dense(texts, self.lexicon))


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None) -> Toxicity:
    """docs (doc_id, raw) and labels (doc_id, toxic); only labelled documents that `training` allows are learnt from.

    At most SAMPLE labels are learnt from, whatever repeats: equal labels count once, and of documents that share
    an id one stands for all.
    """
    labels = labels.where("toxic in (0, 1) and doc_id is not null").where(F.lit(True) if training is None else training)
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = labels.count()
    if n > SAMPLE:  # a little more than needed by hash, then exactly SAMPLE
        labels = labels.withColumn("draw", F.xxhash64("doc_id")).where(F.pmod("draw", F.lit(1 << 20)) < int(1.2 * SAMPLE / n * (1 << 20)))
        labels = labels.orderBy("draw", "doc_id", "toxic").limit(SAMPLE).drop("draw")
    found = docs.join(F.broadcast(labels), "doc_id")
    sample = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("raw").alias("draw"), "raw")).alias("x"))
    sample = shared_checkpoint(sample.select("doc_id", F.col("x.raw").alias("raw"), "toxic"))
    lexicon = _lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "raw", 4 << 20):
            x = dense(b.column("raw"), lexicon)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("part"), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["toxic", "part", "x"])

    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)).cast("int").alias("part")
    rows = sample.select("raw", "toxic", part).mapInArrow(run, "toxic int, part int, x array<double>").toPandas()
    if not len(rows):
        return Toxicity(lexicon, Boosted(-np.inf))
    x, y, part = np.stack(rows["x"]), rows["toxic"].to_numpy(float), rows["part"].to_numpy()
    order = np.lexsort([*x.T, y])  # the same model whatever the order of rows
    x, y, part = x[order], y[order], part[order]
    if len(set(y)) < 2 or len(set(y[part > 0])) < 2:
        return Toxicity(lexicon, Boosted(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))))
    trees = boost(x[part > 0], y[part > 0])
    if (held := part == 0).any():
        trees.steps = isotonic(1 / (1 + np.exp(-trees.raw(x[held]))), y[held])
    return Toxicity(lexicon, trees)


def score_toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 5, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: key, held_out, score (0 to 1), predicted (score >= 0.5), and the columns `carry` as they are.

    Labels are learnt from rows whose crc32(key as text) mod `fold` is not 0.
    Defined cases: null text is the empty text and is scored too; null keys and repeated rows are kept;
    without any labelled rows every score is 0; equal labels of an id count once, contradicting ones
    both, and of documents that share an id one is learnt from; an empty table gives an empty result; other columns are ignored.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("raw"), *carried(carry))
    model = fit(docs, labels.select(F.col(key).alias("doc_id"), "toxic"), fold_of(F.col("doc_id"), fold) != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "raw", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(b.column("raw"))), *(b.column(c) for c in b.schema.names[3:])], names=["doc_id", "held_out", "score", *b.schema.names[3:]])

    more = docs.columns[2:]
    fields = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c in more)
    out = docs.select("doc_id", (fold_of(F.col("doc_id"), fold) == 0).alias("held_out"), "raw", *more).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double" + (", " + fields if more else ""))
    return out.select(F.col("doc_id").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(F.col(c).alias(name) for c, name in zip(more, carry)))
