"""Language ID by prediction by partial matching over bytes, under frozen statistics.

Each language's context tree of orders 0 to 3 over raw bytes is kept as sorted arrays of the n-grams that its
training texts hold. A byte not seen in a context costs that context's escape (method C) and is coded one
order lower, down to the uniform order -1. As the statistics are frozen, a byte's code length depends
only on itself and the three before it. A slice's distinct 4-grams are found once, each language gives
their exact code lengths, and a text's code length is the sum over all of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pomona.llm.common import carried, filled, fold_of, shared_checkpoint, text_slices

#: Training documents for each language (expected number; a fixed hash of the id and text decides).
SAMPLE = 1500
#: Bytes of context, and the byte that stands before every text.
ORDER, BLANK = 3, 0x20
#: Entries of the tables by which distinct 4-grams are found without sorting.
DENSE = 1 << 24


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = filled(texts).cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _distinct(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes below `size`, and each code's place among them."""
    if size > DENSE:
        return np.unique(codes, return_inverse=True)
    place = np.zeros(size, np.int32)
    place[codes] = 1
    found = np.flatnonzero(place)
    place[found] = np.arange(len(found), dtype=np.int32)
    return found, place[codes]


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 4-grams (three bytes before, then the byte itself) as numbers, and each byte's place among them.

    Texts begin after blanks.
    """
    used, c = _distinct(np.r_[data, np.uint8(BLANK)], 256)
    k, c, blank = len(used), c[:-1], c[-1]
    context, starts, stops = np.zeros(len(data), np.int64), at[:-1], at[1:]
    for j in range(1, ORDER + 1):
        before = np.r_[np.full(j, blank, c.dtype), c][: len(c)]
        for i in range(j):  # the texts' first bytes
            first = (starts + i)[starts + i < stops]
            before[first] = blank
        context += before.astype(np.int64) * k ** (j - 1)
    contexts, context = _distinct(context, k**ORDER)
    codes, place = _distinct(context.astype(np.int64) * k + c, len(contexts) * k)
    of, last = contexts[codes // k], used[codes % k].astype(np.uint32)
    for j in range(ORDER):
        last |= used[of // k**j % k].astype(np.uint32) << np.uint32(8 * (j + 1))
    return last, place


def _suffix(codes: np.ndarray, length: int) -> np.ndarray:
    return codes if length == 4 else codes & np.uint32((1 << 8 * length) - 1)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted keys, and whether they are there."""
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return i, keys[i] == x


@dataclass
class ContextTree:
    """One language's statistics: for each order, the n-grams with counts, and the contexts with totals and kinds."""

    seen: list[tuple[np.ndarray, np.ndarray]]
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> ContextTree:
        """From 4-grams as `grams` gives them and their counts; at least one."""
        seen, nodes = [], []
        for k in range(ORDER + 1):
            keys, place = np.unique(_suffix(codes, k + 1), return_inverse=True)
            n = np.bincount(place, weights=counts, minlength=len(keys))
            above, place = np.unique(keys >> np.uint32(8), return_inverse=True)
            seen.append((keys, n))
            nodes.append((above, np.bincount(place, weights=n), np.bincount(place).astype(np.float64)))
        return cls(seen, nodes)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Exact code lengths of 4-grams' last bytes after their first three."""
        p = np.full(len(codes), 1 / 256)
        for k, ((keys, n), (above, total, kinds)) in enumerate(zip(self.seen, self.nodes)):
            gram = _suffix(codes, k + 1)
            i, hit = _find(keys, gram)
            j, known = _find(above, gram >> np.uint32(8))
            all_ = total[j] + kinds[j]
            p = np.where(hit, n[i] / all_, np.where(known, kinds[j] / all_, 1.0) * p)
        return -np.log2(p)


class LanguageModel:
    """Context trees by language; each is bounded by its sample of training documents."""

    def __init__(self, names: list[str], trees: list[ContextTree]):
        self.names, self.trees = names, trees

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Exact code lengths in bits, (texts, languages)."""
        data, at = _bytes(texts)
        out = np.zeros((len(at) - 1, len(self.names)))
        full = np.flatnonzero(np.diff(at))
        if len(full) and len(self.names):
            codes, place = grams(data, at)
            for i, tree in enumerate(self.trees):
                out[full, i] = np.add.reduceat(tree.bits(codes)[place], at[:-1][full])
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language with the shortest code (ties: the first by name), and its share of 2**-length over all."""
        bits, spoken = self.bits(texts), has_letter(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = bits.argmin(1)
        share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        return [self.names[b] if s else "und" for b, s in zip(best.tolist(), spoken.tolist())], np.where(spoken, share, 0.0)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text has a letter, in any script."""
    data, at = _bytes(texts)
    ascii_letter = np.zeros(256, np.int64)
    ascii_letter[97:123] = ascii_letter[65:91] = 1
    out = np.diff(np.r_[0, np.cumsum(ascii_letter[data])][at]) > 0
    for i in np.flatnonzero(~out & (np.diff(at) > 0)).tolist():
        out[i] = any(ch.isalpha() for ch in (texts[i].as_py() or ""))
    return out


def fit(docs: DataFrame, mark: Column) -> LanguageModel:
    """docs (raw, lang): about SAMPLE different rows of each language are counted; the 64-bit number `mark` decides which."""
    docs = docs.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return LanguageModel([], [])
    names = sorted(sizes)
    limits = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit(int(min(1.0, SAMPLE / sizes[x]) * (1 << 20))) for x in names)))
    sample = docs.withColumn("mark", mark).where(F.pmod("mark", F.lit(1 << 20)) < F.element_at(limits, F.col("lang")))
    sample = shared_checkpoint(sample.dropDuplicates(["mark", "lang"]).select("raw", "lang"))  # repeated rows count once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "raw"):
            data, at = _bytes(b.column("raw"))
            if not len(data):
                continue
            coded = b.column("lang").dictionary_encode()
            codes, place = grams(data, at)
            owner = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(at))
            for i, lang in enumerate(coded.dictionary.to_pylist()):
                n = np.bincount(place[owner == i], minlength=len(codes))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(codes[some].astype(np.int64)), pa.array(n[some])], names=["lang", "code", "n"])

    counted = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))

    def arrays(where: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("code")
        codes, n = t.column("code").to_numpy().astype("<u4"), t.column("n").to_numpy().astype("<i8")
        return pa.table({"lang": [where[0].as_py()], "codes": pa.array([codes.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    # one row for each language, with the 4-grams of its sample
    rows = counted.groupBy("lang").applyInArrow(arrays, "lang string, codes binary, n binary").orderBy("lang").collect()
    trees = {r["lang"]: ContextTree.of(np.frombuffer(r["codes"], "<u4"), np.frombuffer(r["n"], "<i8")) for r in rows}
    known = [x for x in names if x in trees]
    return LanguageModel(known, [trees[x] for x in known])


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 4, held: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: key, held_out, lang_pred, score (0 to 1), and the columns `carry` as they are.

    Languages are learnt from rows with a non-null `lang` whose crc32(key as text) mod `fold` is not `held`.
    Defined cases: a null text, and one without a letter in any script, is `und` with score 0; so is
    every text if there is nothing to learn from; null keys and repeated rows are kept (repeated ones are
    learnt from once); texts of any length are scored whole; an empty table gives an empty result; other
    columns are ignored. Any number of languages is learnt; the model's size is bounded by theirs.
    """
    src = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("raw"), F.col(lang).cast("string").alias("lang"), (fold_of(F.col(key), fold) == held).alias("held_out"), *carried(carry))
    more = src.columns[4:]
    model = fit(src.where("not held_out").select("doc_id", "raw", "lang"), F.xxhash64("doc_id", "raw"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "raw"):
            names, score = sent.value.predict(b.column("raw"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score), *(b.column(c) for c in more)], names=["doc_id", "held_out", "lang_pred", "score", *more])

    fields = "".join(f", {c} {t}" for c, t in src.dtypes if c in more)
    out = src.select("doc_id", "held_out", "raw", *more).mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double{fields}")
    return out.select(F.col("doc_id").alias(key), "held_out", "lang_pred", "score", *(F.col(c).alias(name) for c, name in zip(more, carry)))
