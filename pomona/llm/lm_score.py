"""Language-model scores of texts under a trigram model of the corpus, kept in Elias-Fano tries.

A word's probability after two words is its discounted frequency there plus what the discount leaves
times its probability after one word, which is built likewise on its add-one frequency in the corpus:
    p1(w) = (c(w) + 1) / (N + V + 1)
    p2(w | v) = (c(v w) + K2 p1(w)) / (c(v) + K2)
    p3(w | u v) = (c(u v w) + K3 p2(w | v)) / (c(u v) + K3)
Tries hold the discounted probabilities and the back-off weights of contexts of two words, quantised to one byte.

Nothing of the model is sent to the driver, and nothing is broadcast but the hot words, whose number is bounded:
1. Words are counted; this gives the totals and the hot words with exact counts.
2. Texts are dealt into blocks of bounded size. A block sends its distinct trigrams, with their training
   counts, to shards by their middle word, as sorted binary runs. A hot word's trigrams are dealt by it and the word
   before, and its pairs by it and the word after.
3. A shard sums the counts of all blocks, builds its trie, and answers each block's run in the run's order
   with exact word counts, quantised probabilities and weights.
4. A block meets its answers and scores its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pomona.llm.common import fold_of, hash_bytes, mix, pack_arrays, pack_blocks, shared_checkpoint, text_slices, trim, unpack_arrays, unpack_block, words
from pomona.llm.ef_trie import Trie, restore

#: Tokens in a block and in a shard.
BLOCK_TOKENS, SHARD_TOKENS = 1_200_000, 1_200_000
#: A word is hot if it makes up 1/HOT_PART of a shard, but no more than the HOT_WORDS most frequent ones can be.
HOT_PART, HOT_WORDS = 8, 1 << 20
#: The discounts: counts that a context gives to the shorter one.
K2, K3 = 100.0, 4.0
#: Hashes of the end and the start of a text; words' hashes are larger.
END, START = 0, 1
_32 = np.uint64(0xFFFFFFFF)


def _hashes(distinct: pa.Array) -> np.ndarray:
    h = hash_bytes(distinct)
    return np.where(h < 2, h + np.uint64(2), h)


def _count(docs: DataFrame) -> DataFrame:
    """word, c: training counts of different words, of the start and the end; n: all tokens, on the end's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "raw", 12 << 20):
            offsets, ids, distinct = words(b.column("raw"))
            size = np.diff(offsets)
            train = ~b.column("held_out").to_numpy(zero_copy_only=False)
            c = np.bincount(ids, weights=np.repeat(train, size), minlength=len(distinct)).astype(np.int64)
            some = np.flatnonzero(c)
            h = np.r_[_hashes(distinct)[some], np.array([END, START], np.uint64)]
            n = np.zeros(len(h), np.int64)
            n[-2] = len(ids) + len(size)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.r_[c[some], [int(train.sum())] * 2]), pa.array(n)], names=["word", "c", "n"])

    return docs.select("raw", "held_out").mapInArrow(run, "word long, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


#: A run's trigrams (middle words, their contexts; words before, their successors; successors, counts) and pairs of hot words.
TRIGRAMS, PAIRS = "8s4s4s", "8s4s"


def _starts(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    a = np.sort(a)
    return a[_starts(a)]


def _numbered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and each value's place among them."""
    order = np.argsort(a)
    a = a[order]
    new = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], place


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[starts, n])


class Hot:
    """Hot words' sorted hashes and counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    def of(self, h: np.ndarray) -> np.ndarray:
        """The counts of hashes, -1 where a word is not hot."""
        if not len(self.words):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[i] == h, self.counts[i], -1)


class Events:
    """A block's texts as trigrams (u, v, w), one for each token w, and their distinct ones in the order of the shards.

    Words are numbered by shard and hash, the hot ones last; so whatever the order of the texts, a block's
    distinct trigrams stand in one order: by v, u and w for the trigrams, by v and w's symbol for the pairs.
    """

    def __init__(self, texts: pa.Array, train: np.ndarray, hot: Hot, shards: int):
        offsets, ids, distinct = words(texts)
        size, v = np.diff(offsets), len(distinct)
        h = np.r_[_hashes(distinct), np.array([END, START], np.uint64)]
        hot_count = hot.of(h)
        place = np.where(hot_count >= 0, shards, (mix(h) % np.uint64(shards)).astype(np.int64))
        order = np.lexsort((h, place))
        number = np.empty(v + 2, np.int64)
        number[order] = np.arange(v + 2)
        self.hashes, self.place, self.hot_count = h[order], place[order], hot_count[order]
        self.cold = int((self.place < shards).sum())  # words before this one are not hot
        self.symbols = (self.hashes & _32).astype(np.uint32)
        n = len(ids) + len(size)
        begin = offsets[:-1] + np.arange(len(size))
        w = np.full(n, number[v])
        inner = np.ones(n, bool)
        inner[begin + size] = False
        w[inner] = number[ids]
        self.end, start = int(number[v]), number[v + 1]
        mid = np.r_[start, w[:-1]]
        mid[begin] = start
        u = np.r_[start, mid[:-1]]
        u[begin] = start
        self.w, self.owner = w, np.repeat(np.arange(len(size)), size + 1)
        self.mid = mid
        many, mine = v + 2, train[self.owner]
        if many < 1 << 21:  # three words fit one number
            triples, self.triple_of = _numbered((mid * many + u) * many + w)
            self.contexts, of = triples // many, np.cumsum(np.r_[True, np.diff(triples // many) > 0]) - 1
            self.contexts = self.contexts[_starts(self.contexts)]
            self.context_of, triples = of[self.triple_of], of * many + triples % many
        else:
            self.contexts, self.context_of = _numbered(mid * many + u)
            triples, self.triple_of = _numbered(self.context_of * many + w)
        pairs, self.pair_of = _numbered(mid << 32 | self.symbols[w])
        self.counts = np.bincount(self.triple_of, weights=mine, minlength=len(triples)).astype(np.int64)
        self.pair_counts = np.bincount(self.pair_of, weights=mine, minlength=len(pairs)).astype(np.int64)
        self.t_context, self.t_w = triples // many, triples % many
        self.c_mid, self.c_u = self.contexts // many, self.contexts % many
        self.p_mid, self.p_symbol = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.uint32)
        # hot words' contexts and pairs get places of their own
        self.c_place, self.p_place = self.place[self.c_mid], self.place[self.p_mid]
        c, p = np.flatnonzero(self.c_mid >= self.cold), np.flatnonzero(self.p_mid >= self.cold)
        mixed = lambda x, y: (mix(self.hashes[x] ^ mix(y)) % np.uint64(shards)).astype(np.int64)
        self.c_place[c] = mixed(self.c_mid[c], self.hashes[self.c_u[c]])
        self.p_place[p] = mixed(self.p_mid[p], self.p_symbol[p].astype(np.uint64))
        self.t_place = self.c_place[self.t_context]
        # cold trigrams and pairs are in the order of places already
        self.hot_t = np.flatnonzero(self.c_mid[self.t_context] >= self.cold)
        self.hot_t = self.hot_t[np.argsort(self.t_place[self.hot_t], kind="stable")]
        self.hot_p = p[np.argsort(self.p_place[p], kind="stable")]
        self.shards = shards

    def sections(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard that is asked: its cold trigrams, hot trigrams, and hot pairs, as indices."""
        cold_end = len(self.t_place) - len(self.hot_t)
        at = np.arange(self.shards + 1)
        cold = np.searchsorted(self.t_place[:cold_end], at)
        hot = np.searchsorted(self.t_place[self.hot_t], at)
        pairs = np.searchsorted(self.p_place[self.hot_p], at)
        for s in np.flatnonzero((np.diff(cold) > 0) | (np.diff(hot) > 0) | (np.diff(pairs) > 0)).tolist():
            yield s, np.arange(cold[s], cold[s + 1]), self.hot_t[hot[s] : hot[s + 1]], self.hot_p[pairs[s] : pairs[s + 1]]

    def _trigrams(self, t: np.ndarray) -> bytes:
        c = self.t_context[t]
        first = _starts(c)
        nodes = c[first]
        mids = self.c_mid[nodes]
        top = _starts(mids)
        return pack_arrays(self.hashes[mids[top]], _lengths(top, len(nodes)), self.symbols[self.c_u[nodes]], _lengths(first, len(t)), self.symbols[self.t_w[t]], self.counts[t])

    def runs(self) -> Iterator[tuple[int, bytes]]:
        for s, cold, hot, pairs in self.sections():
            mids = self.p_mid[pairs]
            top = _starts(mids)
            parts = [self._trigrams(cold), self._trigrams(hot), pack_arrays(self.hashes[mids[top]], _lengths(top, len(pairs)), self.p_symbol[pairs], self.pair_counts[pairs])]
            yield s, np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)

    def answered(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of words, back-off weights of contexts, discounted probabilities of trigrams and of pairs."""
        counts, weights = np.maximum(self.hot_count, 0), np.ones(len(self.contexts))
        q3, q2 = np.zeros(len(self.counts)), np.zeros(len(self.p_mid))
        pair_at = np.searchsorted(self.p_mid, np.arange(len(self.hashes) + 1))
        for s, cold, hot, pairs in self.sections():
            n, w_cold, t_cold, p_cold, w_hot, t_hot, p_hot = unpack_arrays(answers[s], "s111111")
            for t, w, q in ((cold, w_cold, t_cold), (hot, w_hot, t_hot)):
                nodes = self.t_context[t][_starts(self.t_context[t])]
                weights[nodes], q3[t] = restore(w), restore(q)
                if t is cold and len(t):
                    mids = self.c_mid[nodes][_starts(self.c_mid[nodes])]
                    counts[mids] = n
                    q2[pair_at[mids[0]] : pair_at[mids[-1] + 1]] = restore(p_cold)
            q2[pairs] = restore(p_hot)
        return counts, weights, q3, q2


class _Asked:
    """A run's trigrams or pairs, spelled out."""

    def __init__(self, trigrams: bytes):
        self.mids, per_mid, self.before, per_node, self.after, self.count = unpack_arrays(trigrams, TRIGRAMS)
        self.per_node = per_node
        self.node_mid = np.repeat(np.arange(len(self.mids), dtype=np.int32), per_mid)
        self.node = np.repeat(np.arange(len(self.before), dtype=np.int32), per_node)
        self.mid = np.repeat(self.node_mid, per_node)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts, without those of count 0."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    some = c > 0
    k, c = k[some], c[some]
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = _starts(k)
    return k[first], (np.add.reduceat(c, first) if len(first) else c)


def answer(runs: list[bytes], hot: Hot, k2: float = K2, k3: float = K3) -> list[bytes]:
    """The shard's trie, asked with each run."""
    read = []
    for r in runs:
        a, b, c = np.frombuffer(r, np.int64, 3).tolist()
        r = r[24:]
        read.append((_Asked(r[:a]), _Asked(r[a : a + b]), unpack_arrays(r[a + b :], PAIRS)))
    contexts = _distinct(np.concatenate([h for cold, warm, pairs in read for h in (cold.mids, warm.mids, pairs[0])]))
    number = lambda h: np.searchsorted(contexts, h)
    pair_keys, pair_counts, keys, key_counts = [], [], [], []
    for cold, warm, (mids, per, symbols, count) in read:
        pair_keys += [number(cold.mids)[cold.mid].astype(np.uint64) << np.uint64(32) | cold.after, np.repeat(number(mids), per).astype(np.uint64) << np.uint64(32) | symbols]
        pair_counts += [cold.count, count]
        for t in (cold, warm):
            keys.append(number(t.mids)[t.node_mid].astype(np.uint64) << np.uint64(32) | t.before)
            key_counts.append(t)
    pairs = _summed(pair_keys, pair_counts)
    del pair_keys, pair_counts
    nodes = _distinct(np.concatenate(keys))
    triples = _summed([np.searchsorted(nodes, k)[t.node].astype(np.uint64) << np.uint64(32) | t.after for k, t in zip(keys, key_counts)], [t.count for t in key_counts])
    del keys, key_counts
    split = lambda k: ((k >> np.uint64(32)).astype(np.int64), (k & _32).astype(np.uint32))
    of, symbol = split(pairs[0])
    counts = hot.of(contexts)
    counts = np.where(counts >= 0, counts, np.bincount(of, weights=pairs[1], minlength=len(contexts)).astype(np.int64))
    node, after = split(triples[0])
    mid, before = split(nodes[node])
    trie = Trie(contexts, counts, (of, symbol, pairs[1]), (mid, before, after, triples[1]), k2, k3)
    out = []
    for cold, warm, (mids, per, symbols, _) in read:
        parts = []
        for t in (cold, warm):
            mid = trie.context(t.mids)
            place = trie.longer.find(mid, t.before, np.bincount(t.node_mid, minlength=len(t.mids)))
            weight = np.where(place >= 0, trie.longer.code(place), 0).astype(np.uint8)  # an unseen context leaves all to the shorter one
            parts += [weight, trie.after.code(trie.after.find(place, t.after, t.per_node))]
            if t is cold:
                asked = _distinct(t.mid.astype(np.int64) << 32 | t.after.astype(np.int64))
                of = asked >> 32
                parts += [trie.successors.code(trie.successors.find(mid, asked & 0xFFFFFFFF, np.bincount(of, minlength=len(t.mids))))]
        parts.append(trie.successors.code(trie.successors.find(trie.context(mids), symbols, per)))
        out.append(pack_arrays(trie.counts[trie.context(cold.mids)], *parts))
    return out


def score_block(events: Events, docs: int, answers: dict[int, bytes], ends: int, tokens: int, distinct: int, k2: float = K2):
    """n_tokens, n_known, base score, score for each text."""
    counts, weights, q3, q2 = events.answered(answers)
    counts[events.end] = ends
    p1 = (counts + 1) / (tokens + distinct + 1)
    back = k2 / (counts + k2)
    w, owner = events.w, events.owner
    p = q2[events.pair_of] + back[events.mid] * p1[w]
    p = q3[events.triple_of] + weights[events.context_of] * p
    total = lambda x: np.bincount(owner, weights=x, minlength=docs)
    known = counts > 0
    return np.bincount(owner, minlength=docs), total(known[w]).astype(np.int64), total(np.log10(p1)[w]), total(np.log10(p))


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 7, held: int = 2) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32(key as text) mod `fold` is not `held`. Words are hashed to 64 bits,
    and to 32 inside a context.
    Defined cases: null text is the empty text, which is its end alone; null keys and repeated rows are
    kept and counted; an unseen word has the add-one frequency of count 0; without training rows every
    score is 0; texts of any length are scored whole; an empty table gives an empty result; other
    columns are ignored.
    """
    docs = df.select(F.col(key).alias("doc_key"), (fold_of(F.col(key), fold) == held).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("raw"))
    kind = dict(docs.dtypes)["doc_key"]
    counted = shared_checkpoint(_count(docs))
    word = F.col("word") != START
    sums = counted.agg(F.sum(F.when(word, F.col("c"))).alias("c"), F.sum("n").alias("n"), F.count(F.when(word & (F.col("c") > 0), 1)).alias("v"), F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    tokens, everything, distinct, ends = sums["c"] or 0, sums["n"] or 0, sums["v"], sums["ends"] or 0
    # at most HOT_WORDS words, and the start, can have so large a part of all tokens
    heat = max(1, SHARD_TOKENS // HOT_PART, -(-tokens // HOT_WORDS))
    rows = counted.where((F.col("c") >= heat) & (F.col("word") != END)).select("word", "c").toArrow()
    hot = Hot(rows.column("word").to_numpy().view(np.uint64), rows.column("c").to_numpy())
    sent = df.sparkSession.sparkContext.broadcast(hot)
    blocks, shards = max(1, -(-everything // BLOCK_TOKENS)), max(1, -(-everything // SHARD_TOKENS))
    packed = pack_blocks(docs, blocks)

    def events(t: pa.Table) -> tuple[Events, pa.Table]:
        texts = unpack_block(t)
        return Events(texts.column("raw").chunk(0), ~texts.column("held_out").to_numpy(), sent.value, shards), texts

    def request(t: pa.Table) -> pa.Table:
        runs = list(events(t)[0].runs())
        trim()
        return pa.table({"shard": pa.array([s for s, _ in runs], pa.int32()), "block": pa.array([t.column("block")[0].as_py()] * len(runs), pa.int32()), "run": pa.array([r for _, r in runs], pa.binary())})

    def reply(t: pa.Table) -> pa.Table:
        answers = pa.array(answer(t.column("run").to_pylist(), sent.value), pa.binary())
        trim()
        return pa.table({"block": t.column("block"), "shard": t.column("shard"), "answer": answers})

    def score(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, texts = events(left)
        n, known, base, own = score_block(block, texts.num_rows, dict(zip(right.column("shard").to_pylist(), right.column("answer").to_pylist())), ends, tokens, distinct)
        if not tokens:
            own = base
        del block
        trim()
        return pa.table({"doc_key": texts.column("doc_key"), "held_out": texts.column("held_out"), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(own)})

    asked = packed.groupBy("block").applyInArrow(request, "shard int, block int, run binary")
    answers = asked.groupBy("shard").applyInArrow(reply, "block int, shard int, answer binary")
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_key").alias(key), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
