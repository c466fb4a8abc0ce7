r"""Byte-level BPE by corpus-level merge replay, and its decoding.

1. Texts are dealt into blocks of bounded size. A block's texts are cut into chunks at single spaces between
   visible characters, where the pretokenizer always has a boundary; only the distinct chunks are
   pretokenized, and the distinct pieces go to shards by their hash.
2. A shard holds a part of the corpus' distinct pieces, each of them once, and replays the merges on all of
   them at once: an inverted index from token pair to the positions where it stands is worked off in rank
   order; a merge looks up the pairs of its two neighbours alone and enters them into the index. A pair that
   appears with a lower rank than the current one is replayed before anything else, as a piece-by-piece
   encoder would.
3. A block meets its pieces' ids, puts its texts' together, and decodes them again.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pomona.llm.common import filled, hash_bytes, pack_arrays, pack_blocks, spread, trim, unpack_arrays, unpack_block

#: Bytes of text in a block, and those whose distinct pieces make a shard.
BLOCK, SHARD = 8 << 20, 16 << 20
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")


class Ranks:
    """A vocabulary of ranked byte strings: every two tokens that join to a third may merge into it."""

    def __init__(self, tokens: dict[bytes, int]):
        self.tokens, self.bytes_of = tokens, {i: t for t, i in tokens.items()}
        self.single = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        keys, ranks, least = [], [], np.full(max(tokens.values()) + 1, 1 << 30)
        for t, r in tokens.items():
            for i in range(1, len(t)):
                a, b = tokens.get(t[:i]), tokens.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(r)
        order = np.argsort(np.array(keys, np.int64))
        #: Sorted token pairs, and the rank of the token that each makes; a pair's number is its place here.
        self.keys, self.ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        np.minimum.at(least, self.keys >> 20, self.ranks)
        np.minimum.at(least, self.keys & 0xFFFFF, self.ranks)
        #: Tokens that can stand in a pair of lower rank than their own; their merges go one by one.
        self.early = least < np.arange(len(least))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of the pair of a and b, or -1 if they make no token."""
        key = a << 20 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, i, -1)


@functools.lru_cache(2)
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def replay(pieces: Sequence[bytes], model: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after another, and how many each piece has."""
    size = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n, owner = len(data), np.repeat(np.arange(len(pieces)), size)
    sym = model.single[data]
    whole = np.array([model.tokens.get(p, -1) for p in pieces], np.int64)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(size)[size > 0]
    nxt[ends - 1] = -1
    prv[np.r_[0, ends[:-1]][: len(ends)]] = -1
    now = np.full(n, -1, np.int64)  # number of the pair that starts here
    has = np.flatnonzero(nxt >= 0)
    has = has[whole[owner[has]] < 0]  # a piece that is a token stays that token
    now[has] = model.pair(sym[has], sym[has + 1])
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}  # from token pair to positions
    waiting: dict[int, set[int]] = {}  # pairs in the index by the rank of what they make
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        at = at[now[at] >= 0]
        if not len(at):
            return
        pairs = now[at]
        order = np.argsort(pairs, kind="stable")
        at, pairs = at[order], pairs[order]
        cuts = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
        first = pairs[np.r_[0, cuts]]
        for p, r, part in zip(first.tolist(), model.ranks[first].tolist(), np.split(at, cuts) if len(cuts) else [at]):
            if p in index:
                index[p].append(part)
                continue
            index[p] = [part]
            if r in waiting:
                waiting[r].add(p)
            else:
                waiting[r] = {p}
                heapq.heappush(heap, r)

    enter(has)
    while heap:
        r = heapq.heappop(heap)
        pairs = sorted(waiting.pop(r))
        lists = [part[now[part] == p] for p in pairs for part in index.pop(p)]
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        if not len(at):
            continue
        later = None
        if model.early[r]:  # the leftmost of each piece now, the rest after any lower rank
            at = np.sort(at)
            first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            at, later = at[first], at[~first]
        elif ((now[nxt[at]] >= 0) & (model.ranks[now[nxt[at]]] == r)).any():  # runs of one token: from the left, without overlap
            taken, blocked = [], set()
            for p in np.sort(at).tolist():
                if p not in blocked:
                    taken.append(p)
                    blocked.add(int(nxt[p]))
            at = np.array(taken, np.int64)
        right = nxt[at]
        beyond = nxt[right]
        sym[at], nxt[at], alive[right], now[right] = r, beyond, False, -1
        more = beyond >= 0
        prv[beyond[more]] = at[more]
        now[at] = -1
        a = at[more]
        before = prv[at]
        b = before[before >= 0]
        touched = np.concatenate([a, b])
        if len(touched):
            now[touched] = model.pair(sym[touched], sym[nxt[touched]])
            enter(touched)
        if later is not None and len(later):
            enter(later)
    known = whole >= 0
    alive[known[owner] & (np.arange(n) > np.repeat(np.cumsum(size) - size, size))] = False
    head = known[owner] & alive
    sym[head] = whole[owner[head]]
    return sym[alive], np.bincount(owner[alive], minlength=len(pieces))


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Texts cut where a pretokenizer of the usual pattern always has a boundary.

    Returns each text's first position (one more than texts), each chunk's index into the distinct
    chunks, these, and which of them may be joined with others of their kind without losing a boundary.
    """
    texts = filled(texts)
    marked = pc.replace_substring(texts, " ", "\0 ")
    lists = pc.split_pattern(marked, "\0")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = lists.flatten().dictionary_encode()
    ids, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    bad_start = np.fromiter((len(c) < 2 or c[1].isspace() for c in distinct), bool, len(distinct))
    space_end = np.fromiter((c[-1:].isspace() for c in distinct), bool, len(distinct))
    spaced = np.fromiter((c[:1] == " " for c in distinct), bool, len(distinct))
    first, last = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    first[offsets[:-1]], last[offsets[1:] - 1] = True, True
    odd = (bad_start[ids] & ~first) | (space_end[ids] & ~last)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    odd_texts = set(owner[odd].tolist()) | set(np.flatnonzero(pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)).tolist())
    if odd_texts:
        place = {c: i for i, c in enumerate(distinct)}
        parts, at = [], 0
        for t in sorted(odd_texts):
            parts.append(ids[offsets[at] : offsets[t]])
            cut = _BOUNDARY.split(texts[t].as_py())
            parts.append(np.array([place.setdefault(c, len(place)) for c in cut], np.int64))
            at = t + 1
        parts.append(ids[offsets[at] :])
        size = np.diff(offsets)
        for t, p in zip(sorted(odd_texts), parts[1::2]):
            size[t] = len(p)
        ids, offsets, old = np.concatenate(parts), np.r_[0, np.cumsum(size)], len(distinct)
        distinct = list(place)
        new = distinct[old:]
        bad_start = np.r_[bad_start, [len(c) < 2 or c[1].isspace() for c in new]].astype(bool)
        space_end = np.r_[space_end, [c[-1:].isspace() for c in new]].astype(bool)
        spaced = np.r_[spaced, [c[:1] == " " for c in new]].astype(bool)
    return offsets, ids, distinct, spaced & ~bad_start & ~space_end


def gather(starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """pool[starts[i] : starts[i] + sizes[i]] for each i of ids, one after another."""
    s = sizes[ids]
    return pool[np.repeat(starts[ids], s) + spread(s)]


class Pieces:
    """Texts cut into pieces: `known` are the distinct ones, in bytes."""

    def __init__(self, texts: pa.Array, pattern: str):
        import regex

        find = regex.compile(pattern).findall
        self.offsets, self.ids, distinct, joins = chunks(texts)
        sizes = np.zeros(len(distinct), np.int64)
        together = np.flatnonzero(joins)
        joined = find("".join([distinct[i] for i in together.tolist()]))
        ends = np.cumsum([len(distinct[i]) for i in together.tolist()]) if len(together) else np.zeros(0, np.int64)
        at = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        sizes[together] = np.bincount(np.searchsorted(ends, at), minlength=len(together))[: len(together)] if len(together) else 0
        alone = np.flatnonzero(~joins)
        single = [find(distinct[i]) for i in alone.tolist()]
        sizes[alone] = [len(p) for p in single]
        pieces = pa.array(joined + [p for x in single for p in x], pa.large_string()).dictionary_encode()
        self.known = pieces.dictionary.cast(pa.large_binary())
        self.order, self.sizes = np.r_[together, alone], sizes
        self.codes = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def encoded(self, pool: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct chunks' ids, one after another, and how many each has, from those of the pieces."""
        flat = gather(np.cumsum(n) - n, n, pool, self.codes)
        ends = np.r_[0, np.cumsum(n[self.codes])][np.cumsum(self.sizes[self.order])]
        count, starts = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
        count[self.order] = np.diff(np.r_[0, ends])
        starts[self.order] = ends - count[self.order]
        return gather(starts, count, flat, np.arange(len(self.sizes))), count


def _dealt(pieces: Pieces, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pieces in the order of their shards, and where each shard begins."""
    place = (hash_bytes(pieces.known) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(shards + 1))


def merge_shard(runs: Sequence[bytes], model: Ranks) -> list[bytes]:
    """The ids of each run's pieces; every distinct piece of all runs is merged once."""
    read = [unpack_arrays(r, "s1") for r in runs]
    sizes, data = np.concatenate([s for s, _ in read]), np.concatenate([d for _, d in read])
    ends = np.r_[0, np.cumsum(sizes)]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())]).dictionary_encode()
    pool, n = replay(coded.dictionary.to_pylist(), model)
    starts, which, out, at = np.cumsum(n) - n, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [], 0
    kind = np.uint16 if len(model.early) <= 1 << 16 else np.uint32
    for s, _ in read:
        some = which[at : at + len(s)]
        at += len(s)
        out.append(pack_arrays(n[some], gather(starts, n, pool, some).astype(kind)))
    return out


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every text encoded and decoded: key, n_tokens, ids_sha256, decoded_sha256, and `ids` if asked for.

    Defined cases: null text is the empty text, which has no tokens; null keys and repeated rows are kept;
    texts of any length are encoded whole; an empty table gives an empty result; other columns are ignored.
    """
    src = df.select(F.col(key).alias("text_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("raw"))
    schema = f"text_key {dict(src.dtypes)['text_key']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    size = src.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    blocks, shards = max(1, -(-size // BLOCK)), max(1, -(-size // SHARD))
    packed = pack_blocks(src, blocks)

    def request(t: pa.Table) -> pa.Table:
        pieces = Pieces(unpack_block(t).column("raw").chunk(0), pattern)
        order, at = _dealt(pieces, shards)
        known = pieces.known.take(pa.array(order))
        sizes, begin = pc.binary_length(known).to_numpy(zero_copy_only=False).astype(np.int64), np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1]
        data = np.frombuffer(known.buffers()[2] or b"", np.uint8)
        asked = np.flatnonzero(np.diff(at))
        runs = [pack_arrays(sizes[at[s] : at[s + 1]], data[begin[at[s]] : begin[at[s + 1]]]) for s in asked.tolist()]
        trim()
        return pa.table({"shard": pa.array(asked.astype(np.int32)), "block": pa.array(np.full(len(asked), t.column("block")[0].as_py(), np.int32)), "run": pa.array(runs, pa.binary())})

    def reply(t: pa.Table) -> pa.Table:
        answers = pa.array(merge_shard(t.column("run").to_pylist(), load_ranks(path)), pa.binary())
        trim()
        return pa.table({"block": t.column("block"), "shard": t.column("shard"), "answer": answers})

    def encode(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        model, t = load_ranks(path), unpack_block(left)
        pieces = Pieces(t.column("raw").chunk(0), pattern)
        order, at = _dealt(pieces, shards)
        n, of = np.zeros(len(order), np.int64), []
        answers = dict(zip(right.column("shard").to_pylist(), right.column("answer").to_pylist()))
        for s in np.flatnonzero(np.diff(at)).tolist():
            sizes, ids = unpack_arrays(answers[s], "s2" if len(model.early) <= 1 << 16 else "s4")
            n[at[s] : at[s + 1]] = sizes
            of.append(ids.astype(np.int64))
        found = np.concatenate([np.zeros(0, np.int64), *of])
        starts, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        starts[order], sizes[order] = np.cumsum(n) - n, n
        pool, count = pieces.encoded(gather(starts, sizes, found, np.arange(len(order))), sizes)
        offsets, ids, ends = pieces.offsets, pieces.ids, np.cumsum(count)
        # decoded from the ids, once for each distinct chunk
        tokens, shown, back = pool.tolist(), [], []
        for a, z in zip((ends - count).tolist(), ends.tolist()):
            some = tokens[a:z]
            shown.append(" ".join(map(str, some)).encode())
            back.append(b"".join([model.bytes_of[i] for i in some]))
        full = count[ids] > 0
        total = np.r_[0, np.cumsum(count[ids])][offsets]
        offsets, ids = np.r_[0, np.cumsum(full)][offsets], ids[full]
        hashed, decoded = [], []
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            some = ids[a:z].tolist()
            hashed.append(hashlib.sha256(b" ".join([shown[i] for i in some])).hexdigest())
            decoded.append(hashlib.sha256(b"".join([back[i] for i in some])).hexdigest())
        columns = [t.column("text_key"), pa.array(np.diff(total)), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array((total - total[0]).astype(np.int32)), pa.array(gather(ends - count, count, pool, ids).astype(np.int32))))
        trim()
        return pa.table(dict(zip(names, columns)))

    asked = packed.groupBy("block").applyInArrow(request, "shard int, block int, run binary")
    answers = asked.groupBy("shard").applyInArrow(reply, "block int, shard int, answer binary")
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(encode, schema).withColumnRenamed("text_key", key)
