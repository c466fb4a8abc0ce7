"""Vector bin packing of tokenised examples under limits on tokens, segments and loss-bearing tokens.

Each task packs its own rows. A document's whole multiples of the capacity fill sequences of their own;
the rest is an item with the vector (tokens, 1 segment, loss-bearing tokens). An open sequence takes,
of a window of items that fit, the one with the largest dot product of its vector and the room that
is left, each scaled by its limit. If none fits and there is room, the item with the largest product
is cut to fill it. What a task has left at its end is cut into sequences of powers of two, which need
no padding. Sequence ids hold the partition's number, so a task that is run again gives the same ids.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pomona.llm.bpe import chunks, gather
from pomona.llm.common import filled, text_slices

CAPACITY, SEGMENTS, END_ID, WINDOW = 2048, 512, 1, 512


class Piece:
    """A run of a document's ids; `ids` is a view of them."""

    __slots__ = ("doc", "start", "ids", "loss", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, loss: np.ndarray | None, total: int):
        self.doc, self.start, self.ids, self.loss, self.total = doc, start, ids, loss, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.doc, self.start, self.ids[:n], a, self.total), Piece(self.doc, self.start + n, self.ids[n:], b, self.total)

    def vector(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())


class Packer:
    """Packs pieces into sequences; `loss_limit` bounds the loss-bearing tokens of one."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int | None = None, window: int = WINDOW):
        self.limits = np.array([capacity, segments, loss_limit or capacity], np.int64)
        self.next_id, self.window, self.queue, self.items = first_id, window, deque(), []
        self.vectors = np.zeros((0, 3), np.int64)

    def sequence(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        at = 0
        for p in pieces:
            yield p, self.next_id, at
            at += len(p.ids)
        self.next_id += 1

    def add(self, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        capacity = int(self.limits[0])
        while len(piece.ids) >= capacity and piece.cut(capacity)[0].vector()[2] <= self.limits[2]:
            head, piece = piece.cut(capacity)
            yield from self.sequence([head])
        if len(piece.ids):
            self.queue.append(piece)
        # with twice the window at hand, every sequence closed here can be full
        while len(self.queue) > 2 * self.window:
            yield from self.close()

    def _refill(self) -> None:
        while self.queue and len(self.items) < self.window:
            self.items.append(self.queue.popleft())
        if len(self.vectors) < len(self.items):
            self.vectors = np.vstack([self.vectors, [p.vector() for p in self.items[len(self.vectors) :]]])

    def _take(self, i: int) -> Piece:
        p, last = self.items[i], self.items.pop()
        v = self.vectors[-1].copy()
        self.vectors = self.vectors[:-1]
        if i < len(self.items):
            self.items[i], self.vectors[i] = last, v
        return p

    def close(self) -> Iterator[tuple[Piece, int, int]]:
        """Fills one sequence from the window."""
        self._refill()
        room, chosen = self.limits.copy(), []
        while self.items and room[0] > 0 and room[1] > 0:
            product = self.vectors @ (room / self.limits.astype(float) ** 2)
            fits = (self.vectors <= room).all(1)
            if fits.any():
                p = self._take(int(np.argmax(np.where(fits, product, -1.0))))
            else:
                p = self._take(int(np.argmax(product)))
                n = min(int(room[0]), len(p.ids))
                if p.loss is not None:  # as far as the loss-bearing tokens have room
                    n = min(n, int(np.searchsorted(np.cumsum(p.loss), room[2], "right")))
                if n == 0 and chosen:
                    self.queue.appendleft(p)
                    break
                p, rest = p.cut(max(n, 1))
                if len(rest.ids):
                    self.queue.appendleft(rest)
            room -= p.vector()
            chosen.append(p)
        yield from self.sequence(chosen)

    def finish(self) -> Iterator[tuple[Piece, int, int]]:
        capacity = int(self.limits[0])
        while self.queue or self.items:
            self._refill()
            left = int(self.vectors[:, 0].sum()) + sum(len(p.ids) for p in self.queue)
            if left >= capacity or len(self.items) + len(self.queue) > self.limits[1] or self.vectors[:, 2].sum() > self.limits[2]:
                yield from self.close()
                continue
            rest, self.items, self.vectors = self.items, [], self.vectors[:0]
            while rest:
                size = 1 << (sum(len(p.ids) for p in rest).bit_length() - 1)
                chosen = []
                while size:
                    p = rest.pop(0)
                    if len(p.ids) > size:
                        p, tail = p.cut(size)
                        rest.insert(0, tail)
                    size -= len(p.ids)
                    chosen.append(p)
                yield from self.sequence(chosen)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable bytes as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


@functools.lru_cache(2)
def load_encoder(path: str, pattern: str) -> tuple[Callable[[str], list[int]], dict[int, int], dict[str, int]]:
    """An encoder of plain text with the ids of a byte-level BPE in a `tokenizers` file, whose merges must stand in id order.

    Returns it, the bytes of each token, and the file's added tokens, which texts are to be cut at first.

    If each token's own bytes encode to that token, as the tests hold for the file in use, then no two
    adjacent tokens can ever join to a third but by its listed merge, so encoding by ranks of joined
    bytes gives the same ids as the library that the file is for, in a fifth of its time.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], {}
    for t in file.get("added_tokens") or []:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added tokens with conditions on their surroundings are not supported: {t['content']}")
        added[t["content"]] = t["id"]
    alphabet, vocab = _byte_alphabet(), model["vocab"]
    last = -1
    for merge in model["merges"]:
        made = vocab["".join(merge if isinstance(merge, list) else merge.split(" "))]
        if made <= last:
            raise ValueError("the merges of this vocabulary are not in the order of their ids")
        last = made
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if all(c in alphabet for c in t) and i <= last}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, {i: len(t) for t, i in ranks.items()}, added


def split_added(texts: pa.Array, added: dict[str, int]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at added tokens, from the left and the longest first.

    Returns the segments, each text's first one (one more than texts), and the added token after each, or -1.
    """
    texts = filled(texts)
    hit = np.zeros(len(texts), bool)
    for t in added:
        hit |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
    if not hit.any():
        return texts, np.arange(len(texts) + 1), np.full(len(texts), -1, np.int64)
    cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
    segments, follows, first = [], [], [0]
    for text, h in zip(texts.to_pylist(), hit.tolist()):
        parts = cut.split(text) if h else [text]
        segments += parts[::2]
        follows += [*(added[t] for t in parts[1::2]), -1]
        first.append(len(segments))
    return pa.array(segments, pa.large_string()), np.array(first, np.int64), np.array(follows, np.int64)


def token_ids(texts: pa.Array, path: str, pattern: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, one after another, with the file's added tokens inside texts, each text's followed by end_id, and where each begins (one more than texts)."""
    encode, width, added = load_encoder(path, pattern)
    widths = np.zeros(max(width) + 1, np.int64)
    widths[list(width)] = list(width.values())
    segments, first, follows = split_added(texts, added)
    if end_id is not None:
        follows[first[1:] - 1] = end_id
    singles, which = np.unique(follows[follows >= 0], return_inverse=True)
    offsets, ids, distinct, joins = chunks(segments)
    together, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
    parts = [distinct[i] for i in together.tolist()]
    flat = np.array(encode("".join(parts)), np.int64)
    ends = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))
    count, starts = np.zeros(len(distinct) + len(singles), np.int64), np.zeros(len(distinct) + len(singles), np.int64)
    at = np.r_[0, np.searchsorted(np.cumsum(widths[flat]), ends) + 1] if len(parts) else np.zeros(1, np.int64)
    count[together], starts[together] = np.diff(at), at[:-1]
    pools, total = [flat], len(flat)
    for i in alone.tolist():
        own = encode(distinct[i])
        count[i], starts[i] = len(own), total
        total += len(own)
        pools.append(np.array(own, np.int64))
    if len(singles):
        count[len(distinct) :], starts[len(distinct) :] = 1, total + np.arange(len(singles))
        pools.append(singles)
        ids = np.insert(ids, offsets[1:][follows >= 0], len(distinct) + which)
        offsets = offsets + np.r_[0, np.cumsum(follows >= 0)]
    offsets = offsets[first]
    pool = np.concatenate(pools).astype("<u4")
    begin = np.r_[0, np.cumsum(count[ids])][offsets]
    return gather(starts, count, pool, ids), begin


def pack_texts(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", loss_from: str | None = None, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of tokenised texts with their places in sequences of at most `capacity` tokens.

    loss_from: a column with the first loss-bearing token of each text; without it every token bears loss.
    Defined cases: null text is the empty text, which is the end id alone; null keys and repeated rows are
    packed as documents of their own; very long texts are cut; an empty table gives an empty result;
    other columns are ignored.
    """
    src = df.select(F.col(key).alias("text_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("raw"), (F.coalesce(F.col(loss_from), F.lit(0)) if loss_from else F.lit(0)).cast("long").alias("loss_from"))
    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    schema = f"text_key {dict(src.dtypes)['text_key']}, {fields}"
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 36, capacity, segments, loss_limit)
        keys = None

        def rows(placed) -> Iterator[pa.RecordBatch]:
            got = list(placed)
            if not got:
                return
            columns = [
                pa.array([p.doc for p, _, _ in got], keys),
                pa.array([p.start for p, _, _ in got], pa.int64()),
                pa.array([len(p.ids) for p, _, _ in got], pa.int64()),
                pa.array([zlib.crc32(p.ids) for p, _, _ in got], pa.int64()),
                pa.array([p.total for p, _, _ in got], pa.int64()),
                pa.array([s for _, s, _ in got], pa.int64()),
                pa.array([at for _, _, at in got], pa.int64()),
            ]
            if keep_ids:
                columns.append(pa.array([p.ids.astype(np.int32) for p, _, _ in got], kind))
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", *(f.split()[0] for f in fields.split(", "))])

        for b in text_slices(batches, "raw", 3 << 20):
            keys = b.column("text_key").type
            flat, begin = token_ids(b.column("raw"), path, pattern)
            placed = []
            for doc, loss, a, z in zip(b.column("text_key").to_pylist(), b.column("loss_from").to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
                placed.extend(packer.add(Piece(doc, 0, flat[a:z], (np.arange(z - a) >= loss) if loss_from else None, z - a)))
            yield from rows(placed)
        yield from rows(packer.finish())

    return src.mapInArrow(run, schema).withColumnRenamed("text_key", key)
