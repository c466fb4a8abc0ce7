"""Pulse streams of flux images: Huffman-coded or plain, as bits, and as the disk bytes that a drive's controller reads."""

from __future__ import annotations

import struct

import numpy as np

#: Bits a second of 5.25-inch disks, and of 3.5-inch ones by groups of 16 cylinders; revolutions a second.
RATE, RATES = 250_000, (375_000, 343_750, 312_500, 281_250, 250_000)
TURNS = 5
#: Pulses of a track, and pulses over which the clock is averaged.
FEWEST, MOST, WINDOW = 64, 131_072, 31


def _tree(data: bytes, at: int) -> tuple[list, int]:
    """A tree in pre-order, one bit a node (1 is a leaf), as nested lists; where the bits end."""
    bit = 0

    def node(depth: int = 0) -> list:
        nonlocal bit
        if depth > 64 or at + (bit >> 3) >= len(data):
            raise ValueError("a damaged tree")
        one = data[at + (bit >> 3)] >> (7 - (bit & 7)) & 1
        bit += 1
        return [] if one else [node(depth + 1), node(depth + 1)]

    root = node()
    return root, at + -(-bit // 8)


def _leaves(node: list, code: int = 0, length: int = 0):
    if not node:
        yield code, length
    else:
        yield from _leaves(node[0], code << 1, length + 1)
        yield from _leaves(node[1], code << 1 | 1, length + 1)


def expand(data: bytes, count: int) -> np.ndarray:
    """Values that are coded in slices of bits, each with a Huffman tree of its own; the slice of the lowest bits is the last."""
    out, at, shift = np.zeros(count, np.int64), 0, 1
    while shift:
        if at + 2 > len(data):
            raise ValueError("a pulse stream ends early")
        shift, signed, wide = data[at] & 0x7F, data[at] & 0x80, data[at + 1] & 0x80
        tree, at = _tree(data, at + 2)
        codes = list(_leaves(tree))
        size = 2 if wide else 1
        values = [int.from_bytes(data[at + size * i : at + size * i + size], "big", signed=bool(signed)) for i in range(len(codes))]
        at += size * len(codes)
        if len(codes) == 1:  # nothing is coded
            out |= values[0] << shift
            continue
        longest = max(n for _, n in codes)
        table = {(n, c): v for (c, n), v in zip(codes, values)}
        got, code, length, bits = np.zeros(count, np.int64), 0, 0, np.unpackbits(np.frombuffer(data, np.uint8, -1, at)).tolist()
        i = used = 0
        for used, b in enumerate(bits, 1):
            code, length = code << 1 | b, length + 1
            value = table.get((length, code))
            if value is not None:
                got[i], i, code, length = value, i + 1, 0, 0
                if i == count:
                    break
            elif length > longest:
                raise ValueError("a code that no value has")
        if i < count:
            raise ValueError("a pulse stream ends early")
        out |= got << shift
        at += -(-used // 8)
    return out & 0xFFFFFFFF


def streams(track: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Average widths of a track's pulses, and how often each was seen as zero and as one (or None)."""
    (count,) = struct.unpack_from(">I", track)
    if not FEWEST <= count <= MOST:
        raise ValueError("a track with an impossible number of pulses")
    heads, at, found = [int.from_bytes(track[4 + 3 * i : 7 + 3 * i], "big") for i in range(4)], 16, []
    for head, width in zip(heads, (4, 4, 4, 2)):
        size, coding = head & 0x3FFFFF, head >> 22
        part = track[at : at + size]
        at += size
        if not size:
            found.append(None)
        elif coding == 0:
            if size != count * width:
                raise ValueError("a pulse stream of the wrong length")
            found.append(np.frombuffer(part, ">u4" if width == 4 else ">u2").astype(np.int64))
        elif coding == 1:
            found.append(expand(part, count))
        else:
            raise ValueError("an unknown coding of pulses")
    if found[0] is None:
        raise ValueError("a track without pulses")
    return found[0], found[3]


def bits(widths: np.ndarray, seen: np.ndarray | None, rate: int) -> np.ndarray:
    """The bits of one revolution: a one for each pulse, zeros for the empty cells before it.

    A pulse that fewer than half of the samples saw is none. A cell's width follows the pulses around it.
    """
    if seen is not None:
        times = (seen >> 8 & 0xFF) + (seen & 0xFF)
        weak = times * 2 < times.max()
        if weak.any():  # what a weak pulse took is part of the next one's time
            strong = np.flatnonzero(~weak)
            if not len(strong):
                raise ValueError("a track of weak pulses")
            widths = np.diff(np.r_[0, np.cumsum(widths)[strong]])
    cell = widths.sum() * TURNS / rate
    if cell <= 0:
        raise ValueError("a track without time")
    n = np.maximum(1, np.rint(widths / cell))
    one = np.ones(min(WINDOW, len(widths)))
    local = np.convolve(widths, one, "same") / np.convolve(n, one, "same")
    local = np.clip(local, 0.8 * cell, 1.25 * cell)
    n = np.maximum(1, np.rint(widths / local)).astype(np.int64)
    out = np.zeros(int(n.sum()), np.uint8)
    out[np.cumsum(n) - 1] = 1
    return out


def disk_bytes(ring: np.ndarray) -> bytes:
    """Two revolutions as disk bytes: each begins at the next one bit, so that sync bytes bring the reader into step."""
    text = ring.astype(np.uint8).tobytes()
    text += text
    out, at = bytearray(), 0
    ones = np.flatnonzero(np.frombuffer(text, np.uint8))
    following = np.searchsorted(ones, np.arange(len(text)))
    values = np.convolve(np.frombuffer(text, np.uint8).astype(np.int64), 1 << np.arange(8), "valid").tolist() if len(text) >= 8 else []  # the eight bits from each place on
    places, nxt = ones.tolist(), following.tolist()
    while at < len(text):
        k = nxt[at]
        if k >= len(places) or places[k] + 8 > len(text):
            break
        out.append(values[places[k]])
        at = places[k] + 8
    return bytes(out)
