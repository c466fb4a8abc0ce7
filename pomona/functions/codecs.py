"""Codecs of old archives and disk images, each way where both are in use.

All work on whole byte strings and raise ValueError on damaged input; a codec is sequential by nature, so
the unit of parallel work is one stream.
"""

from __future__ import annotations

import binascii
import bz2
import heapq
import re
import struct
import zlib
from collections import Counter

import numpy as np

BLOCK = 4096
#: Words that are summed at once, at most: few enough that a carry, after which the sum starts anew, costs little.
SUM_WORDS = 1 << 14
_ZEROS, _LOW = bytes(2 * SUM_WORDS), np.uint64(0xFFFFFFFF)


# --- checksums


def crc16(data: bytes, seed: int = 0) -> int:
    """CRC of polynomial 0x1021, high bit first; threads are seeded with 0xFFFF, packed blocks with 0."""
    return binascii.crc_hqx(data, seed)


def rotating_sum(data: bytes) -> int:
    """Adds 16-bit big-endian words to 32 bits, rotated right by one after each.

    Without a carry out of 32 bits, a rotation is a product modulo 2**32 - 1 and the sums are running totals of rotated
    words. Carries are lost here, which that arithmetic doesn't know; the word that makes one and some after it are added one by one.
    """
    words = np.frombuffer(data, ">u2", len(data) // 2)
    s, room, at = 0, SUM_WORDS, 0
    while at < len(words):
        if data.startswith(_ZEROS, 2 * at):  # zeros only rotate, here by whole turns
            at += SUM_WORDS
            continue
        part = words[at : at + room].astype(np.uint64)
        turn = np.arange(len(part), dtype=np.uint64) & np.uint64(31)
        # all in the place of the first word: words rotated left, totals modulo 2**32 - 1, where a total above 0 is never 0
        turned = part << turn
        total = np.cumsum((turned & _LOW) + (turned >> np.uint64(32))) + np.uint64(s)
        total = np.where(total > 0, (total - np.uint64(1)) % _LOW + np.uint64(1), total)
        before = np.r_[np.uint64(s), total[:-1]]
        before = before >> turn | before << np.uint64(32) - turn & _LOW
        carried = np.flatnonzero(before + part > _LOW)
        n = int(carried[0]) if len(carried) else len(part)
        if n:
            v, k = int(total[n - 1]), n & 31
            s = v >> k | v << 32 - k & 0xFFFFFFFF
        room = min(2 * room, SUM_WORDS)
        if n < len(part):  # other carries may follow soon
            room = 256
            for word in part[n : n + room].tolist():
                s = s + word & 0xFFFFFFFF
                s = s >> 1 | (s & 1) << 31
                n += 1
        at += n
    return s


# --- run lengths


def _runs(data: bytes):
    """(value, length) of each run."""
    i, n = 0, len(data)
    while i < n:
        j = i + 1
        while j < n and data[j] == data[i]:
            j += 1
        yield data[i], j - i
        i = j


def pack_bits(data: bytes) -> bytes:
    """Runs as 257 - n and the byte, other stretches as n - 1 and the bytes; at most 128 at a time."""
    out, literal = bytearray(), bytearray()

    def flush():
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for value, n in _runs(data):
        if n < 3:
            literal.extend([value] * n)
            continue
        flush()
        while n:
            k = min(n, 128)
            if k == 1:
                literal.append(value)
            else:
                out.extend((257 - k, value))
            n -= k
    flush()
    return bytes(out)


def unpack_bits(data: bytes, size: int | None = None) -> bytes:
    """A count of 0x80 is a run of 129, as decoders of this family read it."""
    out, i = bytearray(), 0
    while i < len(data) and (size is None or len(out) < size):
        n = data[i]
        if n < 0x80:
            if i + 2 + n > len(data):
                raise ValueError("the packed data ends inside a stretch")
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if i + 1 >= len(data):
                raise ValueError("the packed data ends inside a run")
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    if size is not None and len(out) < size:
        raise ValueError("the packed data is too short")
    return bytes(out if size is None else out[:size])


def unpack_bytes(data: bytes, size: int | None = None, exact: bool = True) -> bytes:
    """Two bits of kind (plain, one byte repeated, four bytes repeated, one byte repeated four times as often), six bits of count - 1.

    size: bytes to unpack; unless `exact`, fewer are fine, more are cut off, and so is a group without its end.
    """
    out, i = bytearray(), 0
    while i < len(data) and (size is None or len(out) < size):
        kind, n = data[i] >> 6, (data[i] & 0x3F) + 1
        take = (n, 1, 4, 1)[kind]
        part = data[i + 1 : i + 1 + take]
        if len(part) < take:
            if not exact:
                break
            raise ValueError("the packed data ends inside a group")
        out += part * (1, n, n, 4 * n)[kind]
        i += 1 + take
    if not exact:
        return bytes(out[:size])
    if size is not None and len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return bytes(out)


def pack_bytes(data: bytes) -> bytes:
    out, literal = bytearray(), bytearray()

    def flush():
        for i in range(0, len(literal), 64):
            part = literal[i : i + 64]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for value, n in _runs(data):
        if n < 3:
            literal.extend([value] * n)
            continue
        flush()
        while n >= 4 and n > 64:
            k = min(n // 4, 64)
            out.extend((0xC0 | k - 1, value))
            n -= 4 * k
        if n >= 3:
            out.extend((0x40 | n - 1, value))
        else:
            literal.extend([value] * n)
    flush()
    return bytes(out)


# --- squeeze: run lengths, then a static Huffman code

_DLE, _END = 0x90, 256


def _squeeze_runs(data: bytes) -> list[int]:
    out = []
    for value, n in _runs(data):
        if value == _DLE:
            out.extend([_DLE, 0] * n)
            continue
        while n:
            k = min(n, 255)
            out.extend([value, _DLE, k] if k > 2 else [value] * k)
            n -= k
    return out


def squeeze(data: bytes) -> bytes:
    """Node count, nodes (two 16-bit children; values are stored as -1 - value), then bits, lowest first."""
    symbols = [*_squeeze_runs(data), _END]
    heap = [(n, i, s) for i, (s, n) in enumerate(sorted(Counter(symbols).items()))]
    heapq.heapify(heap)
    nodes, serial = [], len(heap)
    if len(heap) == 1:  # an empty input still needs a tree
        heap.append((0, serial, 0))
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        serial += 1
        heapq.heappush(heap, (a[0] + b[0], serial, (a[2], b[2])))
    root = heap[0][2]
    codes: dict[int, str] = {}

    def number(node, prefix: str) -> int:
        if not isinstance(node, tuple):
            codes[node] = prefix
            return -1 - node
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (number(node[0], prefix + "0"), number(node[1], prefix + "1"))
        return at

    number(root, "")
    out = bytearray(len(nodes).to_bytes(2, "little"))
    for pair in nodes:
        for child in pair:
            out += (child & 0xFFFF).to_bytes(2, "little")
    bits = "".join(codes[s] for s in symbols)
    bits += "0" * (-len(bits) % 8)
    out += bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    return bytes(out)


def unsqueeze(data: bytes) -> bytes:
    n = int.from_bytes(data[:2], "little")
    if n > 257 or len(data) < 2 + 4 * n:
        raise ValueError("no squeeze tree")
    child = [[int.from_bytes(data[2 + 4 * i + 2 * k : 4 + 4 * i + 2 * k], "little", signed=True) for k in (0, 1)] for i in range(n)]
    out, node, repeat = bytearray(), 0, False
    for byte in data[2 + 4 * n :]:
        for k in range(8):
            node = child[node][byte >> k & 1] if n else -1 - _END
            if node >= 0:
                if node >= n:
                    raise ValueError("a squeeze tree points outside itself")
                continue
            value, node = -1 - node, 0
            if value == _END:
                return bytes(out)
            if repeat:
                if value == 0:
                    out.append(_DLE)
                elif not out:
                    raise ValueError("a run of nothing")
                else:
                    out += out[-1:] * (value - 1)
                repeat = False
            elif value == _DLE:
                repeat = True
            else:
                out.append(value)
    raise ValueError("squeezed data without an end")


# --- LZW over run-length coded blocks

_CLEAR, _FIRST, _FULL = 0x100, 0x101, 0xFFD


#: Runs of 4 to 256 of any byte, and of 1 to 256 of the delimiter.
_RUN = re.compile(rb"\xdb{1,256}|([\x00-\xff])\1{3,255}")
#: A delimiter with value and length, if they are there.
_CODED = re.compile(rb"\xdb(?:([\x00-\xff])([\x00-\xff]))?")
_DELIMITER = 0xDB


def _block_runs(block: bytes) -> bytes:
    return _RUN.sub(lambda m: bytes((_DELIMITER, m[0][0], len(m[0]) - 1)), block)


def _block_unrun(data: bytes, delimiter: int) -> bytes:
    if delimiter not in data:
        return data

    def run(m: re.Match) -> bytes:
        if m[1] is None:
            raise ValueError("a run without its length")
        return m[1] * (m[2][0] + 1)

    coded = _CODED if delimiter == _DELIMITER else re.compile(re.escape(bytes((delimiter,))) + rb"(?:([\x00-\xff])([\x00-\xff]))?")
    return coded.sub(run, data)


def _width(entry: int) -> int:
    return min(12, max(9, (entry + 1).bit_length()))


class _Table:
    """What coder and decoder share: codes by the code of all but the last byte (times 256) and that byte; `entry` is the decoder's next free code."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.codes, self.entry, self.last = {}, _FIRST, None

    def copy(self) -> _Table:
        t = _Table()
        t.codes, t.entry, t.last = dict(self.codes), self.entry, self.last
        return t


def _lzw_block(block: bytes, table: _Table) -> bytes:
    out, bits, value = bytearray(), 0, 0
    codes, entry, last, width = table.codes, table.entry, table.last, _width(table.entry)
    find, rest = codes.get, iter(block)
    byte = next(rest, None)
    while byte is not None:
        if entry >= _FULL:
            value |= _CLEAR << bits
            bits += width
            codes.clear()
            entry, last, width = _FIRST, None, 9
        if last is not None:
            # the string that this code completes is known to the decoder only after it, but may be used at once
            codes.setdefault(last << 8 | byte, entry)
            entry += 1
        last = byte
        for byte in rest:
            code = find(last << 8 | byte)
            if code is None:
                break
            last = code
        else:
            byte = None
        value |= last << bits
        bits += width
        if entry > 510:
            width = _width(entry)
        if bits > 480:
            out += (value & _PART).to_bytes(60, "little")
            value >>= 480
            bits -= 480
    out += value.to_bytes((bits + 7) // 8, "little")
    table.entry, table.last = entry, last
    return bytes(out)


#: 480 bits, written at once.
_PART = (1 << 480) - 1


class _Strings:
    """The decoder's strings by code; the next free code is their number."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.of, self.last = [*_SINGLE, b""], None


_SINGLE = [bytes([i]) for i in range(256)]


def _unlzw_block(data: bytes, size: int, table: _Strings) -> tuple[bytes, int]:
    """The block's bytes, and how many bytes of data it took."""
    out, done, taken = [], 0, 0
    value = bits = at = 0
    of, last = table.of, table.last
    while done < size:
        entry = len(of)
        width = 9 if entry < 511 else _width(entry)
        if bits < width:
            value |= int.from_bytes(data[at : at + 32], "little") << bits
            bits += 256
            at += 32
        code = value & (1 << width) - 1
        value >>= width
        bits -= width
        taken += width
        if code == _CLEAR:
            if taken > 8 * len(data):
                break
            table.clear()
            of, last = table.of, None
            continue
        if code < entry:
            s = of[code]
            if last is not None:
                of.append(last + s[:1])
        elif code == entry and last is not None:
            s = last + last[:1]
            of.append(s)
        else:
            raise ValueError("a code that no string has")
        last = s
        done += len(s)
        out.append(s)
    if taken > 8 * len(data):
        raise ValueError("the packed block ends early")
    table.last = last
    if done != size:
        raise ValueError("a block of the wrong length")
    return b"".join(out), (taken + 7) // 8


def lzw1(data: bytes, volume: int = 0xFE) -> bytes:
    """CRC of the padded data, volume, delimiter; then per 4 KB: length after run coding, LZW flag, bytes."""
    padded = data + bytes(-len(data) % BLOCK)
    return crc16(padded).to_bytes(2, "little") + _lzw_blocks(padded, volume, 1)


def lzw2(data: bytes, volume: int = 0xFE) -> bytes:
    """As lzw1 without the CRC; the table lives on from block to block and the flag is the length's top bit."""
    return _lzw_blocks(data + bytes(-len(data) % BLOCK), volume, 2)


def _lzw_blocks(padded: bytes, volume: int, version: int) -> bytes:
    out, table = bytearray((volume, _DELIMITER)), _Table()
    for i in range(0, len(padded), BLOCK):
        block = padded[i : i + BLOCK]
        runs = _block_runs(block)
        if len(runs) >= BLOCK:
            runs = block
        if version == 1:
            table.clear()
        trial = table.copy()
        packed = _lzw_block(runs, trial)
        if len(packed) + 2 < len(runs):
            table = trial
            out += len(runs).to_bytes(2, "little") + b"\1" if version == 1 else (len(runs) | 0x8000).to_bytes(2, "little") + (len(packed) + 4).to_bytes(2, "little")
            out += packed
        else:
            table.clear()
            out += len(runs).to_bytes(2, "little") + b"\0" * (version == 1) + runs
    return bytes(out)


def unlzw(data: bytes, size: int, version: int) -> bytes:
    """Expands lzw1 or lzw2 data to `size` bytes; lzw1's CRC is checked."""
    at = 2 if version == 1 else 0
    delimiter, at = data[at + 1], at + 2
    out, table = bytearray(), _Strings()
    while len(out) < size:
        if at + 2 > len(data):
            raise ValueError("the packed data ends early")
        runs, at = int.from_bytes(data[at : at + 2], "little"), at + 2
        if version == 1:
            packed, at = data[at] != 0, at + 1
            table.clear()
        else:
            packed, runs = bool(runs & 0x8000), runs & 0x1FFF
            at += 2 * packed
        if packed:
            block, used = _unlzw_block(data[at : at + BLOCK + 512], runs, table)
            at += used
        else:
            block, at = data[at : at + runs], at + runs
            table.clear()
        out += block if runs == BLOCK else _block_unrun(block, delimiter)
    padded = bytes(out)
    if version == 1 and crc16(padded) != int.from_bytes(data[:2], "little"):
        raise ValueError("the blocks' CRC is wrong")
    return padded[:size]


# --- UNIX compress


def lzc(data: bytes, most: int = 12) -> bytes:
    """compress(1) output in block mode, without clearing: codes of 9 to `most` bits in groups of eight."""
    out = bytearray((0x1F, 0x9D, most | 0x80))
    if not data:
        return bytes(out)
    table, free, width, group = {bytes([i]): i for i in range(256)}, 257, 9, []

    def flush():
        bits = 0
        for k, c in enumerate(group):
            bits |= c << (k * width)
        out.extend(bits.to_bytes(width, "little") if group else b"")
        group.clear()

    s = data[:1]
    for b in data[1:]:
        t = s + bytes([b])
        if t in table:
            s = t
            continue
        group.append(table[s])
        if len(group) == 8:
            flush()
        if free < 1 << most:
            table[t] = free
            free += 1
            if free > 1 << width and width < most:
                flush()
                width += 1
        s = t[-1:]
    group.append(table[s])
    bits = 0
    for k, c in enumerate(group):
        bits |= c << (k * width)
    out.extend(bits.to_bytes((len(group) * width + 7) // 8, "little"))
    return bytes(out)


def unlzc(data: bytes) -> bytes:
    if data[:2] != b"\x1f\x9d":
        raise ValueError("not compressed by compress")
    most, block = data[2] & 0x1F, bool(data[2] & 0x80)
    table, width, at = [bytes([i]) for i in range(256)] + [b""] * block, 9, 3
    out, last = bytearray(), None
    while at < len(data):
        part = data[at : at + width]
        at += width
        bits, count = int.from_bytes(part, "little"), 8 * len(part) // width
        for k in range(count):
            code = bits >> (k * width) & (1 << width) - 1
            if code == 256 and block:
                table, width, last = table[:257], 9, None
                break
            if code < len(table):
                s = table[code]
            elif last is not None and code == len(table):
                s = last + last[:1]
            else:
                raise ValueError("a code that no string has")
            out += s
            if last is not None and len(table) < 1 << most:
                table.append(last + s[:1])
            last = s
            if len(table) >= 1 << width and width < most:
                width += 1
                break
    return bytes(out)


# --- dispatch by thread format

#: Thread formats.
FORMATS = {0: "stored", 1: "squeeze", 2: "lzw1", 3: "lzw2", 4: "lzc12", 5: "lzc16", 6: "deflate", 7: "bzip2"}


def expand(data: bytes, kind: int, size: int) -> bytes:
    """A thread's data, expanded to `size` bytes."""
    if kind == 0:
        out = data
    elif kind == 1:
        out = unsqueeze(data)
    elif kind in (2, 3):
        out = unlzw(data, size, kind - 1)
    elif kind in (4, 5):
        out = unlzc(data)
    elif kind == 6:
        out = zlib.decompress(data)
    elif kind == 7:
        out = bz2.decompress(data)
    else:
        raise ValueError(f"unknown thread format {kind}")
    if len(out) < size:
        raise ValueError("the thread is too short")
    return out[:size]


def compress(data: bytes, kind: int) -> tuple[int, bytes]:
    """The format used and the data: stored if packing would not make it smaller."""
    packers = {0: bytes, 1: squeeze, 2: lzw1, 3: lzw2, 4: lambda d: lzc(d, 12), 5: lambda d: lzc(d, 16), 6: lambda d: zlib.compress(d, 9), 7: bz2.compress}
    packed = packers[kind](data)
    return (kind, packed) if kind and len(packed) < len(data) else (0, data)
