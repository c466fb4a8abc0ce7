"""Baseline JPEG as a lossless store for bytes, read back with numpy.

Storing: the padded payload's 64-byte units become the 64 quantised coefficients (zigzag order, all
quantisers 1) of one 8x8 luminance block each. Coefficients are the format's unit and are coded
without loss. Every block is a restart interval of its own.

Reading: markers are parsed (SOF0, DHT, DQT, DRI, SOS, COM), the scans of a batch of files are split at
their restart markers, and all intervals are Huffman-decoded in lockstep, one symbol of each at a
time. A file without restart markers is one interval. The DC coefficients alone give the luminance
thumbnail (one pixel a block), of which dimensions and hashes are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pomona.llm.common import spread, text_slices

#: Payload bytes coded or decoded at once, and blocks of a longer single payload.
CHUNK = 2 << 20
BLOCKS = CHUNK // 64
#: Blocks in one row of the image, before the rows are evened out, and at most on a side (65,535 pixels).
ROW_BLOCKS, SIDE = 1024, 8191
UNIT = 64


def _canonical(counts: Sequence[int], symbols: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol for a DHT's counts of each length and its symbols."""
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code = at = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[at]], lengths[symbols[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return codes, lengths


#: DC sizes 0-11 in four bits each; AC sizes usual in texts in 1 to 4 bits, the rest in 12.
DC_COUNTS, DC_SYMBOLS = [0, 0, 0, 12] + [0] * 12, list(range(12))
_SHORT = [0x07, 0x06, 0x05, 0x08]
AC_SYMBOLS = [*_SHORT, 0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11) if r << 4 | s not in _SHORT)]
AC_COUNTS = [1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, len(AC_SYMBOLS) - 4, 0, 0, 0, 0]
DC_CODE, DC_LEN = _canonical(DC_COUNTS, DC_SYMBOLS)
AC_CODE, AC_LEN = _canonical(AC_COUNTS, AC_SYMBOLS)
BITS = np.array([int(v).bit_length() for v in range(256)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _grid(blocks: int) -> tuple[int, int]:
    """Width and height in blocks; fewer than one row's worth of the grid stays unused."""
    rows = -(-blocks // max(ROW_BLOCKS, -(-blocks // SIDE)))
    return -(-blocks // rows), rows


def _header(n_bytes: int, width: int, height: int) -> bytes:
    if width > SIDE or height > SIDE:
        raise ValueError("a payload over 4 GB does not fit one image")
    return (
        b"\xff\xd8" + _segment(0xFE, b"bytes %d" % n_bytes) + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, height * 8, width * 8, 1) + b"\1\x11\0")
        + _segment(0xC4, b"\0" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)) + _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )


#: 32-bit words that hold any block's bits, and one more.
_WORDS = (15 + 63 * 22) // 32 + 2
#: By coefficient: the code with its value bits, and their number, for DC and for AC without a run.
_DC_WORD, _DC_BITS = DC_CODE[BITS] << BITS | np.arange(256), DC_LEN[BITS] + BITS
_AC_WORD, _AC_BITS = AC_CODE[BITS] << BITS | np.arange(256), AC_LEN[BITS] + BITS


def _code_blocks(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of blocks (rows of 64 coefficients) as rows of bytes, and how many bits each has."""
    n = len(v)
    out = np.zeros(n * _WORDS, np.int64)
    base, at = np.arange(n) * _WORDS, np.zeros(n, np.int64)

    def put(rows, word, length):
        o = at[rows]
        i, word = base[rows] + (o >> 5), word << (63 - (o & 31) - length)
        out[i] |= word >> 31
        out[i + 1] |= word << 1 & 0xFFFFFFFF
        at[rows] = o + length

    everything, columns = slice(None), np.ascontiguousarray(v.T)
    put(everything, _DC_WORD[columns[0]], _DC_BITS[columns[0]])
    run = np.zeros(n, np.int64)
    for c in columns[1:]:
        if c.all() and not run.any():
            put(everything, _AC_WORD[c], _AC_BITS[c])
            continue
        rows = np.flatnonzero(c)
        far = rows[run[rows] > 15]
        while len(far):
            put(far, AC_CODE[0xF0], AC_LEN[0xF0])
            run[far] -= 16
            far = far[run[far] > 15]
        value = c[rows].astype(np.int64)
        symbol, size = run[rows] << 4 | BITS[value], BITS[value]
        put(rows, AC_CODE[symbol] << size | value, AC_LEN[symbol] + size)
        run += 1
        run[rows] = 0
    put(np.flatnonzero(run), AC_CODE[0], AC_LEN[0])
    return out.astype(">u4").view(np.uint8).reshape(n, 4 * _WORDS), at


def encode(payloads: Sequence[bytes]) -> list[bytes]:
    """One JPEG file for each byte string, which is padded with zeros to a positive multiple of 64."""
    used = [max(1, -(-len(p) // UNIT)) for p in payloads]
    grids = [_grid(n) for n in used]
    blocks = np.array([w * h for w, h in grids], np.int64)
    if len(payloads) > 1 and blocks.max() > BLOCKS:
        short = [p for p, n in zip(payloads, blocks) if n <= BLOCKS]
        rest = iter(encode(short) if short else [])
        return [next(rest) if n <= BLOCKS else encode([p])[0] for p, n in zip(payloads, blocks)]
    if len(payloads) == 1 and blocks[0] > BLOCKS:  # a long payload, some blocks at a time
        p, n = payloads[0], int(blocks[0])
        parts = [_header(len(p), *grids[0])]
        for a in range(0, n, BLOCKS):
            z = min(a + BLOCKS, n)
            some = p[a * UNIT : z * UNIT]
            out, _ = _scan(np.frombuffer(some + bytes((z - a) * UNIT - len(some)), np.uint8).reshape(-1, UNIT), np.arange(a, z), np.arange(a, z) == n - 1)
            parts.append(out.tobytes())
        return [b"".join([*parts, b"\xff\xd9"])]
    data = b"".join(p + bytes(w * h * UNIT - len(p)) for p, (w, h) in zip(payloads, grids))
    ends = np.zeros(int(blocks.sum()), bool)
    ends[np.cumsum(blocks) - 1] = True
    out, stop = _scan(np.frombuffer(data, np.uint8).reshape(-1, UNIT), spread(blocks), ends)
    start = np.r_[0, stop[:-1]]
    return [_header(len(p), *g) + out[a:b].tobytes() + b"\xff\xd9" for p, g, a, b in zip(payloads, grids, start, stop)]


def _scan(v: np.ndarray, nth: np.ndarray, ends_file: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes of blocks that are the nth of their files, and where each file that ends here stops."""
    n = len(v)
    # Blocks without zeros take the short way; each block's bits start on a byte.
    dense = v.all(1)
    bits, parts = np.zeros(n, np.int64), np.zeros((n, 4 * _WORDS), np.uint8)
    for rows in (np.flatnonzero(dense), np.flatnonzero(~dense)):
        if len(rows):
            parts[rows], bits[rows] = _code_blocks(v[rows])
    row_bytes = (bits + 7) >> 3
    row_at = np.cumsum(row_bytes) - row_bytes
    packed = parts[np.arange(4 * _WORDS) < row_bytes[:, None]]
    fill = row_bytes * 8 - bits
    packed[row_at + row_bytes - 1] |= ((1 << fill) - 1).astype(np.uint8)
    # Stuffing after FF, and a restart marker after each block but a file's last.
    width = 1 + (packed == 255)
    marker = np.where(ends_file, 0, 2)
    last_byte = row_at + row_bytes - 1
    width[last_byte] += marker
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[place] = packed
    marked = np.flatnonzero(marker)
    m = (place + width)[last_byte[marked]] - 2
    out[m], out[m + 1] = 255, 0xD0 + (nth[marked] & 7)
    return out, np.append(place, len(out))[last_byte[ends_file] + 1]


class Frame:
    """What a file's markers say."""

    __slots__ = ("width", "height", "parts", "quant", "tables", "restart", "scan", "n_bytes", "key")

    def __init__(self, media: bytes):
        if media[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quant, self.tables, self.restart, self.n_bytes, self.parts, at = {}, {}, 0, None, None, 2
        while True:
            if media[at] != 0xFF:
                raise ValueError("no marker where one must stand")
            kind, (size,) = media[at + 1], struct.unpack_from(">H", media, at + 2)
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xFE and body.startswith(b"bytes "):
                self.n_bytes = int(body[6:])
            elif kind == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    self.quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1)
                    i += 1 + 64 * (1 + wide)
            elif kind == 0xC0:
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                self.parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(body[5])]
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline file")
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    self.tables[body[i]] = (bytes(body[i + 1 : i + 17]), bytes(body[i + 17 : i + 17 + n]))
                    i += 17 + n
            elif kind == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif kind == 0xDA:
                if body[0] != len(self.parts):
                    raise ValueError("a scan must hold all components")
                for i in range(body[0]):
                    part = next(p for p in self.parts if p[0] == body[1 + 2 * i])
                    part[4], part[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                self.scan = at
                break
        if len(self.parts) == 1:
            self.parts[0][1] = self.parts[0][2] = 1
        self.key = (tuple(sorted(self.tables.items())), tuple(tuple(p[1:]) for p in self.parts))

    def mcus(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def blocks_per_mcu(self) -> int:
        return sum(p[1] * p[2] for p in self.parts)


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: symbol << 8 | code length; length 0 where there is no code."""
    out = np.zeros(1 << 16, np.int64)
    codes, lengths = _canonical(counts, symbols)
    for s in symbols:
        a = int(codes[s]) << (16 - int(lengths[s]))
        out[a : a + (1 << (16 - int(lengths[s])))] = s << 8 | int(lengths[s])
    return out


def decode(files: Sequence[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """Each file's frame and its coefficients, (blocks in scan order, 64) in zigzag order."""
    frames = [Frame(m) for m in files]
    out: list = [None] * len(files)
    groups: dict = {}
    for i, f in enumerate(frames):
        groups.setdefault(f.key, []).append(i)
    for ids in groups.values():
        for i, c in zip(ids, _decode_alike([frames[i] for i in ids], [files[i] for i in ids])):
            out[i] = (frames[i], c)
    return out


def _decode_alike(frames: list[Frame], files: list[bytes]) -> list[np.ndarray]:
    """Coefficients of files that share tables and components, all intervals in lockstep."""
    one = frames[0]
    scans = [m[f.scan :] for f, m in zip(frames, files)]
    raw = np.frombuffer(b"".join(scans) + b"\xff\xd9", np.uint8)
    sizes = np.array([len(s) for s in scans], np.int64)
    starts = np.cumsum(sizes) - sizes
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    stuffed, restarts = ff[after == 0], ff[(after >= 0xD0) & (after <= 0xD7)]
    others = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    stops = others[np.searchsorted(others, starts)]
    owner = np.searchsorted(starts, restarts, "right") - 1
    restarts, owner = restarts[restarts < stops[owner]], owner[restarts < stops[owner]]
    begin = np.r_[starts, restarts + 2]
    order = np.argsort(begin, kind="stable")
    begin, owner = begin[order], np.r_[np.arange(len(files)), owner][order]
    per_mcu = one.blocks_per_mcu()
    mcus = np.array([w * h for w, h in (f.mcus() for f in frames)], np.int64)
    step = np.array([f.restart or m for f, m in zip(frames, mcus)], np.int64)
    nth = spread(np.bincount(owner, minlength=len(files)))
    left = np.minimum(step[owner], mcus[owner] - nth * step[owner]) * per_mcu
    base = np.cumsum(mcus * per_mcu) - mcus * per_mcu
    block = base[owner] + nth * step[owner] * per_mcu
    tables = list(one.tables)
    look = np.concatenate([_lookup(*one.tables[t]) for t in tables])
    part_of = np.array([i for i, p in enumerate(one.parts) for _ in range(p[1] * p[2])])
    dc_of, ac_of = np.array([tables.index(p[4]) for p in one.parts]), np.array([tables.index(0x10 | p[5]) for p in one.parts])
    coef = np.zeros((int((mcus * per_mcu).sum()), 64), np.int16)
    # where each interval's bytes end: before the next one's marker, or at the file's next marker
    stop = np.minimum(np.r_[begin[1:] - 2, len(raw)], stops[owner])
    live = np.flatnonzero(left > 0)
    for some in np.split(live, range(BLOCKS, len(live), BLOCKS)):
        if len(some):
            _decode_run(raw, stuffed, begin[some], stop[some], block[some], left[some], coef, look, part_of, dc_of, ac_of)
    return [coef[b : b + m * per_mcu] for b, m in zip(base, mcus)]


def _decode_run(raw, stuffed, begin, stop, block, left, coef, look, part_of, dc_of, ac_of) -> None:
    """Some intervals, one after another in `raw`, into their blocks of `coef`, all in lockstep."""
    lo, hi, per_mcu = int(begin[0]), int(stop.max()), len(part_of)
    extra = stuffed[np.searchsorted(stuffed, lo) : np.searchsorted(stuffed, hi)] + 1 - lo
    keep = np.ones(hi - lo, bool)
    keep[extra[extra < hi - lo]] = False
    data = np.r_[raw[lo:hi][keep], np.zeros(8, np.uint8)].astype(np.uint32)
    window = (data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]).astype(np.int64)
    bit = (begin - lo - np.searchsorted(extra, begin - lo)) * 8
    k, j, last = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64), np.zeros((len(bit), len(dc_of)), np.int64)
    flat, limit = coef.reshape(-1), (len(window) - 1) * 8
    while len(bit):
        part = part_of[j] if per_mcu > 1 else 0
        first = k == 0
        table = np.where(first, dc_of[part], ac_of[part])
        peek = window[bit >> 3] >> (16 - (bit & 7)) & 0xFFFF
        hit = look[table << 16 | peek]
        symbol = hit >> 8
        if not (hit & 255).all():
            raise ValueError("a scan holds bits that are no code")
        bit = bit + (hit & 255)
        size = symbol & 15
        value = (window[np.minimum(bit, limit) >> 3] << (bit & 7) & 0xFFFFFFFF) >> (32 - size)
        bit = np.minimum(bit + size, limit)
        value = np.where((value >> np.maximum(size - 1, 0) & 1) | (size == 0), value, value - (1 << size) + 1)
        value[size == 0] = 0
        if first.any():
            lanes = np.flatnonzero(first)
            of = part[lanes] if per_mcu > 1 else 0
            last[lanes, of] += value[lanes]
            value[lanes] = last[lanes, of]
        k = k + np.where(first, 0, symbol >> 4)
        put = first | (size > 0)
        where = block * 64 + k
        if put.all() and (k < 64).all():
            flat[where] = value
        else:
            if (k[put] > 63).any():
                raise ValueError("a block has more than 64 coefficients")
            flat[where[put]] = value[put]
        k = np.where(~first & (symbol == 0), 64, k + 1)
        done = k >= 64
        if done.any():
            k, block, left = np.where(done, 0, k), block + done, left - done
            j = np.where(done, (j + 1) % per_mcu, j)
            live = left > 0
            if not live.all():
                bit, block, left, k, j, last = bit[live], block[live], left[live], k[live], j[live], last[live]


def thumbnail(frame: Frame, coef: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block from its DC coefficient alone."""
    across, down = frame.mcus()
    _, h, v, q, _, _ = frame.parts[0]
    dc = coef.reshape(down, across, frame.blocks_per_mcu(), 64)[:, :, : h * v, 0].reshape(down, across, v, h)
    level = dc.transpose(0, 2, 1, 3).reshape(down * v, across * h).astype(np.int64) * int(frame.quant[q][0])
    scale = [-(-s * p // (8 * m)) for s, p, m in ((frame.height, v, max(x[2] for x in frame.parts)), (frame.width, h, max(x[1] for x in frame.parts)))]
    return np.clip((level >> 3) + 128, 0, 255).astype(np.uint8)[: scale[0], : scale[1]]


def feature(frame: Frame, thumb: np.ndarray) -> str:
    """Dimensions, an average hash of the thumbnail at 8x8 samples, and its crc32."""
    grid = thumb[np.arange(8)[:, None] * thumb.shape[0] // 8, np.arange(8) * thumb.shape[1] // 8]
    bits = np.packbits(grid > grid.mean()).tobytes().hex()
    return f"{frame.width}x{frame.height} {bits} {zlib.crc32(thumb.tobytes()):08x}"


def payload(frame: Frame, coef: np.ndarray) -> bytes:
    """The padded payload of a file that `encode` wrote."""
    blocks = max(1, -(-frame.n_bytes // UNIT))
    return coef[:blocks].astype(np.uint8).tobytes()


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_text(df: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text stored as a JPEG file and read back: key, digests and features, and `media` if asked for.

    Defined cases: null text is the empty text, whose payload is 64 zero bytes; null keys and repeated
    rows are kept; a text of any length (below 4 GB, which is more than a column can hold) is one image; an empty table gives an empty
    result; other columns are ignored.
    """
    src = df.select(F.col(key).alias("media_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))
    names = ["media_key", *(c.split()[0] for c in MEDIA.split(", ")), *(["media"] if keep_media else [])]
    schema = f"media_key {dict(src.dtypes)['media_key']}, {MEDIA}" + ", media binary" * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "raw", CHUNK):
            raw = b.column("raw").to_pylist()
            files = encode(raw)
            rows = []
            for (frame, coef), media in zip(decode(files), files):
                back = payload(frame, coef)
                rows.append((frame.n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(frame, thumbnail(frame, coef))) + ((media,) if keep_media else ()))
            columns = [pa.array(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([b.column("media_key"), *columns], names=names)

    return src.mapInArrow(run, schema).withColumnRenamed("media_key", key)
