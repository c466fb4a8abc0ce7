"""Further super hi-res pictures: whole pages, odd dumps, chunked files and those packed with LZW."""

from __future__ import annotations

import numpy as np

from pomona.functions import codecs
from pomona.functions import converters as C
from pomona.functions import more_converters as M

SCREEN, ROWS, WIDE = 32768, 200, 160


def _palette(data: bytes, tables: int = 1) -> np.ndarray:
    c = np.frombuffer(data.ljust(32 * tables, b"\0"), "<u2", 16 * tables).reshape(tables, 16)
    return (np.stack([c >> 8 & 15, c >> 4 & 15, c & 15], -1) * 17).astype(np.uint8)


def _rows(rows: np.ndarray, modes: np.ndarray, palettes: np.ndarray) -> np.ndarray:
    """Rows of packed pixels, a control byte for each; every pixel is two dots wide and high (one wide in 640 mode)."""
    out = np.zeros((len(rows), 4 * rows.shape[1], 3), np.uint8)
    for y, (row, mode) in enumerate(zip(rows, modes.tolist())):
        colours = palettes[mode & 15 if (mode & 15) < len(palettes) else 0]
        if mode & 0x80:
            p = (row[:, None] >> np.array([6, 4, 2, 0]) & 3).reshape(-1)
            out[y] = colours[p + np.tile([8, 12, 0, 4], len(row))]
        else:
            out[y] = np.repeat(colours[(row[:, None] >> np.array([4, 0]) & 15).reshape(-1)], 2, 0)
    return np.repeat(out, 2, 0)


#: Length of a screen without the unused control bytes and with one palette.
DUMP = 32288


@C.converter("super_hires_dump", lambda f: C.MAYBE if len(f["data"]) == DUMP and f["file_type"] in (0x06, 0xC1) else C.NOT)
def super_hires_dump(f):
    """Rows, 256 control bytes and one palette."""
    d = f["data"]
    if len(d) != DUMP:
        raise ValueError(f"not {DUMP} bytes")
    return C._picture(f, C.super_hires(d[:0x7E00] + d[0x7E00:0x7E20] + bytes(SCREEN - 0x7E20)))


#: Rows of a whole page, and where its packed rows begin behind palette, background and patterns.
PAGE_ROWS, PAGE_DATA = 396, 0x222


@C.converter("paintworks", C.typed(0xC0, range(0, 1), C.PROBABLY))
def paintworks(f):
    """A page of 396 rows with one palette; missing rows are of colour 0."""
    d = f["data"]
    if len(d) < PAGE_DATA:
        raise ValueError("too short for a page")
    rows = codecs.unpack_bytes(d[PAGE_DATA:], PAGE_ROWS * WIDE, exact=False).ljust(PAGE_ROWS * WIDE, b"\0")
    return C._picture(f, _rows(np.frombuffer(rows, np.uint8).reshape(PAGE_ROWS, WIDE), np.zeros(PAGE_ROWS, np.uint8), _palette(d[:32])))


def blocks(data: bytes) -> list[tuple[str, bytes]]:
    """(name, contents) of a chunked picture's blocks: a length of all, a counted name, contents."""
    out, at = [], 0
    while at + 5 <= len(data):
        size, n = int.from_bytes(data[at : at + 4], "little"), data[at + 4]
        if size < 5 + n or at + size > len(data):
            break
        out.append((data[at + 5 : at + 5 + n].decode("mac_roman"), data[at + 5 + n : at + size]))
        at += size
    return out


#: Most dots and rows of a chunked picture.
MOST_DOTS, MOST_ROWS = 1280, 1024


def main_block(d: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, control bytes and palettes of a MAIN block."""
    mode, dots, tables = (int.from_bytes(d[i : i + 2], "little") for i in (0, 2, 4))
    if not 0 < dots <= MOST_DOTS or not 0 < tables <= 16:
        raise ValueError("a picture of impossible size")
    at = 6 + 32 * tables
    palettes, count = _palette(d[6:at], tables), int.from_bytes(d[at : at + 2], "little")
    if not 0 < count <= MOST_ROWS:
        raise ValueError("a picture of impossible height")
    wide = WIDE if dots in (320, 640) and count == ROWS else (dots + 3) // 4 if mode & 0x80 else (dots + 1) // 2
    heads = np.frombuffer(d, "<u2", 2 * count, at + 2).reshape(count, 2)
    at += 2 + 4 * count
    rows = []
    for size in heads[:, 0].tolist():
        row = codecs.unpack_bytes(d[at : at + size], 2 * MOST_DOTS, exact=False)
        if size > dots or len(row) < wide:
            raise ValueError("a row of the wrong length")
        rows.append(row[:wide])
        at += size
    modes = np.where(heads[:, 1] >> 8 == 0, heads[:, 1], 0).astype(np.uint8)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(count, wide), modes, palettes


@C.converter("chunked_super_hires", C.typed(0xC0, range(2, 3), C.PROBABLY))
def chunked_super_hires(f):
    """The MAIN block, with a palette for each row if there is a MULTIPAL block; other blocks are passed over."""
    found = dict(reversed(blocks(f["data"])))
    if "MAIN" not in found:
        raise ValueError("no MAIN block")
    rows, modes, palettes = main_block(found["MAIN"])
    many = found.get("MULTIPAL", b"")
    if len(many) >= 2 + 32 * ROWS and int.from_bytes(many[:2], "little") == ROWS and rows.shape == (ROWS, WIDE):
        return C._picture(f, _by_row(rows, _palette(many[2:], ROWS)))
    return C._picture(f, _rows(rows, modes, palettes))


def _by_row(rows: np.ndarray, palettes: np.ndarray) -> np.ndarray:
    p = (rows[:, :, None] >> np.array([4, 0]) & 15).reshape(len(rows), -1)
    return np.repeat(np.repeat(palettes[np.arange(len(rows))[:, None], p], 2, 1), 2, 0)


@C.converter("packed_many_colours", lambda f: C.PROBABLY if f["path"].lower().endswith(".3201") else C.NOT)
def packed_many_colours(f):
    """A mark, 200 palettes from the last colour to the first, packed rows."""
    d = f["data"]
    if d[:4] != b"\xc1\xd0\xd0\0":
        raise ValueError("no packed picture of many colours")
    rows = codecs.unpack_bytes(d[4 + 32 * ROWS :], 32000, exact=False)
    return C._picture(f, M.many_colours(rows.ljust(32000, b"\0") + d[4 : 4 + 32 * ROWS]))


def unpack_lzw(data: bytes, most: int = 1 << 16) -> bytes:
    """Codes of 9 to 12 bits, low bits first; 256 clears the table, 257 ends. The width grows when the table is full."""
    out, at, width, table, last = bytearray(), 0, 9, [], b""
    padded = bytes(data) + bytes(4)
    while True:
        if at + width > 8 * len(data) + 7 or len(out) > most:
            raise ValueError("the packed picture has no end")
        code = int.from_bytes(padded[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & (1 << width) - 1
        at += width
        if code == 257:
            return bytes(out)
        if code == 256:
            width, table, last = 9, [], b""
            continue
        if not last:
            word = bytes((code & 0xFF,))
        elif code < 256:
            word = bytes((code,))
        elif code - 258 < len(table):
            word = table[code - 258]
        else:
            word = last + last[:1]
        if last:
            table.append(last + word[:1])
            if 258 + len(table) >= 1 << width and width < 12:
                width += 1
        out += word
        last = word


#: The mark 17 bytes before a file's end behind colours, height and width, and lengths when unpacked.
MARK, PACKED = b"\x0aDreamWorld", {256: (33280, 32768), 3200: (38912, 38400)}


def lzw_head(data: bytes) -> int | None:
    """The number of colours of an LZW-packed picture, or None if it is none."""
    tail = data[-17:]
    if len(data) < 256 or tail[6:] != MARK or tail[2:6] != b"\xc8\0\x40\x01":
        return None
    return 3200 if tail[0] else 256


def _lzw_score(colours: int):
    return lambda f: C.YES if f["file_type"] == 0xC0 and f["aux_type"] == 0x8005 and lzw_head(f["data"]) == colours else C.NOT


def _lzw(f: dict, colours: int) -> bytes:
    d = unpack_lzw(f["data"])
    if len(d) not in PACKED[colours]:
        raise ValueError("a packed picture of the wrong length")
    return d


@C.converter("lzw_256_colours", _lzw_score(256))
def lzw_256_colours(f):
    d = _lzw(f, 256)
    return C._picture(f, C.super_hires(d[:32000] + d[32000:32256] + d[32256:32768]))


@C.converter("lzw_3200_colours", _lzw_score(3200))
def lzw_3200_colours(f):
    return C._picture(f, M.many_colours(_lzw(f, 3200)[:38400]))


def double_hires_blended(data: bytes) -> np.ndarray:
    """560 dots a row, each coloured by the four dots around it as the signal's phase says."""
    dots = (C.double_hires(data)[..., 0] // 255).astype(np.int64)
    wide = np.pad(dots, ((0, 0), (1, 2)))
    window = np.stack([wide[:, i : i + 560] for i in range(4)], -1)
    # a dot's bit in the colour is its place in the line modulo four
    place = (np.arange(560)[:, None] + np.arange(4) - 1) % 4
    value = (window << place).sum(-1)
    turned = (value << 1 | value >> 3) & 15
    return np.where(dots[..., None] | (window.sum(-1) > 1)[..., None], M.LORES[turned], 0).astype(np.uint8)


def double_hires_sliding(data: bytes) -> np.ndarray:
    """560 dots a row, each coloured by itself and the three before it."""
    dots = (C.double_hires(data)[..., 0] // 255).astype(np.int64)
    wide = np.pad(dots, ((0, 0), (3, 0)))
    window = np.stack([wide[:, i : i + 560] for i in range(4)], -1)
    place = (np.arange(560)[:, None] + np.arange(4) - 3) % 4
    value = (window << place).sum(-1)
    return M.LORES[(value << 1 | value >> 3) & 15]


def _double(f: dict) -> int:
    return C.MAYBE if f["file_type"] in (0x06, 0x08) and 16376 <= len(f["data"]) <= 16384 else C.NOT


@C.converter("double_hires_blended", _double)
def double_hires_blended_picture(f):
    return C._picture(f, double_hires_blended(f["data"]))


@C.converter("double_hires_sliding", _double)
def double_hires_sliding_picture(f):
    return C._picture(f, double_hires_sliding(f["data"]))
