"""Converters of one file's bytes into text, CSV or a bitmap, with a score of how well each applies.

A converter is a pair of functions: `score(file) -> level` and `convert(file) -> (kind, text, bitmap)`. A file is
a dictionary with data, rsrc, file_type, aux_type, path and source_fs. Levels: 0 not, 1 probably not,
2 always, 3 maybe, 4 probably, 5 yes.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pomona.functions import codecs, disasm

NOT, PROBABLY_NOT, ALWAYS, MAYBE, PROBABLY, YES = range(6)
CONVERTERS: list[tuple[str, Callable, Callable]] = []


def converter(name: str, score: Callable[[dict], int]):
    def add(f):
        CONVERTERS.append((name, score, f))
        return f

    return add


def typed(kind: int, aux: range | None = None, level: int = YES):
    """The level for files of a type (and an aux type in a range), else not."""
    return lambda f: level if f["file_type"] == kind and (aux is None or f["aux_type"] in aux) else NOT


def _ascii(data: bytes) -> str:
    return bytes(b & 0x7F for b in data).decode("ascii")


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\n", "\r\n")


@converter("text", lambda f: ALWAYS)
def text(f):
    """Line ends as CRLF; if every byte is high, blank or zero, without the top bits."""
    d = f["data"]
    high = bool(d) and all(b & 0x80 or b in (0x20, 0) for b in d)
    return "text", _lines(_ascii(d) if high else d.decode("mac_roman")), None


@converter("hex", lambda f: ALWAYS)
def hex_dump(f):
    return "text", hex_lines(f["data"]), None


#: What prints of each byte: its low seven bits, or a dot.
_PRINTED = "".join(chr(b & 0x7F) if 0x20 <= b & 0x7F < 0x7F else "." for b in range(256))


def hex_lines(d: bytes) -> str:
    """``offset: `` 16 bytes in hex, then what prints of them."""
    shown, out = d.decode("latin-1").translate(_PRINTED), []
    digits = d.hex(" ")
    for i in range(0, len(d), 16):
        out.append(f"{i:08x}: {digits[3 * i : 3 * i + 47]:<47} {shown[i : i + 16]}".rstrip())
    return "\r\n".join(out) + "\r\n" * bool(out)


# --- programs

#: Keywords of tokens 80-EA.
APPLESOFT = (
    "END FOR NEXT DATA INPUT DEL DIM READ GR TEXT PR# IN# CALL PLOT HLIN VLIN HGR2 HGR HCOLOR= HPLOT DRAW XDRAW HTAB HOME ROT= SCALE= SHLOAD TRACE NOTRACE NORMAL INVERSE FLASH COLOR= POP VTAB HIMEM: LOMEM: ONERR RESUME RECALL STORE SPEED= LET GOTO RUN IF RESTORE & GOSUB RETURN REM STOP ON WAIT LOAD SAVE DEF POKE PRINT CONT LIST CLEAR GET NEW TAB( TO FN SPC( THEN AT NOT STEP + - * / ^ AND OR > = < SGN INT ABS USR FRE SCRN( PDL POS SQR RND LOG EXP COS SIN TAN ATN PEEK LEN STR$ VAL ASC CHR$ LEFT$ RIGHT$ MID$"
).split()
#: Keywords of tokens 00-7F; _ stands for none.
INTEGER = (
    "HIMEM: _ _ : LOAD SAVE CON RUN RUN DEL , NEW CLR AUTO , MAN HIMEM: LOMEM: + - * / = # >= > <= <> < AND OR MOD ^ + ( , THEN THEN , , \" \" ( ! ! ( PEEK RND SGN ABS PDL RNDX ( + - NOT ( = # LEN( ASC( SCRN( , ( $ $ ( , , ; ; ; , , , TEXT GR CALL DIM DIM TAB END INPUT INPUT INPUT FOR = TO STEP NEXT , RETURN GOSUB REM LET GOTO IF PRINT PRINT PRINT POKE , COLOR= PLOT , HLIN , AT VLIN , AT VTAB = = ) ) LIST , LIST POP NODSP NODSP NOTRACE DSP DSP TRACE PR# IN#"
).split()


@converter("applesoft", typed(0xFC))
def applesoft(f):
    """Each line: its number and its tokens between blanks."""
    d, at, out = f["data"], 0, []
    while at + 4 <= len(d) and d[at : at + 2] != b"\0\0":
        end = d.find(0, at + 4)
        end = len(d) if end < 0 else end
        body = "".join((f" {APPLESOFT[b - 0x80]} " if b - 0x80 < len(APPLESOFT) else f" ?{b:02X} ") if b & 0x80 else chr(b) for b in d[at + 4 : end])
        out.append(f" {int.from_bytes(d[at + 2 : at + 4], 'little')} {body}")
        at = end + 1
    return "text", "\r\n".join(out) + "\r\n", None


def tokenize(source: str, origin: int = 0x801) -> bytes:
    """A program from its listing; keywords are found longest first, outside strings and remarks, past blanks."""
    keys = sorted(range(len(APPLESOFT)), key=lambda i: -len(APPLESOFT[i]))
    lines = []
    for line in source.splitlines():
        line = line.strip()
        digits = len(line) - len(line.lstrip("0123456789"))
        if not digits:
            if line:
                raise ValueError(f"a line without a number: {line[:20]}")
            continue
        body, i, rest, quoted = bytearray(), 0, line[digits:], False
        data = remark = False
        while i < len(rest):
            c = rest[i]
            if remark or quoted or c == '"' or (data and c != ":"):
                quoted ^= c == '"'
                body.append(ord(c))
                i += 1
                continue
            data &= c != ":"
            if c == " ":
                i += 1
                continue
            for k in keys:
                j, word = i, APPLESOFT[k]
                for w in word:  # blanks inside a keyword don't count
                    while j < len(rest) and rest[j] == " ":
                        j += 1
                    if j < len(rest) and rest[j].upper() == w:
                        j += 1
                    else:
                        break
                else:
                    body.append(0x80 + k)
                    i, data, remark = j, word == "DATA", word == "REM"
                    if data or remark:  # the one blank that a listing shows
                        i += rest[i : i + 1] == " "
                    break
            else:
                body.append(ord(c.upper()))
                i += 1
        lines.append((int(line[:digits]), bytes(body)))
    out, at = bytearray(), origin
    for number, body in lines:  # a line's link is the running sum of lengths
        at += 5 + len(body)
        out += at.to_bytes(2, "little") + number.to_bytes(2, "little") + body + b"\0"
    return bytes(out + b"\0\0")


@converter("integer", typed(0xFA))
def integer_basic(f):
    d, at, out = f["data"], 0, []
    while at < len(d) and d[at] >= 4:
        line, i = d[at : at + d[at]], 3
        parts, at = [f"{int.from_bytes(line[1:3], 'little'):5d} "], at + d[at]
        while i < len(line) and line[i] != 1:
            b = line[i]
            if b in (0x28, 0x5D):  # a string or a remark goes on in high bytes
                parts.append('"' if b == 0x28 else " REM ")
                i += 1
                while i < len(line) and line[i] not in (0x29, 1):
                    parts.append(chr(line[i] & 0x7F))
                    i += 1
                if b == 0x28 and i < len(line) and line[i] == 0x29:
                    parts.append('"')
                    i += 1
            elif 0xB0 <= b <= 0xB9:
                parts.append(str(int.from_bytes(line[i + 1 : i + 3], "little")))
                i += 3
            elif b & 0x80:
                while i < len(line) and line[i] & 0x80:
                    parts.append(chr(line[i] & 0x7F))
                    i += 1
            else:
                word = INTEGER[b]
                parts.append(f" {word} " if word.isalpha() else word)
                i += 1
        out.append("".join(parts).rstrip())
    return "text", "\r\n".join(out) + "\r\n" * bool(out), None


@converter("disassembly", lambda f: MAYBE if f["file_type"] in (0x06, 0xFF, 0xFE) else NOT)
def disassembly(f):
    return "text", disasm.listing(f["data"], f["aux_type"] or 0x2000), None


# --- documents


@converter("pascal_text", lambda f: YES if f["file_type"] == 0x03 else NOT)
def pascal_text(f):
    """Past the first kilobyte: lines that may begin with a DLE and a blank count; zeros fill up blocks."""
    out = []
    for line in f["data"][1024:].replace(b"\0", b"").split(b"\r"):
        indent = ""
        if line[:1] == b"\x10" and len(line) > 1:
            indent, line = " " * max(0, line[1] - 32), line[2:]
        out.append(indent + line.decode("latin-1"))
    return "text", "\r\n".join(out), None


def _texty(d: bytes) -> bool:
    return sum(b & 0x7F < 0x20 and b & 0x7F not in (9, 10, 13) for b in d) <= len(d) // 100


@converter("cpm_text", lambda f: PROBABLY if f.get("source_fs") == "CP/M" and _texty(f["data"].split(b"\x1a")[0]) else NOT)
def cpm_text(f):
    return "text", _lines(_ascii(f["data"].split(b"\x1a")[0])), None


@converter("magic_window", lambda f: MAYBE if f["data"][:1] == b"\x8d" and len(f["data"]) > 256 and all(b & 0x80 for b in f["data"][256:]) else NOT)
def magic_window(f):
    return "text", _lines(_ascii(f["data"][256:])), None


@converter("gutenberg", lambda f: YES if f.get("source_fs") == "Gutenberg" else NOT)
def gutenberg(f):
    return "text", _lines(_ascii(f["data"].replace(b"\0", b""))), None


@converter("appleworks_wp", typed(0x1A))
def appleworks_wp(f):
    """Line records after a 300-byte header: text, carriage returns and commands."""
    d, at, out = f["data"], 300 + (2 if len(f["data"]) > 183 and f["data"][183] else 0), []
    while at + 2 <= len(d):
        low, code = d[at], d[at + 1]
        at += 2
        if low == 0xFF and code == 0xFF:
            break
        if code == 0xD0:
            out.append("\r\n")
        elif code == 0:
            n = low
            body = d[at : at + n]
            out.append("".join(chr(b) if 0x20 <= b < 0x7F else " " if b in (0x0B, 0x16) else "" for b in body[2:]))
            if body[1:2] and body[1] & 0x80:
                out.append("\r\n")
            at += n
    return "text", "".join(out), None


def _cell(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


@converter("appleworks_db", typed(0x19))
def appleworks_db(f):
    """A header row of category names, then the records; the first one holds standard values and is left out."""
    d = f["data"]
    count, reports = d[35], d[38]
    names = [d[357 + 22 * i + 1 : 357 + 22 * i + 1 + d[357 + 22 * i]].decode("mac_roman") for i in range(count)]
    out, at, first = [",".join(map(_cell, names))], int.from_bytes(d[:2], "little") + 2 + 600 * reports, True
    while at + 2 <= len(d):
        n = int.from_bytes(d[at : at + 2], "little")
        if n == 0xFFFF:
            break
        body, at, cells, i = d[at + 2 : at + 2 + n], at + 2 + n, [], 0
        while i < len(body) and body[i] != 0xFF:
            b = body[i]
            if 0x81 <= b <= 0x9E:
                cells += [""] * (b - 0x80)
                i += 1
            else:
                cells.append(_db_value(body[i + 1 : i + 1 + b]))
                i += 1 + b
        if not first:
            out.append(",".join(_cell(c) for c in (cells + [""] * count)[:count]))
        first = False
    return "csv", "\r\n".join(out) + "\r\n", None


def _db_value(raw: bytes) -> str:
    if len(raw) == 6 and raw[0] == 0xC0:  # year, month letter, day
        year, month, day = raw[1:3].decode("ascii"), raw[3] - 65, raw[4:6].decode("ascii")
        if year.isdigit() and 0 <= month < 12:
            names = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
            return f"{day}-{names[month]}-{'20' if year[0] < '7' else '19'}{year}"
    if len(raw) == 4 and raw[0] == 0xD4:  # hour letter, minute
        hour = raw[1] - 65
        if 0 <= hour < 24:
            return f"{hour % 12 or 12}:{raw[2:4].decode('ascii')} {'PM' if hour > 11 else 'AM'}"
    return raw.decode("mac_roman")


#: Spreadsheet tokens from C0 on; _ stands for none.
SHEET = "@Deg @Rad @Pi @True @False @Not @IsBlank @IsNA @IsError @Exp @Ln @Log @Cos @Sin @Tan @ACos @ASin @ATan2 @ATan @Mod @FV @PV @PMT @Term @Rate @Round @Or @And @Sum @Avg @Choose @Count @Error @IRR @If @Int @Lookup @Max @Min @NA @NPV @Sqrt @Abs _ <> >= <= = > < , ^ ) - + / * ( - + ...".split()


def column_name(n: int) -> str:
    return (chr(64 + n // 26) if n >= 26 else "") + chr(65 + n % 26)


@converter("appleworks_ss", typed(0x1B))
def appleworks_ss(f):
    """Sparse rows, padded; constants as numbers, formulas as text with their references resolved, never evaluated."""
    d = f["data"]
    at, out, last = 300 + (2 if d[242:243] not in (b"", b"\0") else 0), [], 0
    while at + 2 <= len(d):
        n = int.from_bytes(d[at : at + 2], "little")
        if n == 0xFFFF:
            break
        body, at = d[at + 2 : at + 2 + n], at + 2 + n
        row, i, cells = int.from_bytes(body[:2], "little"), 2, []
        while i < len(body) and body[i] != 0xFF:
            b = body[i]
            if b >= 0x81:
                cells += [""] * (b - 0x80)
                i += 1
            else:
                cells.append(_sheet_cell(body[i + 1 : i + 1 + b], row, len(cells)))
                i += 1 + b
        out += [""] * (row - last - 1)
        out.append(",".join(map(_cell, cells)))
        last = row
    return "csv", "\r\n".join(out) + "\r\n" * bool(out), None


def _number(raw: bytes) -> str:
    v = struct.unpack("<d", raw)[0]
    return f"{v:f}" if math.isfinite(v) else "NaN"


def _sheet_cell(raw: bytes, row: int, column: int) -> str:
    if not raw:
        return ""
    if not raw[0] & 0x80:
        return chr(raw[1]) * 8 if raw[0] & 0x20 and len(raw) > 1 else raw[1:].decode("mac_roman")
    if raw[0] & 0x20:
        return _number(raw[2:10].ljust(8, b"\0"))
    out, i = "", 10
    while i < len(raw):
        b = raw[i]
        i += 1
        if b == 0xFD:
            out, i = out + _number(raw[i : i + 8].ljust(8, b"\0")), i + 8
        elif b == 0xFE:
            c, r = raw[i] - 256 if raw[i] > 127 else raw[i], int.from_bytes(raw[i + 1 : i + 3], "little", signed=True)
            out, i = out + f"{column_name(column + c)}{row + r}", i + 3
        elif b == 0xFF:
            n = raw[i]
            out, i = out + raw[i + 1 : i + 1 + n].decode("mac_roman"), i + 1 + n
        elif 0xC0 <= b < 0xC0 + len(SHEET):
            out += SHEET[b - 0xC0]
    return out


@converter("directory", lambda f: YES if f["file_type"] == 0x0F and f.get("source_fs") == "ProDOS" else NOT)
def directory(f):
    """Active rows of raw directory blocks, then deleted ones."""
    rows = {True: [], False: []}
    for b in range(0, len(f["data"]) - 511, 512):
        for i in range(13):
            e = f["data"][b + 4 + 39 * i : b + 43 + 39 * i]
            name = e[1:16].split(b"\0")[0].decode("latin-1") if not e[0] & 15 else e[1 : 1 + (e[0] & 15)].decode("latin-1")
            if e[0] >> 4 < 0xE and name:
                rows[e[0] != 0].append(f"{name:<15} ${e[16]:02X} {int.from_bytes(e[19:21], 'little'):5d} {int.from_bytes(e[21:24], 'little'):8d}")
    return "text", "\r\n".join(rows[True] + ["Deleted:"] + rows[False]) + "\r\n", None


# --- pictures


def bmp(pixels: np.ndarray) -> bytes:
    """A 24-bit bitmap file of (height, width, 3) red-green-blue pixels."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def _grey(bits: np.ndarray) -> np.ndarray:
    return np.repeat((bits[..., None] * 255).astype(np.uint8), 3, -1)


def hires_rows() -> np.ndarray:
    """Offsets of the 192 rows of a hi-res screen."""
    y = np.arange(192)
    return (y & 7) * 1024 + (y >> 3 & 7) * 128 + (y >> 6) * 40


#: Violet, green, blue, orange.
HIRES_COLOURS = np.array([(221, 34, 221), (17, 221, 0), (34, 34, 255), (255, 102, 0)], np.uint8)


def hires(data: bytes, colour: bool = True) -> np.ndarray:
    """280x192: adjacent dots are white; a lone dot's colour follows its column and its byte's top bit."""
    x = np.frombuffer(data.ljust(8192, b"\0")[:8192], np.uint8)[hires_rows()[:, None] + np.arange(40)]
    bits = (x[..., None] >> np.arange(7) & 1).reshape(192, 280).astype(bool)
    if not colour:
        return _grey(bits)
    high = np.repeat(x >> 7, 7, 1)
    beside = np.zeros_like(bits)
    beside[:, 1:] |= bits[:, :-1]
    beside[:, :-1] |= bits[:, 1:]
    out = np.zeros((192, 280, 3), np.uint8)
    lone = bits & ~beside
    out[lone] = HIRES_COLOURS[(high * 2 + np.arange(280) % 2)[lone]]
    out[bits & beside] = 255
    return out


def double_hires(data: bytes) -> np.ndarray:
    """560x192 in black and white, from the auxiliary half and the main half."""
    d = np.frombuffer(data.ljust(16384, b"\0")[:16384], np.uint8)
    at = hires_rows()[:, None] + np.arange(40)
    both = np.stack([d[at], d[8192 + at]], -1).reshape(192, 80)
    return _grey((both[..., None] >> np.arange(7) & 1).reshape(192, 560))


def super_hires(data: bytes) -> np.ndarray:
    """640x400 from a 32 KB screen: rows, a control byte for each, 16 palettes of 16 colours."""
    d = data.ljust(32768, b"\0")
    rows, scb = np.frombuffer(d, np.uint8, 32000).reshape(200, 160), np.frombuffer(d, np.uint8, 200, 0x7D00)
    c = np.frombuffer(d, "<u2", 256, 0x7E00).reshape(16, 16)
    rgb = (np.stack([c >> 8 & 15, c >> 4 & 15, c & 15], -1) * 17).astype(np.uint8)
    out = np.zeros((200, 640, 3), np.uint8)
    for y in range(200):
        palette = rgb[scb[y] & 15]
        if scb[y] & 0x80:
            p = (rows[y][:, None] >> np.array([6, 4, 2, 0]) & 3).reshape(-1)
            out[y] = palette[p + np.tile([8, 12, 0, 4], 160)]
        else:
            p = (rows[y][:, None] >> np.array([4, 0]) & 15).reshape(-1)
            out[y] = np.repeat(palette[p], 2, 0)
    return np.repeat(out, 2, 0)


def _picture(f, pixels):
    return "bitmap", None, bmp(pixels)


@converter("hires", lambda f: PROBABLY if f["file_type"] in (0x06, 0x08) and 8184 <= len(f["data"]) <= 8192 else NOT)
def hires_picture(f):
    return _picture(f, hires(f["data"]))


@converter("double_hires", lambda f: PROBABLY if f["file_type"] in (0x06, 0x08) and 16376 <= len(f["data"]) <= 16384 else NOT)
def double_hires_picture(f):
    return _picture(f, double_hires(f["data"]))


@converter("super_hires", lambda f: YES if f["file_type"] == 0xC1 and len(f["data"]) >= 32000 else NOT)
def super_hires_picture(f):
    return _picture(f, super_hires(f["data"]))


@converter("packed_super_hires", typed(0xC0, range(1, 2)))
def packed_super_hires(f):
    return _picture(f, super_hires(codecs.unpack_bytes(f["data"], 32768)))


@converter("macpaint", lambda f: PROBABLY if f["file_type"] == 0x504E5447 or f["path"].lower().endswith((".mac", ".pntg")) else NOT)
def macpaint(f):
    d = f["data"]
    start = 512 + (128 if d[65:69] == b"PNTG" else 0)
    rows = np.frombuffer(codecs.unpack_bits(d[start:], 72 * 720), np.uint8).reshape(720, 72)
    return _picture(f, _grey(1 - np.unpackbits(rows, axis=1)))


@converter("print_shop", lambda f: PROBABLY if f["file_type"] == 0x06 and len(f["data"]) in (572, 576) else NOT)
def print_shop(f):
    rows = np.frombuffer(f["data"][:572], np.uint8).reshape(52, 11)
    return _picture(f, np.repeat(np.repeat(_grey(1 - np.unpackbits(rows, axis=1)), 3, 0), 2, 1))


# --- choice and use

OUTPUTS = "converter string, level int, kind string, text string, bitmap binary, error string"


def scores(f: dict) -> list[tuple[str, int]]:
    out = []
    for name, score, _ in CONVERTERS:
        try:
            level = score(f)
        except (ValueError, IndexError):
            level = NOT
        out.append((name, level))
    return out


def choose(f: dict) -> tuple[str, int]:
    """The converter of the highest level; ties keep the first."""
    return max(scores(f), key=lambda x: x[1])


def convert(f: dict, name: str | None = None) -> dict:
    """What a converter (by default the best) makes of a file; a failure is an output of its own kind."""
    level = None
    if name is None:
        name, level = choose(f)
    function = next(c for n, _, c in CONVERTERS if n == name)
    try:
        kind, text_out, bitmap = function(f)
        return dict(converter=name, level=level, kind=kind, text=text_out, bitmap=bitmap, error=None)
    except (ValueError, IndexError, struct.error) as e:
        return dict(converter=name, level=level, kind="error", text=None, bitmap=None, error=str(e)[:200])


def outputs(entries: DataFrame, name: str | None = None) -> DataFrame:
    """Entries with payloads, converted: volume_id, ordinal, path and the output. Rows without either fork are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                f = {**r, "data": bytes(r["data"] or b""), "rsrc": None if r["rsrc"] is None else bytes(r["rsrc"]), "file_type": int(r["file_type"] or 0), "aux_type": int(r["aux_type"] or 0)}
                rows.append({k: r[k] for k in ("volume_id", "ordinal", "path")} | convert(f, name))
            if rows:
                yield pd.DataFrame(rows)

    src = entries.where("data is not null or rsrc is not null").select("volume_id", "ordinal", "path", "file_type", "aux_type", "source_fs", "data", "rsrc")
    return src.mapInPandas(run, f"volume_id string, ordinal int, path string, {OUTPUTS}")


from pomona.functions import documents as _documents  # noqa: E402, F401
from pomona.functions import listing16 as _listing16  # noqa: E402, F401
from pomona.functions import more_converters as _more  # noqa: E402, F401
from pomona.functions import pictures as _pictures  # noqa: E402, F401
