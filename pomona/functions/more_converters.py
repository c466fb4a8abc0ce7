"""Further converters: assembler sources, segments and resources, pictures of many colours. Imported for their registration."""

from __future__ import annotations

import struct

import numpy as np

from pomona.functions import converters as C

#: Columns of a Merlin source's fields.
STOPS = (9, 15, 26)


#: Percentages that a source's lines must exceed, those that start with one blank and those with remarks too.
SPACED, SPACED_OR_REMARKS = 40, 50


def _is_merlin(d: bytes) -> bool:
    if not d or any(not b & 0x80 and b != 0x20 for b in d):
        return False
    lines = [x for x in d.split(b"\x8d")]
    lines = lines[:-1] if not lines[-1] else lines
    spaced = sum(x[:1] in (b" ", b"\xa0") and len(x) > 1 and x[1] & 0x7F != 0x20 for x in lines)
    remarks = sum(x[:1] == b"\xaa" for x in lines)
    return spaced * 100 // len(lines) > SPACED or (spaced + remarks) * 100 // len(lines) > SPACED_OR_REMARKS


def _merlin(f: dict) -> int:
    """Its contents and its name's ``.S`` decide together."""
    if f["file_type"] != 0x04:
        return C.NOT
    source, named = _is_merlin(f["data"]), f.get("path", "").upper().endswith(".S")
    return (C.YES if named else C.PROBABLY) if source else C.PROBABLY_NOT if named else C.NOT


@C.converter("merlin", _merlin)
def merlin(f):
    """Label, operation, operand and remark in columns, parted by blanks with the top bit; others, and those in quotes, part nothing."""
    out = []
    for raw in f["data"].split(b"\x8d"):
        if raw[:1] in (b"\xaa", b"*"):
            out.append(C._ascii(raw))
            continue
        line, field, quote = "", 0, ""
        for b in raw:
            ch = chr(b & 0x7F)
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "\"'" and field:
                quote = ch
            elif ch == ";" and field < 3 and (not line or line[-1] == " "):
                field = 3
                line = line.ljust(STOPS[2])
            elif b == 0xA0 and field < 3:
                line = line.ljust(STOPS[field]) if len(line) < STOPS[field] else line + " "
                field += 1
                continue
            line += ch
        out.append(line.rstrip())
    return "text", "\r\n".join(out), None


@C.converter("sc_assembler", lambda f: C.MAYBE if f["file_type"] == 0xFA and _sc_lines(f["data"]) else C.NOT)
def sc_assembler(f):
    return "text", "".join(f"{n:04d} {t}\r\n" for n, t in _sc_lines(f["data"])), None


def _sc_lines(d: bytes) -> list[tuple[int, str]]:
    """Lines: length, number, text in which 80-BF stand for blanks and C0 for a run; a zero ends each."""
    out, at = [], 0
    while at < len(d) and d[at]:
        line = d[at : at + d[at]]
        if len(line) < 4 or line[-1] or len(line) < d[at]:
            return []
        text, i = "", 3
        while i < len(line) - 1:
            b = line[i]
            if b == 0xC0 and i + 2 < len(line):
                text, i = text + chr(line[i + 2] & 0x7F) * line[i + 1], i + 2
            elif 0x80 <= b < 0xC0:
                text += " " * (b & 0x3F)
            elif 0x20 <= b < 0x7F:
                text += chr(b)
            else:
                return []
            i += 1
        out.append((int.from_bytes(line[1:3], "little"), text))
        at += d[at]
    return out


@C.converter("pascal_code", C.typed(0x02))
def pascal_code(f):
    """The segment dictionary of the first block."""
    d = f["data"].ljust(512, b"\0")
    kinds = "LINKED HOSTSEG SEGPROC UNITSEG SEPRTSEG UNLINKED-INTRINS LINKED-INTRINS DATASEG".split()
    out = []
    for i in range(16):
        at, size = struct.unpack_from("<HH", d, 4 * i)
        name = d[64 + 8 * i : 72 + 8 * i].decode("latin-1").rstrip()
        kind = struct.unpack_from("<H", d, 192 + 2 * i)[0]
        if size:
            info = struct.unpack_from("<H", d, 256 + 2 * i)[0]
            out.append(f"{i:2d} {name:<8} block {at:3d} length {size:5d} {kinds[kind] if kind < 8 else '?'} segment {info & 0xFF} machine {info >> 8 & 15}")
    return "text", "\r\n".join(out) + "\r\n" * bool(out), None


def resources(rsrc: bytes) -> list[dict]:
    """The rows of a resource fork's index: type, id, offset, attributes, size."""
    version, map_at, map_size = struct.unpack_from("<III", rsrc)
    if version or map_at + map_size > len(rsrc):
        raise ValueError("no resource fork")
    to_index = struct.unpack_from("<H", rsrc, map_at + 14)[0]
    used = struct.unpack_from("<I", rsrc, map_at + 24)[0]
    out = []
    for i in range(used):
        kind, number, at, attributes, size, _ = struct.unpack_from("<HIIHII", rsrc, map_at + to_index + 20 * i)
        if kind == 0 or at + size > len(rsrc):
            raise ValueError("a damaged resource index")
        out.append(dict(kind=kind, id=number, offset=at, attributes=attributes, size=size))
    return out


@C.converter("resource_fork", lambda f: C.YES if f.get("rsrc") and not f["data"] else C.NOT)
def resource_fork(f):
    """Each resource's head and its bytes."""
    out = []
    for r in resources(f["rsrc"]):
        out.append(f"Type ${r['kind']:04X} id ${r['id']:08X} attributes ${r['attributes']:04X} length {r['size']}\r\n" + C.hex_lines(f["rsrc"][r["offset"] : r["offset"] + r["size"]]))
    return "text", "\r\n".join(out), None


#: The sixteen colours of the four-bit modes.
LORES = np.array([(0, 0, 0), (221, 0, 51), (0, 0, 153), (221, 34, 221), (0, 119, 34), (85, 85, 85), (34, 34, 255), (102, 170, 255), (136, 85, 0), (255, 102, 0), (170, 170, 170), (255, 153, 136), (17, 221, 0), (255, 255, 0), (68, 255, 153), (255, 255, 255)], np.uint8)


def double_hires_colour(data: bytes) -> np.ndarray:
    """140 pixels of four bits a row, each four dots wide."""
    dots = C.double_hires(data)[..., 0] // 255
    nibble = dots.reshape(192, 140, 4)
    # a pixel's bits count round by its place, as the colour signal does
    value = (nibble * np.array([1, 2, 4, 8])).sum(-1)
    turned = (value << 1 | value >> 3) & 15
    return np.repeat(LORES[turned], 4, 1)


@C.converter("double_hires_colour", lambda f: C.MAYBE if f["file_type"] in (0x06, 0x08) and 16376 <= len(f["data"]) <= 16384 else C.NOT)
def double_hires_colour_picture(f):
    return C._picture(f, double_hires_colour(f["data"]))


def many_colours(data: bytes) -> np.ndarray:
    """640x400: a palette for each row, its colours from the last to the first."""
    d = data.ljust(38400, b"\0")
    rows = np.frombuffer(d, np.uint8, 32000).reshape(200, 160)
    c = np.frombuffer(d, "<u2", 3200, 32000).reshape(200, 16)[:, ::-1]
    rgb = (np.stack([c >> 8 & 15, c >> 4 & 15, c & 15], -1) * 17).astype(np.uint8)
    p = (rows[:, :, None] >> np.array([4, 0]) & 15).reshape(200, 320)
    out = rgb[np.arange(200)[:, None], p]
    return np.repeat(np.repeat(out, 2, 1), 2, 0)


@C.converter("many_colours", C.typed(0xC1, range(2, 3)))
def many_colours_picture(f):
    return C._picture(f, many_colours(f["data"]))


#: Business BASIC's keywords of tokens 80-EF, and those behind an FF by their codes; _ stands for none.
BUSINESS = (
    "END FOR NEXT INPUT OUTPUT DIM READ WRITE OPEN CLOSE _ TEXT _ BYE _ _ _ _ _ WINDOW INVOKE PERFORM _ _ FRE HPOS VPOS ERRLIN ERR KBD EOF TIME$ DATE$ PREFIX$ EXFN. EXFN%. OUTREC INDENT _ _ _ _ _ _ _ POP HOME _ "
    "SUB$( OFF TRACE NOTRACE NORMAL INVERSE SCALE( RESUME _ LET GOTO IF RESTORE SWAP GOSUB RETURN REM STOP ON _ LOAD SAVE DELETE RUN RENAME LOCK UNLOCK CREATE EXEC CHAIN _ _ _ CATALOG _ _ DATA IMAGE CAT DEF "
    "_ PRINT DEL ELSE CONT LIST CLEAR GET NEW TAB TO SPC( USING THEN _ MOD STEP AND OR EXTENSION DIV _ FN NOT"
).split()
BUSINESS_MORE = {
    0x80: "TAB( TO SPC( USING THEN _ MOD STEP AND OR EXTENSION DIV _ FN NOT", 0x9C: "AS SGN( INT( ABS( _ TYP( REC(", 0xAD: "PDL( BUTTON( SQR( RND( LOG( EXP( COS( SIN( TAN( ATN(",
    0xC3: "STR$( HEX$( CHR$( LEN( VAL( ASC( TEN( _ _ CONV( CONV&( CONV$( CONV%( LEFT$( RIGHT$( MID$( INSTR(",
}
#: Keywords behind which no blank goes; of those behind an FF, all that open a bracket.
CLOSE_UP = {"HPOS", "VPOS", "TIME$", "DATE$", "PREFIX$", "EXFN.", "EXFN%.", "SUB$(", "SCALE(", "REM", "SPC("}
_MORE = {first + i: word for first, run in BUSINESS_MORE.items() for i, word in enumerate(run.split())}


@C.converter("business_basic", C.typed(0x09))
def business_basic(f):
    """Lines of a length, a number and tokens; loops are indented, keywords parted by single blanks."""
    d, at, out, depth = f["data"], 2, [], 0
    while at + 3 <= len(d) and d[at]:
        number = int.from_bytes(d[at + 1 : at + 3], "little")
        end = d.find(0, at + 3)
        body, line, tight, shown = d[at + 3 : end if end >= 0 else len(d)], f" {number}   " + "  " * depth, True, False
        codes = iter(body)
        for b in codes:
            if b < 0x80:
                tight |= b == 0x3A
                if not tight and not shown:
                    line, shown = line + " ", True
                line += chr(b)
                continue
            depth += (b == 0x81) - (b == 0x82)
            extended = b == 0xFF
            word = _MORE.get(next(codes, 0), "_") if extended else BUSINESS[b - 0x80] if b - 0x80 < len(BUSINESS) else "_"
            word = "*error*" if word == "_" else word
            line += ("" if tight else " ") + word
            tight, shown = word.endswith("(") if extended else word in CLOSE_UP, False
        out.append(line)
        if end < 0:
            break
        at = end + 1
    return "text", "\r\n".join(out) + "\r\n", None
