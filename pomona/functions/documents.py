"""Styled documents as RTF, plain ones as text, and characters of other sets."""

from __future__ import annotations

import struct

from pomona.functions import converters as C
from pomona.functions import more_converters as M

#: ASCII stand-ins of Mac characters 80-FF.
MAC_FOLD = "AACENOUaaaaaaceeeeiiiinooooouuuutocL$oPBrct'.=AO%+<>YudsPpSaoOao?!-vf=d<>. AAOOo--\"\"''/oyY/o<> f|*,,%AEAEEIIIIOOaOUUUi^~-,**,\"? "
#: Unicode and ASCII stand-ins of the 32 MouseText characters.
MOUSE_TEXT = "\U0001f34e\U0001f34f\u25c4\u23f3\u2713\u2705\u23ce\u2630\u2190\u2026\u2193\u2191\u2594\u21b5\u2589\u21e4\u21e5\u2913\u2912\u2500\u231e\u2192\u2591\u2592\U0001f4c1\U0001f4c2\u2595\u2666\u203e\u256c\u22a1\u258f"
MOUSE_ASCII = "@@^&''/:<_v^-/${}v^-L>**[]|#=#O|"


def mac_fold(data: bytes) -> str:
    """Mac text in ASCII: controls are question marks, accents go."""
    return "".join("?" if b < 0x20 else chr(b) if b < 0x80 else MAC_FOLD[b - 0x80] for b in data)


def mouse_text(code: int, ascii_only: bool = False) -> str:
    if not 0 <= code < 32:
        raise ValueError("no such character")
    return (MOUSE_ASCII if ascii_only else MOUSE_TEXT)[code]


#: Fonts by family number, with the RTF family and what their sizes are multiplied by.
FONTS = {0: ("Chicago", "nil", 1.0), 2: ("Courier New", "modern", 1.0), 3: ("Times New Roman", "roman", 1.0), 4: ("Arial", "swiss", 1.0), 20: ("Times New Roman", "roman", 1.0), 21: ("Arial", "swiss", 1.0), 22: ("Courier New", "modern", 1.0), 0xFFFE: ("Courier New", "modern", 0.9)}
OTHER = ("Arial", "swiss", 1.0)
#: Bits of a text style.
STYLES = ((0x01, "b"), (0x02, "i"), (0x04, "ul"), (0x08, "outl"), (0x10, "shad"), (0x40, "super"), (0x80, "sub"))
BLUE = (0, 0, 255)


class Rtf:
    """An RTF document that is written from front to back; what hasn't changed is not said again."""

    def __init__(self):
        self.fonts: list[tuple] = [OTHER]
        self.body: list[str] = []
        self.state = dict(font=0, size=24, style=0, colour=0, align="ql", factor=1.0)

    def font(self, family: int) -> None:
        known = FONTS.get(family, OTHER)
        if known not in self.fonts:
            self.fonts.append(known)
        self.state["factor"] = known[2]
        self._set("font", self.fonts.index(known), "f")

    def size(self, points: int) -> None:
        self._set("size", max(2, round(2 * points * self.state["factor"])), "fs")

    def _set(self, what: str, value: int, word: str) -> None:
        if self.state[what] != value:
            self.state[what] = value
            self.body.append(f"\\{word}{value} ")

    def style(self, bits: int) -> None:
        old, self.state["style"] = self.state["style"], bits
        self.body += [f"\\{word}{'' if bits & bit else '0' if word not in ('super', 'sub') else ''} " if bits & bit or word not in ("super", "sub") else "\\nosupersub " for bit, word in STYLES if (old ^ bits) & bit]

    def colour(self, on: bool) -> None:
        self._set("colour", int(on), "cf")

    def align(self, word: str) -> None:
        if self.state["align"] != word:
            self.state["align"] = word
            self.body.append(f"\\{word} ")

    def text(self, s: str) -> None:
        for ch in s:
            n = ord(ch)
            if ch in "\\{}":
                self.body.append("\\" + ch)
            elif ch == "\t":
                self.body.append("\\tab ")
            elif n < 0x80:
                self.body.append(ch)
            else:
                units = struct.unpack("<%dh" % (len(ch.encode("utf-16-le")) // 2), ch.encode("utf-16-le"))
                self.body += [f"\\u{u}?" for u in units]

    def paragraph(self) -> None:
        self.body.append("\\par\r\n")

    def page(self) -> None:
        self.body.append("\\page\r\n")

    def note(self, s: str) -> None:
        """What isn't the document's own text, in blue and a fixed width."""
        self.font(22)
        self.size(10)
        self.style(0)
        self.colour(True)
        self.text(s)
        self.colour(False)

    def document(self) -> str:
        fonts = "".join(f"{{\\f{i}\\f{kind} {name};}}" for i, (name, kind, _) in enumerate(self.fonts))
        return f"{{\\rtf1\\ansi\\deff0{{\\fonttbl{fonts}}}{{\\colortbl;\\red{BLUE[0]}\\green{BLUE[1]}\\blue{BLUE[2]};}}\\fs24 " + "".join(self.body) + "}\r\n"


def rtf_text(rtf: str) -> str:
    """The plain text of a document that Rtf wrote."""
    body = rtf[rtf.index("\\fs24 ") + 6 : rtf.rindex("}")]
    out, at = [], 0
    while at < len(body):
        ch = body[at]
        if ch != "\\":
            out.append(ch if ch not in "\r\n" else "")
            at += 1
            continue
        if body[at + 1] in "\\{}":
            out.append(body[at + 1])
            at += 2
            continue
        end = at + 1
        while end < len(body) and body[end].isalpha():
            end += 1
        word, start = body[at + 1 : end], end
        while end < len(body) and (body[end].isdigit() or (body[end] == "-" and end == start)):
            end += 1
        if word == "u":
            out.append(int(body[start:end]))
            at = end + 1  # the stand-in
            continue
        out.append({"par": "\n", "tab": "\t", "page": "\f"}.get(word, ""))
        at = end + (end < len(body) and body[end] == " ")
    units = b"".join(struct.pack("<h", x) if isinstance(x, int) else x.encode("utf-16-le") for x in out)
    return units.decode("utf-16-le")


@C.converter("raw", lambda f: C.ALWAYS)
def raw(f):
    """The bytes as they are, one character each."""
    return "raw", f["data"].decode("latin-1"), None


@C.converter("gs_text", lambda f: C.PROBABLY if f["file_type"] == 0x50 and f["aux_type"] not in (0x5445, 0x8010) else C.NOT)
def gs_text(f):
    """Mac characters, and any line end as CRLF."""
    return "text", C._lines(f["data"].decode("mac_roman")), None


def style_block(d: bytes) -> list[tuple[int, int, int, int]]:
    """(length, font family, size, style) of a style resource's runs; unused ones are left out."""
    version, size = struct.unpack_from("<HI", d)
    if version:
        raise ValueError("no style block")
    at = 6 + size
    (size,) = struct.unpack_from("<I", d, at)
    if size % 12 or at + 8 + size > len(d):
        raise ValueError("a style block of the wrong length")
    styles = [struct.unpack_from("<BBHHHI", d, at + 4 + 12 * i) for i in range(size // 12)]
    at += 4 + size
    (count,) = struct.unpack_from("<I", d, at)
    out = []
    for i in range(count):
        length, place = struct.unpack_from("<II", d, at + 4 + 8 * i)
        if place % 12 or place // 12 >= len(styles):
            raise ValueError("a run without a style")
        if length != 0xFFFFFFFF:
            style, points, family, *_ = styles[place // 12]
            out.append((length, family, points, style))
    return out


@C.converter("teach", lambda f: C.YES if f["file_type"] == 0x50 and f["aux_type"] == 0x5445 else C.NOT)
def teach(f):
    """Text in the data fork, styles in resource 8012 of the resource fork."""
    data, rsrc = f["data"], f.get("rsrc")
    if not data or not rsrc:
        raise ValueError("a fork is missing")
    found = next((r for r in M.resources(rsrc) if r["kind"] == 0x8012 and r["id"] == 1), None)
    if found is None:
        raise ValueError("no style resource")
    out, at = Rtf(), 0
    for length, family, points, style in style_block(rsrc[found["offset"] : found["offset"] + found["size"]]):
        out.font(family)
        out.size(points)
        out.style(style)
        lines = data[at : at + length].decode("mac_roman").split("\r")
        for i, line in enumerate(lines):
            if i:
                out.paragraph()
            out.text(line)
        at += length
    return "rtf", out.document(), None


#: Lengths of a word processor file's header, globals, paragraph entries and rulers; its versions.
HEADER, GLOBALS, ENTRY, RULER, VERSIONS = 282, 386, 12, 52, (0x1011, 0x0006)
ALIGN = ((0x80, "qj"), (0x40, "qr"), (0x20, "qc"), (0x10, "ql"))
TOKENS = {5: "<page>", 6: "<date>", 7: "<time>"}


def _chunk(d: bytes, at: int) -> tuple[dict, int]:
    """Paragraph entries, rulers and text blocks of a document, header or footer, and where the next begins."""
    (count,) = struct.unpack_from("<H", d, at)
    if not count:
        raise ValueError("a chunk without paragraphs")
    entries = [struct.unpack_from("<6H", d, at + 2 + ENTRY * i) for i in range(count)]
    at += 2 + ENTRY * count
    rulers = 1 + max((e[3] for e in entries if e[2] == 0), default=-1)
    bits = [struct.unpack_from("<H", d, at + RULER * i + 2)[0] for i in range(rulers)]
    at += RULER * rulers
    blocks = []
    for _ in range(entries[-1][0] + 1):
        (size,) = struct.unpack_from("<I", d, at)
        if not 0 < size <= 65535 or at + 4 + size > len(d):
            raise ValueError("a text block of the wrong length")
        blocks.append(d[at + 4 : at + 4 + size])
        at += 4 + size
    return dict(entries=entries, rulers=bits, blocks=blocks), at


def _paragraph(out: Rtf, d: bytes) -> None:
    """A header of font, style and size, then text with codes up to a return."""
    if len(d) < 7:
        return
    family, style, points = struct.unpack_from("<HBB", d)
    out.font(family)
    out.size(points)
    out.style(style)
    at = 7
    while at < len(d):
        b = d[at]
        at += 1
        if b == 1:
            out.font(int.from_bytes(d[at : at + 2], "little"))
            at += 2
        elif b in (2, 3, 4):
            if at < len(d) and b < 4:
                (out.style if b == 2 else out.size)(d[at])
            at += 1
        elif b in TOKENS:
            out.colour(True)
            out.text(TOKENS[b])
            out.colour(False)
        elif b == 13:
            break
        else:
            out.text(bytes((b,)).decode("mac_roman"))
    out.paragraph()


def _print(out: Rtf, chunk: dict) -> None:
    for block, offset, kind, ruler, *_ in chunk["entries"]:
        if kind == 1:
            out.note("<page-break>")
            out.paragraph()
            out.page()
            continue
        bits = chunk["rulers"][ruler] if ruler < len(chunk["rulers"]) else 0x10
        out.align(next((word for bit, word in ALIGN if bits & bit), "ql"))
        _paragraph(out, chunk["blocks"][block][offset:])


@C.converter("gs_word_processor", lambda f: C.YES if f["file_type"] == 0x50 and f["aux_type"] == 0x8010 else C.NOT)
def gs_word_processor(f):
    """Header and footer between marks, then the document."""
    d = f["data"]
    if len(d) < HEADER + GLOBALS + 3 or struct.unpack_from("<HH", d) not in [(v, HEADER) for v in VERSIONS] or struct.unpack_from("<H", d, HEADER)[0] > 2:
        raise ValueError("no word processor file")
    chunks, at = [], HEADER + GLOBALS
    for _ in range(3):
        chunk, at = _chunk(d, at)
        chunks.append(chunk)
    out = Rtf()
    for name, chunk in zip(("header", "footer"), chunks[1:]):
        out.note(f"<{name}>")
        out.paragraph()
        _print(out, chunk)
        out.note(f"</{name}>")
        out.paragraph()
    _print(out, chunks[0])
    return "rtf", out.document(), None


#: The operations of a LISA 2 source from 80 on; _ stands for none.
LISA = (
    "BGE BLT BMI BCC BCS BPL BNE BEQ BVS BVC BSB BNM BM1 BNZ BIZ BIM BIP BIC BNC BRA BTR BFL BRK BKS CLV CLC CLD CLI DEX DEY INX INY NOP PHA PLA PHP PLP RTS RTI RSB RTN SEC SEI SED TAX TAY TSX TXA "
    "TXS TYA ADD CPR DCR INR SUB LDD POP PPD STD STP LDR STO SET ___ ADC AND ORA BIT CMP CPX CPY DEC EOR INC JMP JSR ___ LDA LDX LDY STA STX STY XOR LSR ROR ROL ASL ADR EQU ORG OBJ EPZ STR DCM ASC "
    "ICL END LST NLS HEX BYT HBY PAU DFS DCI ... PAG INV BLK DBY TTL SBC ___ LET .IF .EL .FI =__ PHS DPH .DA GEN NOG USR ___"
).split()
LISA_STOPS = (9, 13, 39)


def _lisa(f: dict) -> int:
    if f["file_type"] not in (0xF7, 0xF2, 0x42) or f.get("source_fs") != "DOS":
        return C.NOT
    d = f["data"]
    return C.YES if len(d) >= 8 and int.from_bytes(d[2:4], "little") <= len(d) - 4 else C.MAYBE


@C.converter("lisa", _lisa)
def lisa(f):
    """Counted lines: a label, an operation's code, its operand, a remark."""
    d = f["data"]
    if len(d) < 8:
        raise ValueError("too short for a source")
    left, at, out = int.from_bytes(d[2:4], "little"), 4, []
    if left > len(d) - 4:
        raise ValueError("a source of the wrong length")
    while left > 0 and 0 < d[at] < 255:
        body = d[at + 1 : at + 1 + d[at] - 1]
        out.append(_lisa_line(body))
        left -= d[at] + 1
        at += d[at] + 1
        if at >= len(d):
            break
    return "text", "\r\n".join(out) + "\r\n" * bool(out), None


def _lisa_line(body: bytes) -> str:
    line, operation, operand = "", False, False
    if body[:1] and body[0] >= 0x80:
        line = " " * LISA_STOPS[0]
    elif body[:1] != b";" and len(body) > 8:
        line, body = body[:8].decode("latin-1").split(" ")[0], body[8:]
        if body[:1] == b":":
            line, body = line + ":", body[1:]
        line = line.ljust(LISA_STOPS[0])
    for i, b in enumerate(body):
        if 0x20 <= b < 0x80:
            operand |= operation and b != 0x20
            if not operation or operand or b != 0x20:
                line += chr(b)
        elif b >= 0x80 and operation:
            if len(body) - i > 2:
                line = line.ljust(LISA_STOPS[2]) + ";"
        elif b >= 0x80:
            name = LISA[b - 0x80] if b - 0x80 < len(LISA) else "___"
            line = (line + name.replace("_", " " if name != "___" else "_")).ljust(LISA_STOPS[1])
            operation = True
    return line
