"""65816 listings, and the segments of object modules."""

from __future__ import annotations

import struct

from pomona.functions import converters as C
from pomona.functions import disasm

#: Operand format and bytes by addressing mode; {0} is the value, {1} the target of a relative one, {2} its sign and distance.
MODES = {
    "imp": ("", 0), "acc": ("", 0), "imm": ("#{0:02X}", 1), "zp": ("{0:02X}", 1), "zpx": ("{0:02X},X", 1), "zpy": ("{0:02X},Y", 1), "izx": ("({0:02X},X)", 1), "izy": ("({0:02X}),Y", 1), "izp": ("({0:02X})", 1),
    "abs": ("{0:04X}", 2), "abx": ("{0:04X},X", 2), "aby": ("{0:04X},Y", 2), "ind": ("({0:04X})", 2), "iax": ("({0:04X},X)", 2), "rel": ("{1:04X} {{{2}}}", 1),
    "sr": ("{0:02X},S", 1), "sry": ("({0:02X},S),Y", 1), "ilz": ("[{0:02X}]", 1), "ily": ("[{0:02X}],Y", 1), "lng": ("{0:06X}", 3), "lnx": ("{0:06X},X", 3), "ril": ("{1:04X} {{{2}}}", 2), "mov": ("{0:04X}", 2), "int": ("{0:02X}", 1),
}
_GROUP = "ORA AND EOR ADC STA LDA CMP SBC".split()
#: Instructions of the last column that take no operand, and those that stand alone.
LAST = {2: "PHD PLD PHK RTL PHB PLB WAI XBA".split(), 6: "TCS TSC TCD TDC TXY TYX STP XCE".split()}
ALONE = {0x00: ("BRK", "int"), 0x02: ("COP", "int"), 0x42: ("WDM", "int"), 0x22: ("JSL", "lng"), 0x5C: ("JML", "lng"), 0x62: ("PER", "ril"), 0x82: ("BRL", "ril"), 0xC2: ("REP", "imm"), 0xE2: ("SEP", "imm"), 0x44: ("MVP", "mov"), 0x54: ("MVN", "mov"), 0xD4: ("PEI", "zp"), 0xDC: ("JML", "ind"), 0xF4: ("PEA", "abs"), 0xFC: ("JSR", "iax")}


def instruction(op: int) -> tuple[str, str]:
    """Name and addressing mode; every opcode is one."""
    if op in ALONE:
        return ALONE[op]
    if op & 3 == 3:
        column = op >> 2 & 7
        return (LAST[column][op >> 5], "imp") if column in LAST else (_GROUP[op >> 5], ("sr", "ilz", "", "lng", "sry", "ily", "", "lnx")[column])
    return disasm.instruction(op, True)


def width(op: int, short_m: bool, short_x: bool, one_byte_break: bool = False) -> int:
    name, mode = instruction(op)
    if mode == "int" and name != "WDM" and one_byte_break:
        return 1
    if mode == "imm" and name not in ("REP", "SEP"):
        return 2 if (short_x if name in ("CPX", "CPY", "LDX", "LDY") else short_m) else 3
    return 1 + MODES[mode][1]


def _line(bank: int, at: int, part: bytes, text: str, note: str | None = None) -> str:
    return f"{bank:02X}/{at:04X}: {part.hex(' ').upper():<13} {text}" + (f"  {note}" if note else "")


def listing(data: bytes, origin: int = 0, short: bool = False, one_byte_break: bool = False, names: dict[tuple[str, int], str] | None = None) -> list[str]:
    """One line for each instruction: ``bank/address: bytes  name operand``. short: registers of 8 bits.

    Calls of ProDOS 8 (in bank 0) and of GS/OS show the call's number and parameters as data lines. names: what numbers of
    ("p8", n), ("gsos", n) and ("tool", n) calls mean, and addresses ("addr", n).
    """
    names, out, at, before = names or {}, [], 0, b""
    while at < len(data):
        address = origin + at
        bank, low = address >> 16 & 0xFF, address & 0xFFFF
        op = data[at]
        name, mode = instruction(op)
        n = width(op, short, short, one_byte_break)
        part = data[at : at + n].ljust(n, b"\0")
        value = int.from_bytes(part[1:], "little")
        away = value - (1 << 8 * (n - 1)) if mode in ("rel", "ril") and value >> (8 * (n - 1) - 1) else value
        shape = "#{0:04X}" if mode == "imm" and n == 3 else "" if n == 1 else MODES[mode][0]
        text = f"{name} {shape.format(value, (low + n + away) & 0xFFFF, f'-{-away:02X}' if away < 0 else f'+{away:02X}')}".rstrip()
        note, follow = None, 0
        if bank == 0 and part == b"\x20\x00\xbf" and at + 6 <= len(data):
            note, follow = names.get(("p8", data[at + 3]), "(Unknown P8 MLI)"), 3
        elif part == b"\x22\x00\x00\xe1" and before[:1] == b"\xa2" and len(before) == 3:
            note = names.get(("tool", int.from_bytes(before[1:], "little")), "(Unknown tool)")
        elif part == b"\x22\xa8\x00\xe1" and at + 10 <= len(data):
            note, follow = names.get(("gsos", int.from_bytes(data[at + 4 : at + 6], "little")), "(Unknown GS/OS)"), 6
        elif mode in ("abs", "lng"):
            note = names.get(("addr", value))
        out.append(_line(bank, low, part, text, note))
        for size in {0: (), 3: (1, 2), 6: (2, 4)}[follow]:
            start = at + n
            raw = data[start : start + size]
            out.append(f"{bank:02X}/{origin + start & 0xFFFF:04X}: {raw.hex(' ').upper():<17} {raw[::-1].hex().upper()}")
            n += size
        at, before = at + n, part
    return out


#: Kinds of segments, and flags by their bits in versions 2 and before.
SEGMENTS = {0: "CODE", 1: "DATA", 2: "JumpTab", 4: "PathName", 8: "LibDict", 16: "Init", 17: "AbsBank", 18: "DP/Stack"}
FLAGS = ((0x0100, 0, "bankRel"), (0x0200, 0, "skip"), (0x0400, 0, "reload"), (0x0800, 0, "absBank"), (0x1000, 0, "noSpecial"), (0x2000, 0x20, "posnIndep"), (0x4000, 0x40, "private"), (0x8000, 0x80, "dynamic"))
LOAD_NAME = 10


def segment(data: bytes, at: int, library: bool = False) -> dict:
    """The header of the segment that begins at a place; raises if none does."""
    h = data[at : at + 0x44].ljust(0x44, b"\0")
    left = len(data) - at
    version = h[15]
    if left < 0x24 or version > 2:
        raise ValueError("no segment")
    length, reserved, size = struct.unpack_from("<III", h)
    label, kind = h[13], struct.unpack_from("<H", h, 20)[0] if version == 2 else h[12]
    if version < 2 and not (version == 1 and library):
        length *= 512
    if version == 0:
        name_at, number = 0x24, 0
        body = name_at + (label or h[name_at])
        load = b""
    else:
        number, name_at, body = struct.unpack_from("<H4xHH", h, 0x22)
        load = data[at + name_at : at + name_at + LOAD_NAME]
    if not 0x24 <= length <= left or not 0x24 <= name_at <= left - LOAD_NAME or not 0x24 <= body <= left or (version and body < name_at + LOAD_NAME):
        raise ValueError("a segment header with impossible values")
    start = at + name_at + len(load)
    own = data[start : start + label] if label else data[start + 1 : start + 1 + data[start]]
    flags = [text for new, old, text in FLAGS if kind & (new if version == 2 else old)]
    revision = "2.1" if version == 2 and name_at > 0x2C else f"{version}.0"
    return dict(number=number, kind=SEGMENTS.get(kind & 0x1F, "(unknown)"), length=length, size=size, reserved=reserved, version=revision, flags=flags, load_name=load.decode("mac_roman").rstrip("\0 "), name=own.decode("mac_roman").rstrip("\0 "), at=at, body=at + body)


def segments(data: bytes, library: bool = False) -> tuple[list[dict], int]:
    """All segments, and how many bytes at the end are none."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(segment(data, at, library))
        except (ValueError, struct.error, IndexError):
            break
        at += out[-1]["length"]
    return out, len(data) - at


def module(data: bytes, library: bool = False, **options) -> list[str]:
    """A summary of all segments, then each with its header and a listing of its code."""
    found, rest = segments(data, library)
    if not found:
        return ["[ Valid OMF expected but not found ]", *listing(data, **options)]
    out = [";", "; OMF segment summary:", ";"]
    out += [f";  #{i:02d}: {s['kind']:<8} len=0x{s['length']:06x}  loadName='{s['load_name']}' segName='{s['name']}'" for i, s in enumerate(found, 1)]
    out += [f"; (bad header found, ignoring last {rest} bytes)"] * (rest > 0) + [";"]
    for i, s in enumerate(found, 1):
        out += [";", f"; Segment #{i} ({s['number']}): loadName='{s['load_name']}' segName='{s['name']}': ", f";  type={s['kind']}  length={s['length']}  OMF v{s['version']}", ";  flags:" + "".join(f" {f}" for f in s["flags"]), ";"]
        body = data[s["body"] : s["at"] + s["length"]]
        if body[:1] == b"\xf2" and len(body) >= 5:
            out.append(f"OMF: LCONST record (0x{int.from_bytes(body[1:5], 'little'):04x} bytes follow)")
            body = body[5:]
        out += listing(body, **options)
    return out


def _score(f: dict) -> int:
    kind = f["file_type"]
    if kind in (0x06, 0xFF, 0xF0, 0x2B, 0x2E) or (kind == 0 and f.get("source_fs") != "CP/M"):
        return C.PROBABLY_NOT
    return C.YES if 0xB1 <= kind <= 0xBD or kind == 0xF9 else C.NOT


def _text(f: dict, short: bool) -> tuple:
    kind, data = f["file_type"], f["data"]
    if not data:
        raise ValueError("no code")
    if 0xB1 <= kind <= 0xBD:
        lines = module(data, kind == 0xB2, short=short)
    else:
        lines = listing(data, 0x2000 if kind == 0xFF else f["aux_type"] & 0xFFFF if kind in (0x06, 0xF0) else 0, short=short)
    return "text", "\r\n".join(lines) + "\r\n", None


@C.converter("monitor16_long", _score)
def monitor16_long(f):
    """Code for 16-bit registers."""
    return _text(f, False)


@C.converter("monitor16_short", _score)
def monitor16_short(f):
    """Code for 8-bit registers."""
    return _text(f, True)
