"""6502 and 65C02 listings; the instruction table is built from the opcode's bit fields."""

from __future__ import annotations

#: Operand format and length by addressing mode.
MODES = {"imp": ("", 0), "acc": ("A", 0), "imm": ("#${0:02X}", 1), "zp": ("${0:02X}", 1), "zpx": ("${0:02X},X", 1), "zpy": ("${0:02X},Y", 1), "izx": ("(${0:02X},X)", 1), "izy": ("(${0:02X}),Y", 1), "izp": ("(${0:02X})", 1), "abs": ("${0:04X}", 2), "abx": ("${0:04X},X", 2), "aby": ("${0:04X},Y", 2), "ind": ("(${0:04X})", 2), "iax": ("(${0:04X},X)", 2), "rel": ("${0:04X}", 1)}
#: Instructions outside the regular groups.
SINGLE = dict(zip((0x00, 0x20, 0x40, 0x60, 0x08, 0x28, 0x48, 0x68, 0x88, 0xA8, 0xC8, 0xE8, 0x18, 0x38, 0x58, 0x78, 0x98, 0xB8, 0xD8, 0xF8, 0x8A, 0x9A, 0xAA, 0xBA, 0xCA, 0xEA), "BRK JSR RTI RTS PHP PLP PHA PLA DEY TAY INY INX CLC SEC CLI SEI TYA CLV CLD SED TXA TXS TAX TSX DEX NOP".split()))
C02 = {0x80: ("BRA", "rel"), 0x04: ("TSB", "zp"), 0x0C: ("TSB", "abs"), 0x14: ("TRB", "zp"), 0x1C: ("TRB", "abs"), 0x64: ("STZ", "zp"), 0x74: ("STZ", "zpx"), 0x9C: ("STZ", "abs"), 0x9E: ("STZ", "abx"), 0x34: ("BIT", "zpx"), 0x3C: ("BIT", "abx"), 0x89: ("BIT", "imm"), 0x7C: ("JMP", "iax"), 0x1A: ("INC", "acc"), 0x3A: ("DEC", "acc"), 0x5A: ("PHY", "imp"), 0x7A: ("PLY", "imp"), 0xDA: ("PHX", "imp"), 0xFA: ("PLX", "imp")}


def instruction(op: int, c02: bool = True) -> tuple[str, str] | None:
    """Name and addressing mode, or None if the opcode is none."""
    if op in SINGLE:
        return SINGLE[op], "abs" if op == 0x20 else "imp"
    if c02:
        if op in C02:
            return C02[op]
        if op & 0x1F == 0x12:
            return "ORA AND EOR ADC STA LDA CMP SBC".split()[op >> 5], "izp"
    a, b, c = op >> 5, op >> 2 & 7, op & 3
    if op & 0x1F == 0x10:
        return "BPL BMI BVC BVS BCC BCS BNE BEQ".split()[a], "rel"
    if c == 1:
        if op == 0x89:
            return None
        return "ORA AND EOR ADC STA LDA CMP SBC".split()[a], ("izx", "zp", "imm", "abs", "izy", "zpx", "aby", "abx")[b]
    if c == 2:
        mode = ("imm", "zp", "acc", "abs", None, "zpx", None, "abx")[b]
        name = "ASL ROL LSR ROR STX LDX DEC INC".split()[a]
        if mode is None or (mode == "imm" and a != 5) or (mode == "acc" and a > 3) or (op == 0x9E):
            return None
        if a in (4, 5):
            mode = {"zpx": "zpy", "abx": "aby"}.get(mode, mode)
        return name, mode
    if c == 0:
        mode = ("imm", "zp", None, "abs", None, "zpx", None, "abx")[b]
        name = (None, "BIT", "JMP", "JMP", "STY", "LDY", "CPY", "CPX")[a]
        if op == 0x6C:
            return "JMP", "ind"
        if name is None or mode is None or (name == "JMP" and mode != "abs") or (name == "BIT" and mode not in ("zp", "abs")) or (name == "STY" and mode in ("imm", "abx")) or (name in ("CPY", "CPX") and mode in ("zpx", "abx")):
            return None
        return name, mode
    return None


def listing(data: bytes, origin: int = 0x2000, c02: bool = True, names: dict[tuple[str, int], str] | None = None) -> str:
    """``address: bytes  name operand`` a line; ProDOS calls through BF00 show their three argument bytes.

    names: what ("addr", n) operands and ("p8", n) calls are called, behind their lines.
    """
    names = names or {}
    out, at = [], 0
    while at < len(data):
        found = instruction(data[at], c02)
        n = MODES[found[1]][1] if found else 0
        part = data[at : at + 1 + n]
        if not found or len(part) < 1 + n:
            out.append(f"{origin + at:04X}: {data[at]:02X}           ???")
            at += 1
            continue
        value = int.from_bytes(part[1:], "little")
        if found[1] == "rel":
            value = origin + at + 2 + (value - 256 if value > 127 else value) & 0xFFFF
        text = f"{found[0]:<4} {MODES[found[1]][0].format(value)}".rstrip()
        note = names.get(("addr", value)) if MODES[found[1]][1] == 2 or found[1] == "rel" else None
        out.append(f"{origin + at:04X}: {part.hex(' ').upper():<12} {text}" + (f"  {note}" if note else ""))
        at += 1 + n
        if found[0] == "JSR" and value == 0xBF00 and at + 3 <= len(data):
            call = data[at : at + 3]
            out.append(f"{origin + at:04X}: {call.hex(' ').upper():<12} MLI ${call[0]:02X} (${call[1] | call[2] << 8:04X})" + (f"  {names['p8', call[0]]}" if ("p8", call[0]) in names else ""))
            at += 3
    return "\r\n".join(out) + "\r\n" * bool(out)
