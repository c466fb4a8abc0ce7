"""Converters on small inputs whose output is known."""

import struct

import numpy as np

from pomona.functions import codecs, converters, disasm
from pomona.sources import filesystems, reader


def file(data, kind=0, aux=0, **more):
    return dict(data=data, rsrc=None, file_type=kind, aux_type=aux, path="X", source_fs="ProDOS") | more


def run(f, name=None):
    return converters.convert(f, name)


def test_token_tables():
    assert len(converters.APPLESOFT) == 107 and converters.APPLESOFT[0xB2 - 0x80] == "REM" and converters.APPLESOFT[-1] == "MID$"
    assert len(converters.INTEGER) == 128 and converters.INTEGER[0x5D] == "REM" and converters.INTEGER[0x7F] == "IN#"
    assert converters.SHEET[0xDC - 0xC0] == "@Sum" and converters.SHEET[0xFC - 0xC0] == "..."


def test_applesoft_round_trip():
    source = '10 PRINT "HI: GOTO"\n20 FOR I=1 TO 10: NEXT\n30 REM go to\n40 DATA a,B : GOTO 10\n'
    program = converters.tokenize(source)
    out = run(file(program, 0xFC, 0x801))
    assert out["converter"] == "applesoft" and out["level"] == converters.YES
    assert converters.tokenize(out["text"]) == program
    assert " FOR I = 1 TO 10" in out["text"].replace("  ", " ")
    assert int.from_bytes(program[:2], "little") == 0x801 + program.index(0, 4) + 1


def test_integer_basic():
    line = bytes((0, 10, 0, 0x61, 0x28, 0xC8, 0xC9, 0x29, 3, 0x5F, 0xB1, 10, 0, 1))
    out = run(file(bytes((len(line),)) + line[1:], 0xFA))
    assert out["text"] == '   10  PRINT "HI": GOTO 10\r\n'


def test_disassembly():
    code = bytes.fromhex("A9 41 20 ED FD 20 00 BF C8 34 12 D0 F4 6C F2 03 02 B2 10 60")
    text = disasm.listing(code, 0x300)
    assert [line[19:] for line in text.splitlines()] == ["LDA  #$41", "JSR  $FDED", "JSR  $BF00", "MLI $C8 ($1234)", "BNE  $0301", "JMP  ($03F2)", "???", "LDA  ($10)", "RTS"]
    known = [disasm.instruction(i, False) for i in range(256)]
    assert sum(k is not None for k in known) == 151 and len({k[0] for k in known if k}) == 56
    assert sum(disasm.instruction(i) is not None for i in range(256)) == 151 + 27


def test_text_and_hex():
    assert run(file(b"a\rb\nc\r\nd", 4), "text")["text"] == "a\r\nb\r\nc\r\nd"
    assert run(file(bytes(b | 0x80 for b in b"HI\r"), 4), "text")["text"] == "HI\r\n"
    assert run(file(b"0123456789abcdef\x01\x80"), "hex")["text"] == "00000000: 30 31 32 33 34 35 36 37 38 39 61 62 63 64 65 66 0123456789abcdef\r\n00000010: 01 80                                           ..\r\n"
    assert run(file(bytes(1024) + b"\x10\x23x\rab\r\0\0", 3))["text"] == "   x\r\nab\r\n"
    assert run(file(b"ab\r\n\x1azz", 0, source_fs="CP/M"), "cpm_text")["text"] == "ab\r\n"


def test_database():
    head = bytearray(357)
    names = [b"Name", b'Say "x"', b"When"]
    head[35], head[38] = len(names), 0
    body = b"".join(bytes((len(n),)) + n.ljust(21, b"\0") for n in names)
    head[:2] = (355 + len(body)).to_bytes(2, "little")
    record = lambda *parts: (lambda b: len(b).to_bytes(2, "little") + b)(b"".join(parts) + b"\xff")
    cell = lambda b: bytes((len(b),)) + b
    rows = record(cell(b"std")) + record(cell(b"Ann"), cell(b'a"b'), cell(b"\xc094C07")) + record(cell(b"Bob"), b"\x81", cell(b"\xd4N30")) + b"\xff\xff"
    out = run(file(bytes(head) + body + rows, 0x19))
    assert out["text"].splitlines() == ['"Name","Say ""x""","When"', '"Ann","a""b","07-Mar-1994"', '"Bob","","1:30 PM"']


def test_spreadsheet():
    cell = lambda b: bytes((len(b),)) + b
    number = struct.pack("<d", 2.5)
    formula = b"\x80\0" + number + b"\xdc\xf9" + b"\xfe\xff\0\0" + b"\xfc" + b"\xfe\0\xff\xff" + b"\xf4"
    row = (3).to_bytes(2, "little") + cell(b"\0label") + b"\x81" + cell(b"\xa0\0" + number) + cell(formula) + b"\xff"
    out = run(file(bytes(300) + len(row).to_bytes(2, "little") + row + b"\xff\xff", 0x1B))
    assert out["text"].split("\r\n") == ["", "", '"label","","2.500000","@Sum(C3...D2)"', ""]


def test_pictures():
    screen = bytearray(8192)
    screen[0], screen[1] = 0b0000001, 0b10000011
    px = converters.hires(bytes(screen))
    assert px.shape == (192, 280, 3) and tuple(px[0, 0]) == (221, 34, 221) and tuple(px[0, 7]) == (255, 255, 255) and not px[1:].any()
    out = run(file(bytes(screen), 6))
    assert out["converter"] == "hires" and out["bitmap"][:2] == b"BM" and len(out["bitmap"]) == 54 + 280 * 3 * 192
    shr = bytearray(32768)
    shr[0], shr[0x7E02:0x7E04] = 0x10, b"\x0f\x0a"
    px = converters.super_hires(bytes(shr))
    assert tuple(px[0, 0]) == (170, 0, 255) and tuple(px[0, 2]) == (0, 0, 0)
    assert run(file(codecs.pack_bytes(bytes(shr)), 0xC0, 1))["bitmap"] == converters.bmp(px)
    paint = bytes(512) + codecs.pack_bits(b"\x80" + bytes(72 * 720 - 1))
    assert run(file(paint, path="a.mac"))["kind"] == "bitmap"
    assert run(file(b"short", 0xC0, 1))["kind"] == "error"
    assert converters.bmp(np.zeros((2, 3, 3), np.uint8))[18:26] == struct.pack("<ii", 3, 2)


def test_outputs(spark, tmp_path):
    files = [dict(path="PROG", data=converters.tokenize("10 END"), file_type=0xFC, aux_type=0x801), dict(path="NOTE", data=b"hello there, this is a text\r", file_type=4)]
    (tmp_path / "x.po").write_bytes(filesystems.build_prodos("V", files))
    got = {r.path: r for r in converters.outputs(reader.read_entries(spark, str(tmp_path), payload=True)).collect()}
    assert got["PROG"].converter == "applesoft" and got["PROG"].text == " 10  END \r\n"
    assert got["NOTE"].converter == "text" and got["NOTE"].text == "hello there, this is a text\r\n"
