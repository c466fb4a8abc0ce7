"""Documents, listings of 16-bit code, and the further pictures."""

import struct

import numpy as np
import pytest

from pomona.functions import codecs, converters, documents, listing16, pictures


def file(data, kind=0, aux=0, **more):
    return dict(data=data, rsrc=None, file_type=kind, aux_type=aux, path="X", source_fs="ProDOS") | more


def resource_fork(kind, number, body):
    index = struct.pack("<HIIHII", kind, number, 140, 0, len(body), 0)
    table = struct.pack("<IHIIHHHIIHH", 0, 0, 140 + len(body), 32 + len(index), 32, 0, 0, 1, 1, 0, 0)
    return struct.pack("<III", 0, 140 + len(body), 32 + len(index)).ljust(140, b"\0") + body + table + index


# --- listings


def test_every_opcode_is_an_instruction():
    rows = [listing16.instruction(i) for i in range(256)]
    assert all(rows) and all(mode in listing16.MODES for _, mode in rows)
    assert {rows[i] for i in (0x07, 0x13, 0x2F, 0x9B, 0xEB, 0xDC, 0x7C, 0xD4)} == {("ORA", "ilz"), ("ORA", "sry"), ("AND", "lng"), ("TXY", "imp"), ("XBA", "imp"), ("JML", "ind"), ("JMP", "iax"), ("PEI", "zp")}
    assert [listing16.width(0xA9, m, True) for m in (True, False)] == [2, 3] and [listing16.width(0xA2, True, x) for x in (True, False)] == [2, 3] and listing16.width(0xC2, False, False) == 2
    # every byte of any code is listed once
    code = bytes(range(256)) * 2
    for short in (True, False):
        lines = listing16.listing(code, 0x2000, short)
        assert b"".join(bytes.fromhex(x[9:21].strip()) for x in lines)[: len(code)] == code


def test_listing16():
    code = bytes.fromhex("a20a02220000e1" "2000bf c80010" "22a800e1 0620 44332211" "90fc 8d00c0".replace(" ", ""))
    names = {("tool", 0x020A): "_Tool", ("p8", 0xC8): "OPEN", ("gsos", 0x2006): "_GetInfo", ("addr", 0xC000): "KBD"}
    assert listing16.listing(code, 0, names=names) == [
        "00/0000: A2 0A 02      LDX #020A", "00/0003: 22 00 00 E1   JSL E10000  _Tool", "00/0007: 20 00 BF      JSR BF00  OPEN", "00/000A: C8                C8", "00/000B: 00 10             1000",
        "00/000D: 22 A8 00 E1   JSL E100A8  _GetInfo", "00/0011: 06 20             2006", "00/0013: 44 33 22 11       11223344", "00/0017: 90 FC         BCC 0015 {-04}", "00/0019: 8D 00 C0      STA C000  KBD",
    ]


def test_names_in_8_bit_listings():
    from pomona.functions import disasm

    code = bytes.fromhex("20edfd2000bfc8001090f94c0020")
    plain, named = (disasm.listing(code, 0x2000, names=n).split("\r\n") for n in (None, {("addr", 0xFDED): "COUT", ("p8", 0xC8): "OPEN", ("addr", 0x2004): "LOOP"}))
    assert named[0] == plain[0] + "  COUT" and named[2] == plain[2] + "  OPEN" and named[3] == plain[3] + "  LOOP" and named[4] == plain[4]


def module(bodies):
    out = b""
    for i, body in enumerate(bodies, 1):
        code = b"\xf2" + len(body).to_bytes(4, "little") + body + b"\0"
        head = struct.pack("<IIIBBBBIHHIIBBHIHH", 0, 0, len(body), 0, 0, 4, 2, 65536, 0x4000 | (i > 1), 0, 0, 0, 0, 0, i, 0, 0x2C, 0x2C + 10 + 5)
        out += (len(head) + 15 + len(code)).to_bytes(4, "little") + head[4:] + b"LOAD".ljust(10) + b"\4main" + code
    return out


def test_object_modules():
    data = module([b"\xea\x60", b"\x18\xfb"])
    found, rest = listing16.segments(data + b"junk")
    assert rest == 4 and [(s["kind"], s["number"], s["name"], s["load_name"], s["flags"], s["version"]) for s in found] == [("CODE", 1, "main", "LOAD", ["private"], "2.0"), ("DATA", 2, "main", "LOAD", ["private"], "2.0")]
    out = converters.convert(file(data, 0xB3))
    assert out["converter"] == "monitor16_long" and "OMF: LCONST record (0x0002 bytes follow)" in out["text"] and "NOP" in out["text"] and "XCE" in out["text"] and out["text"].count("; Segment #") == 2
    assert converters.convert(file(b"\xea" * 9, 0xB3))["text"].startswith("[ Valid OMF expected but not found ]")


# --- documents


def test_character_sets():
    assert documents.mac_fold(b"\x01A\x8a\xa5\xff") == "?Aa " [:0] + "?Aat "[:3] + documents.MAC_FOLD[0xA5 - 0x80] + " "
    assert documents.mac_fold("Grüße".encode("mac_roman")) == "GruBe".replace("B", documents.MAC_FOLD["ß".encode("mac_roman")[0] - 0x80])
    assert documents.mouse_text(0x15) == "→" and documents.mouse_text(0x15, True) == ">" and len({len(documents.MOUSE_TEXT), len(documents.MOUSE_ASCII)}) == 1
    with pytest.raises(ValueError):
        documents.mouse_text(32)


def test_rtf_round_trip():
    out = documents.Rtf()
    text = "plain {braces} \\slash\ttab Grüße 日本 🙂 - \n"
    out.font(22)
    out.size(12)
    for style, part in ((0, "a "), (3, text.split("\n")[0]), (0x44, "x"), (0, "y")):
        out.style(style)
        out.text(part)
    out.paragraph()
    out.align("qc")
    out.note("<note>")
    doc = out.document()
    assert documents.rtf_text(doc) == "a " + text.split("\n")[0] + "xy\n<note>" and "\\b \\i " in doc and "\\b0 \\i0 " in doc and "\\nosupersub" in doc and doc.count("{") - doc.count("\\{") == doc.count("}") - doc.count("\\}")


def test_gs_text_and_raw():
    assert converters.convert(file(b"a\rb\r\nc\nd\x8a", 0x50))["text"] == "a\r\nb\r\nc\r\nd\u00e4"
    out = converters.convert(file(b"\0\xff"), "raw")
    assert out["kind"] == "raw" and out["text"].encode("latin-1") == b"\0\xff"


def test_teach():
    text = b"Bold\rplain \x9f"
    styles = struct.pack("<BBHHHI", 1, 12, 3, 0, 0, 0) + struct.pack("<BBHHHI", 0, 10, 22, 0, 0, 0)
    ruler = bytes(18)
    block = struct.pack("<HI", 0, len(ruler)) + ruler + struct.pack("<I", len(styles)) + styles + struct.pack("<I", 3) + struct.pack("<6I", 5, 0, 0xFFFFFFFF, 0, len(text) - 5, 12)
    out = converters.convert(file(text, 0x50, 0x5445, rsrc=resource_fork(0x8012, 1, block)))
    assert out["kind"] == "rtf" and documents.rtf_text(out["text"]) == "Bold\nplain ü" and "\\b " in out["text"] and "Courier" in out["text"]
    assert converters.convert(file(text, 0x50, 0x5445))["kind"] == "error"


def test_gs_word_processor():
    def chunk(paragraphs):
        body, entries = b"", b""
        for p in paragraphs:
            if p is None:
                entries += struct.pack("<6H", 0, 0, 1, 0xFFFF, 0, 0)
                continue
            entries += struct.pack("<6H", 0, len(body), 0, 0, 12, 1)
            body += struct.pack("<HBBB2x", 3, 0, 12, 0) + p + b"\r"
        return struct.pack("<H", len(paragraphs)) + entries + struct.pack("<HH", 0, 0x20).ljust(52, b"\0") + struct.pack("<I", len(body)) + body

    data = struct.pack("<HH", 0x1011, 282).ljust(282, b"\0") + struct.pack("<H", 2).ljust(386, b"\0") + chunk([b"Hello \2\1bold\2\0 \5", b"\1\x16\0more"] + [b"last"]) + chunk([b"top"]) + chunk([b"end", None, b"x"])
    out = converters.convert(file(data, 0x50, 0x8010))
    assert out["converter"] == "gs_word_processor"
    assert documents.rtf_text(out["text"]) == "<header>\ntop\n</header>\n<footer>\nend\n<page-break>\n\fx\n</footer>\nHello bold <page>\nmore\nlast\n" and "\\qc " in out["text"]


def test_lisa():
    line = lambda body: bytes((len(body) + 1,)) + body + b"\r"
    lines = [line(b"START   \xcd\x01#$10"), line(b"; remark"), line(b"\xa5"), line(b"\xcb\x02 COUT\xbb print")]
    body = b"".join(lines) + b"\xff"
    data = struct.pack("<HH", 0x1800, len(body)) + body
    out = converters.convert(file(data, 0x42, source_fs="DOS"))
    assert out["converter"] == "lisa" and out["text"].split("\r\n")[:4] == ["START    LDA #$10", "; remark", "         RTS ", "         JSR COUT                      ; print"]


# --- pictures


def pixels(out):
    w, h = struct.unpack_from("<ii", out["bitmap"], 18)
    return np.frombuffer(out["bitmap"], np.uint8, offset=54).reshape(h, -1)[:, : 3 * w].reshape(h, w, 3)[::-1, :, ::-1]


def screen():
    d = bytearray(32768)
    d[:160], d[160 * 7 : 160 * 8] = bytes(range(160)), b"\x1f" * 160
    d[0x7D07] = 3
    for i in range(256):
        d[0x7E00 + 2 * i : 0x7E02 + 2 * i] = (i * 17 & 0xFFF).to_bytes(2, "little")
    return bytes(d)


def test_dump_and_page():
    s = screen()
    same = converters.convert(file(s, 0xC1), "super_hires")["bitmap"]
    dump = s[:0x7D07] + b"\0" + s[0x7D08:0x7E20]
    plain = s[:0x7D07] + b"\0" + s[0x7D08:]
    assert converters.convert(file(dump, 0xC1), "super_hires_dump")["bitmap"] == converters.convert(file(plain, 0xC1), "super_hires")["bitmap"] != same
    page = s[0x7E00:0x7E20] + bytes(0x222 - 32) + codecs.pack_bytes(s[:32000] + bytes(196 * 160))
    got = pixels(converters.convert(file(page, 0xC0, 0)))
    assert got.shape == (792, 640, 3) and (got[:400] == pixels(converters.convert(file(plain, 0xC1), "super_hires"))).all()


def chunked(s, many=None):
    rows = [codecs.pack_bytes(s[160 * y : 160 * y + 160]) for y in range(200)]
    main = struct.pack("<HHH", 0, 320, 16) + s[0x7E00:0x8000] + struct.pack("<H", 200) + b"".join(struct.pack("<HH", len(r), s[0x7D00 + y]) for y, r in enumerate(rows)) + b"".join(rows)
    block = lambda name, body: (5 + len(name) + len(body)).to_bytes(4, "little") + bytes((len(name),)) + name + body
    return block(b"NOTE", b"\2\0hi") + block(b"MAIN", main) + (block(b"MULTIPAL", struct.pack("<H", 200) + many) if many else b"")


def test_chunked_pictures():
    s = screen()
    assert converters.convert(file(chunked(s), 0xC0, 2))["bitmap"] == converters.convert(file(s, 0xC1), "super_hires")["bitmap"]
    many = bytes(i * 7 & 0xFF if i % 2 == 0 else i & 15 for i in range(6400))
    want = s[:32000] + b"".join(many[32 * y : 32 * y + 32][i : i + 2] for y in range(200) for i in range(30, -2, -2))
    assert converters.convert(file(chunked(s, many), 0xC0, 2))["bitmap"] == converters.convert(file(want, 0xC1, 2), "many_colours")["bitmap"]
    packed = b"\xc1\xd0\xd0\0" + want[32000:] + codecs.pack_bytes(want[:32000])
    out = converters.convert(file(packed, 0xC0, 4, path="A.3201"))
    assert out["converter"] == "packed_many_colours" and out["bitmap"] == converters.convert(file(want, 0xC1, 2), "many_colours")["bitmap"]
    assert converters.convert(file(b"\xff" * 100, 0xC0, 2))["kind"] == "error"


def lzw(data):
    bits, n, width, table, word = 0, 0, 9, {bytes([i]): i for i in range(256)}, b""

    def put(code):
        nonlocal bits, n
        bits |= code << n
        n += width

    put(256)
    count = 258
    for i in range(len(data)):
        if word + data[i : i + 1] in table:
            word += data[i : i + 1]
            continue
        put(table[word])
        if count < 4096:
            table[word + data[i : i + 1]] = count
            count += 1
            if count - 1 >= 1 << width and width < 12:  # the reader is one entry behind
                width += 1
        word = data[i : i + 1]
        if count == 4096:
            put(table[word])
            put(256)
            width, count, table, word = 9, 258, {bytes([j]): j for j in range(256)}, b""
    if word:
        put(table[word])
        if count >= 1 << width and width < 12:
            width += 1
    put(257)
    return bits.to_bytes((n + 7) // 8, "little")


def test_lzw_pictures():
    for text in (b"abababababab" * 50, bytes(range(256)) * 4, b"a", b"x" * 700):
        assert pictures.unpack_lzw(lzw(text)) == text
    with pytest.raises(ValueError):
        pictures.unpack_lzw(lzw(b"abc" * 99)[:20])
    s = screen()
    tail = lambda colours: struct.pack("<HHH", colours, 200, 320) + pictures.MARK
    out = converters.convert(file(lzw(s) + tail(0), 0xC0, 0x8005))
    assert out["converter"] == "lzw_256_colours" and out["bitmap"] == converters.convert(file(s, 0xC1), "super_hires")["bitmap"]
    many = s[:32000] + bytes(i & 0xFF if i % 2 == 0 else i & 15 for i in range(6400))
    out = converters.convert(file(lzw(many) + tail(1), 0xC0, 0x8005))
    assert out["converter"] == "lzw_3200_colours" and out["bitmap"] == converters.convert(file(many, 0xC1, 2), "many_colours")["bitmap"]


def test_double_hires_variants():
    d = bytearray(16384)
    assert not pictures.double_hires_sliding(bytes(d)).any() and not pictures.double_hires_blended(bytes(d)).any()
    full = bytes([0x7F]) * 16384
    assert (pictures.double_hires_blended(full)[:, 4:-4] == 255).all() and (pictures.double_hires_sliding(full)[:, 4:] == 255).all()
