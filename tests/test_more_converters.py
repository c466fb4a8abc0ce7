"""3.5-inch disk bytes and the further converters."""

import random
import struct

from pomona.functions import converters, gcr35, more_converters


def file(data, kind=0, aux=0, **more):
    return dict(data=data, rsrc=None, file_type=kind, aux_type=aux, path="X", source_fs="ProDOS") | more


def test_gcr35():
    rng = random.Random(1)
    assert [gcr35.sectors_on(c) for c in (0, 15, 16, 79)] == [12, 12, 11, 8]
    for cylinder, head in ((0, 0), (33, 1), (79, 1)):
        sectors = [rng.randbytes(512) for _ in range(gcr35.sectors_on(cylinder))]
        track = gcr35.encode_track(cylinder, head, sectors)
        assert gcr35.decode_track(track[5000:] + track[:5000], cylinder, head) == sectors
        broken = bytearray(track)
        broken[200] = 0x96 if broken[200] != 0x96 else 0x97
        assert gcr35.decode_track(bytes(broken), cylinder, head).count(None) == 1
    tags = bytes(range(12))
    assert gcr35.decode_sector(gcr35.encode_sector(sectors[0], tags)) == (tags, sectors[0]) and len(gcr35.encode_sector(sectors[0])) == 703


def test_merlin():
    source = "* remark\rSTART LDA #' ' ;get it\r JSR COUT\r RTS\r"
    high = bytes(ord(c) | 0x80 for c in source)
    out = converters.convert(file(high, 4))
    assert out["converter"] == "merlin" and out["level"] == converters.PROBABLY
    assert out["text"].split("\r\n") == ["* remark", "START    LDA   #' '       ;get it", "         JSR   COUT", "         RTS", ""]
    assert converters.convert(file(high, 4, path="A.S"))["level"] == converters.YES
    assert dict(converters.scores(file(b"plain", 4, path="B.s")))["merlin"] == converters.PROBABLY_NOT
    # blanks without the top bit part nothing; percentages are whole numbers
    assert converters.convert(file(b"\xc1\x20\xc2\xa0\xd2\xd4\xd3\x8d", 4), "merlin")["text"].split("\r\n")[0] == "A B      RTS"
    lines = [b"\xa0\xd2"] * 81 + [b"\xc1"] * 119  # 40.5 % is not above 40
    assert not more_converters._is_merlin(b"\x8d".join(lines)) and more_converters._is_merlin(b"\x8d".join([b"\xa0\xd2"] * 41 + [b"\xc1"] * 59))


def test_sc_assembler():
    line = lambda n, body: bytes((len(body) + 4,)) + n.to_bytes(2, "little") + body + b"\0"
    out = converters.convert(file(line(1000, b"\x87LDA #1") + line(1010, b"*\xc0\x05-"), 0xFA), "sc_assembler")
    assert out["text"] == "1000        LDA #1\r\n1010 *-----\r\n"


def test_pascal_code():
    d = bytearray(512)
    struct.pack_into("<HH", d, 4, 1, 300)
    d[72:80], d[194:196], d[258:260] = b"MYSEG   ", b"\2\0", b"\7\2"
    assert converters.convert(file(bytes(d), 2))["text"] == " 1 MYSEG    block   1 length   300 SEGPROC segment 7 machine 2\r\n"


def test_resources():
    body = b"hello"
    index = struct.pack("<HIIHII", 0x8006, 1, 140, 0x10, len(body), 0)
    head = struct.pack("<III", 0, 145, 32 + len(index)).ljust(140, b"\0")
    table = struct.pack("<IHIIHHHIIHH", 0, 0, 145, 32 + len(index), 32, 0, 0, 1, 1, 0, 0)
    rsrc = head + body + table + index
    assert more_converters.resources(rsrc) == [dict(kind=0x8006, id=1, offset=140, attributes=0x10, size=5)]
    assert "Type $8006" in converters.convert(file(b"", 0, rsrc=rsrc))["text"]


def test_pictures_of_many_colours():
    d = bytearray(38400)
    d[0] = 0x1F
    d[32000:32002], d[32028:32030] = b"\x0f\0", b"\xf0\0"
    px = more_converters.many_colours(bytes(d))
    assert tuple(px[0, 0]) == (0, 255, 0) and tuple(px[0, 2]) == (0, 0, 255)
    screen = bytearray(16384)
    screen[0] = 0x0F
    px = more_converters.double_hires_colour(bytes(screen))
    assert px.shape == (192, 560, 3) and tuple(px[0, 0]) == (255, 255, 255) and not px[0, 4:].any()


def test_business_basic():
    def program(*lines):
        body = b"".join(bytes((len(x) + 4,)) + n.to_bytes(2, "little") + x + b"\0" for n, x in lines)
        return len(body).to_bytes(2, "little") + body + b"\0"

    lines = [(10, b"\x81i=1\xe210"), (20, b"\xd9\xff\xc5i);:\xc0 loop"), (30, b"\x82i:\xd9\"done\""), (40, b"\xbbx\xe5\x80"), (50, b"\x8a\xff\x99")]
    out = converters.convert(file(program(*lines), 0x09))
    assert out["converter"] == "business_basic"
    assert out["text"].split("\r\n") == [" 10   FOR i=1 TO 10", " 20     PRINT CHR$(i);:REM loop", " 30     NEXT i:PRINT \"done\"", " 40   IF x THEN END", " 50   *error* *error*", ""]
