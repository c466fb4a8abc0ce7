"""Partition schemes and the read-only file systems."""

import random
import struct
import time

from pomona.functions import codecs
from pomona.sources import disk, filesystems, more_filesystems, partitions, reader

FILES = [dict(path=f"F{i}", data=bytes([i]) * (700 * i + 1)) for i in range(5)]
DOS = [dict(path=f"D{i}", kind="T", data=bytes([0xC1 + i]) * 300) for i in range(3)]


def scan(data, name="x.bin"):
    return {v["volume_id"]: (v, {e["path"]: e["data"] for e in found}) for v, found, _ in reader.scan(name, data)}


def wide_dos(files):
    """A DOS volume of 50 tracks of 32 sectors, from a 35-track one's parts."""
    out = bytearray(409600)
    small = filesystems.build_dos(files)
    for t in range(35):
        out[t * 8192 : t * 8192 + 4096] = small[t * 4096 : t * 4096 + 4096]
    vtoc = 17 * 8192
    out[vtoc + 0x34], out[vtoc + 0x35] = 50, 32
    return bytes(out)


def test_hfs():
    files = [dict(path=f"File {i}", data=b"d" * (600 * i), rsrc=b"r" * 100 if i % 2 else None, file_type=0x54455854, aux_type=0x70646F73) for i in range(12)]
    fs = filesystems.open_filesystem(disk.Image(more_filesystems.build_hfs("Vol", files)))
    got = {e["path"]: e for e in fs.entries()}
    assert fs.name == "HFS" and fs.volume == "Vol" and len(got) == 12
    for f in files:
        assert got[f["path"]]["data"] == f["data"] and got[f["path"]]["rsrc"] == f["rsrc"] and got[f["path"]]["aux_type"] == 0x70646F73
    assert set(fs.used) == fs.marked()


def test_maps():
    volumes = [filesystems.build_prodos(f"V{i}", FILES, 400) for i in range(3)]
    want = {f["path"]: f["data"] for f in FILES}
    body = b"".join(volumes)
    micro = bytearray(256 * 512)
    micro[:2], micro[12] = b"\xca\xcc", 3
    for i in range(3):
        struct.pack_into("<I", micro, 32 + 4 * i, 256 + 400 * i)
        struct.pack_into("<I", micro, 64 + 4 * i, 400 | 0x05000000)
    focus = bytearray(256 * 512)
    focus[:14], focus[15] = b"Parsons Engin.", 4
    for i in range(4):  # the last one lies beyond the end
        struct.pack_into("<II", focus, 32 + 16 * i, 256 + 400 * i, 400)
        focus[512 + 32 * i : 512 + 32 * i + 2] = b"P%d" % i
    mac = bytearray(64 * 512)
    mac[:2] = b"ER"
    for i in range(4):
        e = bytearray(512)
        struct.pack_into(">2sHIII32s32s", e, 0, b"PM", 0, 4, 64 + 400 * (i - 1) if i else 1, 400 if i else 63, b"n%d" % i, b"Apple_PRODOS" if i else b"Apple_partition_map")
        mac[512 * (i + 1) : 512 * (i + 2)] = e
    pad = bytes(819200)
    for head, scheme, n in ((micro, "MicroDrive", 3), (focus, "FocusDrive", 4), (mac, "MacPart", 3)):
        data = bytes(head) + body + (b"" if scheme == "FocusDrive" else pad)
        data += bytes(-len(data) % 512)
        if len(data) < 819200:
            data = bytes(head) + b"".join(volumes) + b""
            data += bytes(max(0, 819200 - len(data)))
        got = scan(data)
        assert got["x.bin"][0]["fs_format"] == scheme and len(got) == n + 1
        assert sum(found == want for _, found in got.values()) == 3


def test_shared_disks():
    a, b = wide_dos(DOS), wide_dos(DOS[:1])
    want = [{f["path"]: f["data"] for f in x} for x in (DOS, DOS[:1])]
    oz = b"".join(a[i : i + 256] + b[i : i + 256] for i in range(0, 409600, 256))
    for data, scheme in ((a + b, "UNIDOS"), (oz, "OzDOS")):
        got = scan(data)
        assert got["x.bin"][0]["fs_format"] == scheme and [got[f"x.bin:DOS {i}"][1] for i in (1, 2)] == want


def test_card_without_map():
    v = filesystems.build_prodos("CARD", FILES, 400).ljust((partitions.VOLUME_BLOCKS + 1) * 512, b"\0")
    got = scan(v + v)
    assert got["x.bin"][0]["fs_format"] == "CFFA" and len(got) == 3


def test_rdos_and_gutenberg():
    data = bytearray(143360)
    image = disk.Image(bytes(data), "physical")

    def put(t, s, body, order):
        at = (t * 16 + disk.skew(s, order, "physical")) * 256
        data[at : at + len(body)] = body

    row = bytes(ord(c) | 0x80 for c in "RDOS 3.3".ljust(24)) + bytes((0xC2, 1)) + struct.pack("<HHH", 0x800, 10, 20)
    row2 = bytes(ord(c) | 0x80 for c in "NOTE".ljust(24)) + bytes((0xD4, 2)) + struct.pack("<HHH", 0, 300, 40)
    put(1, 0, row + row2, "prodos")
    put(2, 8, b"q" * 256, "prodos")
    put(2, 9, b"p" * 256, "prodos")
    image = disk.Image(bytes(data), "physical")
    got = {e["path"]: e for e in more_filesystems.RDOS(image).entries()}
    assert got["NOTE"]["data"] == b"q" * 256 + b"p" * 44 and got["NOTE"]["file_type"] == 4 and got["RDOS 3.3"]["aux_type"] == 0x800
    g = bytearray(143360)
    high = lambda s, n: bytes(ord(c) | 0x80 for c in s.ljust(n))
    head = b"\x11\x07\x91\x87\x91\x07" + high("GB", 9) + b"\x8d" + high("DIR", 12) + b"\x11\x07\xcc\x8d" + high("TEXT", 12) + b"\x10\x04\xd0\x8d" + (bytes(15) + b"\x8d") * 13
    g[(17 * 16 + 7) * 256 : (17 * 16 + 8) * 256] = head
    g[(16 * 16 + 4) * 256 : (16 * 16 + 5) * 256] = (b"\x90\x04\x90\x04\x10\x05" + b"\xc1" * 250)
    g[(16 * 16 + 5) * 256 : (16 * 16 + 6) * 256] = (b"\x10\x04\x10\x05\x90\x04" + b"\xc2" * 250)
    found = {e["path"]: e for e in more_filesystems.Gutenberg(disk.Image(bytes(g), "dos")).entries()}
    assert found["TEXT"]["data"] == b"\xc1" * 250 + b"\xc2" * 250


def test_fat_is_only_told():
    b = bytearray(1474560)
    b[0], b[11:13], b[510:512] = 0xEB, b"\0\2", b"\x55\xaa"
    ((v, found),) = scan(bytes(b)).values()
    assert v["fs_format"] == "FAT" and len(found) == 1


def test_checksum_of_words_with_and_without_carries():
    def plain(data):
        s = 0
        for i in range(0, len(data) // 2 * 2, 2):
            s = s + int.from_bytes(data[i : i + 2], "big") & 0xFFFFFFFF
            s = s >> 1 | (s & 1) << 31
        return s

    r = random.Random(1)
    for size in (0, 1, 2, 3, 63, 64, 66, 1000, 32768, 32771, 100_000):
        for data in (bytes(size), b"\xff" * size, r.randbytes(size), bytes(r.choice((0, 255)) for _ in range(size)), r.randbytes(size // 2) + bytes(size), bytes(size) + r.randbytes(size // 3)):
            assert codecs.rotating_sum(data) == plain(data)


def test_checksum_of_a_disk_is_fast():
    """Less time than a loop over its bytes takes."""
    data = random.Random(2).randbytes(1 << 21)
    codecs.rotating_sum(data)
    began = time.perf_counter()
    codecs.rotating_sum(data)
    took = time.perf_counter() - began
    began = time.perf_counter()
    sum(b for b in data)
    assert took < time.perf_counter() - began
