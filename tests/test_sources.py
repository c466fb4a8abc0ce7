"""Images, file systems and archives: what the builders write, the readers and DataFrames give back."""

from datetime import datetime

import pytest

from pomona.functions import codecs, nibbles
from pomona.operators import integrity
from pomona.sources import archives, disk, filesystems, reader

BIG = bytes(i * 7 & 255 for i in range(200_000))
WHEN = datetime(1993, 5, 4, 12, 30)
FILES = [
    dict(path="Hello", data=b"hi there", file_type=4, modified=WHEN, created=WHEN),
    dict(path="SUB/DEEP/FILE", data=BIG[:5000], file_type=6, aux_type=0x2000),
    dict(path="HOLES", data=b"a" * 512 + bytes(5120) + b"b" * 10),
    dict(path="FORKED", data=b"d" * 600, rsrc=b"r" * 1500, file_type=0xB3),
    dict(path="TREE", data=BIG),
    dict(path="EMPTY", data=b""),
]
DOS_FILES = [dict(path="HELLO", kind="A", data=b"prog" * 100), dict(path="BIN FILE", kind="B", data=BIG[:40000], aux_type=0x300), dict(path="TEXT", kind="T", data=b"\xc1\xc2\x8d" * 400, locked=True)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    prodos, dos = filesystems.build_prodos("My.Disk", FILES, 800), filesystems.build_dos(DOS_FILES)
    (d / "a.po").write_bytes(prodos)
    (d / "b.po.gz").write_bytes(disk.wrap(prodos, "gzip"))
    (d / "c.2mg").write_bytes(disk.write_2mg(disk.Image(prodos), "note"))
    (d / "d.nib").write_bytes(disk.write_nibbles(disk.Image(dos, "dos")))
    (d / "e.shk").write_bytes(archives.write_nufx([*FILES[:2], dict(path="DISK", disk=dos), dict(FILES[3], comment="hm")], 3, WHEN))
    (d / "f.bny").write_bytes(archives.write_binary2(FILES[:2]))
    (d / "g.txt").write_bytes(b"no image at all")
    (d / "h.acu").write_bytes(archives.write_acu([dict(path="A", data=b"abc" * 500)]))
    return d


def test_prodos_round_trip():
    fs = filesystems.open_filesystem(disk.Image(filesystems.build_prodos("My.Disk", FILES, 800)))
    by = {e["path"]: e for e in fs.entries()}
    for f in FILES:
        assert by[f["path"]]["data"] == f["data"] and by[f["path"]]["rsrc"] == f.get("rsrc")
    assert by["Hello"]["modified"] == WHEN and by["HOLES"]["packed_len"] < by["HOLES"]["data_len"] and by["SUB/DEEP"]["record_kind"] == "directory"
    assert set(fs.used) == fs.marked() and max(fs.used.values()) == 1


@pytest.mark.parametrize("order", sorted(nibbles.TO_PHYSICAL))
def test_dos_in_every_sector_order(order):
    data = nibbles.reorder(filesystems.build_dos(DOS_FILES), order, "dos")
    found = list(filesystems.open_filesystem(disk.Image(data, order)).entries())
    assert [e["data"] for e in found] == [f["data"] for f in DOS_FILES] and found[2]["access"] == 0x21 and found[1]["aux_type"] == 0x300


def test_pascal_round_trip():
    files = [dict(path="A.TEXT", data=b"z" * 1500, modified=WHEN), dict(path="B.CODE", data=b"q" * 512, kind=2)]
    fs = filesystems.open_filesystem(disk.Image(filesystems.build_pascal("WORK", files)))
    assert fs.name == "Pascal" and [(e["path"], e["data"]) for e in fs.entries()] == [(f["path"], f["data"]) for f in files]


def test_damage_is_noted():
    image = disk.Image(filesystems.build_prodos("BIG", FILES, 1600))
    good = disk.write_dc42(image)
    assert not disk.open_image("x.dc", good)[0].damaged
    bad = bytearray(good)
    bad[5000] ^= 1
    assert disk.open_image("x.dc", bytes(bad))[0].damaged
    broken = bytearray(filesystems.build_prodos("D", FILES[:1], 280))
    broken[2 * 512 + 4 + 39 + 17] = 0xFF  # a key block beyond the volume
    broken[2 * 512 + 4 + 39 + 18] = 0xFF
    assert [e["quality"] for e in filesystems.open_filesystem(disk.Image(bytes(broken))).entries()] == ["damaged"]
    nib = bytearray(disk.write_nibbles(disk.Image(filesystems.build_dos(DOS_FILES), "dos")))
    nib[20 * 6656 + 100] = 0x96 if nib[20 * 6656 + 100] != 0x96 else 0x97
    assert len(disk.open_image("x.nib", bytes(nib))[0].bad) == 1


def test_codecs_round_trip():
    import random

    rng = random.Random(1)
    samples = [b"", b"a", b"ab" * 3000, bytes(range(256)) * 40, bytes(10000), rng.randbytes(9000), b"\x90" * 700 + b"x", b"\xdb" * 50, rng.randbytes(300) * 200, b"".join(rng.choice([b"the ", b"fox\r"]) for _ in range(9000))]
    for s in samples:
        assert codecs.unpack_bits(codecs.pack_bits(s)) == s and codecs.unpack_bytes(codecs.pack_bytes(s)) == s
        assert codecs.unsqueeze(codecs.squeeze(s)) == s
        assert codecs.unlzw(codecs.lzw1(s), len(s), 1) == s and codecs.unlzw(codecs.lzw2(s), len(s), 2) == s
        assert codecs.unlzc(codecs.lzc(s, 12)) == s and codecs.unlzc(codecs.lzc(s, 16)) == s
        for k in codecs.FORMATS:
            used, packed = codecs.compress(s, k)
            assert codecs.expand(packed, used, len(s)) == s and len(packed) <= len(s)
    assert codecs.crc16(b"123456789") == 0x31C3 and codecs.crc16(b"123456789", 0xFFFF) == 0x29B1
    assert codecs.unpack_bits(b"\x80A") == b"A" * 129


def test_disk_bytes():
    import random

    rng = random.Random(2)
    sectors = [rng.randbytes(256) for _ in range(16)]
    assert len(nibbles.SIX) == 64 and len(nibbles.FIVE) == 32
    for n in (16, 13):
        track = nibbles.encode_track(5, sectors[:n])
        assert nibbles.decode_track(track[3000:] + track[:3000], 5, n) == sectors[:n]


@pytest.mark.parametrize("kind", sorted(codecs.FORMATS))
def test_nufx_round_trip(kind):
    data = archives.write_nufx([dict(FILES[0], comment="hello"), FILES[1], dict(FILES[3]), dict(path="E", data=b"")], kind, WHEN)
    records = list(archives.read_nufx(b"\x0aGL" + bytes(125) + data))
    assert [r["status"] for r in records] == ["ok"] * 4 and records[0]["modified"] == WHEN
    rows = [archives.record_entry(r) for r in records]
    assert [e["record_kind"] for e in rows] == ["file", "file", "forked", "file"] and rows[0]["comment_nonempty"] and rows[2]["rsrc_len"] == 1500
    for r, f in zip(records, [FILES[0], FILES[1], FILES[3]]):
        got = {archives.DATA_KINDS[t["kind"]]: archives.thread_bytes(t) for t in r["threads"] if t["thread_class"] == 2}
        assert got["data"] == f["data"] and got.get("rsrc") == f.get("rsrc")
    assert any(r["status"] != "ok" or not all(t["whole"] for t in r["threads"]) for r in archives.read_nufx(data[:-40]))
    broken = bytearray(data)
    broken[data.index(b"hi there")] ^= 0x55
    with pytest.raises(ValueError):
        [archives.thread_bytes(t) for t in next(archives.read_nufx(bytes(broken)))["threads"]]


def test_other_archives():
    assert [e["data"] for e in archives.read_binary2(archives.write_binary2(FILES[:2]))] == [f["data"] for f in FILES[:2]]
    assert [e["data"] for e in archives.read_acu(archives.write_acu([dict(path="A", data=b"abc" * 500), dict(path="B", data=b"z")]))] == [b"abc" * 500, b"z"]
    one = archives.read_applesingle(archives.write_applesingle(FILES[3]))
    assert one["data"] == FILES[3]["data"] and one["rsrc"] == FILES[3]["rsrc"] and one["file_type"] == 0xB3


def test_tables(spark, folder):
    v = {r.volume_id.rsplit("/", 1)[-1]: r for r in reader.read_volumes(spark, str(folder)).collect()}
    assert v["a.po"].fs_format == v["b.po.gz"].fs_format == v["c.2mg"].fs_format == "ProDOS" and v["b.po.gz"].outer_format == "gzip"
    assert v["d.nib"].fs_format == "DOS" and v["e.shk:DISK"].fs_format == "DOS" and v["e.shk:DISK"].depth == 1 and v["g.txt"].status == "failed"
    e = reader.read_entries(spark, str(folder), payload=True).collect()
    got = {(r.volume_id.rsplit("/", 1)[-1], r.path): bytes(r.data) for r in e if r.data is not None}
    for f in FILES:
        assert got["a.po", f["path"]] == got["b.po.gz", f["path"]] == got["c.2mg", f["path"]] == f["data"]
    for f in DOS_FILES:
        assert got["d.nib", f["path"]] == got["e.shk:DISK", f["path"]] == f["data"]
    assert got["f.bny", "Hello"] == b"hi there" and got["h.acu", "A"] == b"abc" * 500
    t = reader.read_threads(spark, str(folder)).collect()
    assert t and all(r.status == "ok" for r in t)
    c = reader.read_chunks(spark, str(folder / "a.po"))
    state = integrity.usage_summary(integrity.usage_check(c.where("users > 0").selectExpr("chunk_idx", "explode(sequence(1, users))"), c.where("is_marked_used"), "chunk_idx")).first()
    assert (state.unmarked, state.unused, state.conflicts) == (0, 0, 0) and state.good > 100


def test_data_source(spark, folder):
    spark.dataSource.register(reader.EntriesSource)
    df = spark.read.format("pomona").option("payload", "true").load(str(folder / "d.nib"))
    assert sorted(bytes(r.data) for r in df.collect()) == sorted(f["data"] for f in DOS_FILES)


@pytest.mark.parametrize("order", ["dos", "prodos", "cpm", "physical"])
@pytest.mark.parametrize("blocks", [4, 1])
def test_volumes_on_images_that_do_not_tell_their_order(order, blocks):
    """The volume's first sector stands at the same place in CP/M's and in physical order."""
    files = [dict(path=f"F{i}", data=bytes((65 + i,)) * (3000 + i)) for i in range(12)]
    data = bytearray(filesystems.build_prodos("V", files))
    if blocks == 1:  # a directory of one block has no links that tell
        data[1024 + 2 : 1024 + 4] = b"\0\0"
    for built, fs in ((bytes(data), "ProDOS"), (filesystems.build_pascal("V", files), "Pascal")):
        ((volume, found, _),) = reader.scan("a.dsk", nibbles.reorder(built, order, "prodos"))
        assert (volume["fs_format"], volume["sector_order"]) == (fs, order)
        assert [(e["path"], e["data"]) for e in found] == [(f["path"], f["data"]) for f in files]
    # an order that is asked for holds
    ((volume, _, _),) = reader.scan("a.dsk", nibbles.reorder(bytes(data), "physical", "prodos"), order="cpm")
    assert volume["sector_order"] == "cpm"
