"""Changed containers: what is changed is, and all else stays."""

import hashlib
import io
from datetime import datetime

import pytest

from pomona.functions import codecs, nibbles
from pomona.sources import archives, changes, disk, filesystems, more_filesystems, reader

WHEN = datetime(1993, 5, 4, 12, 30)
FILES = [
    dict(path="Hello", data=b"hi there " * 40, file_type=4, modified=WHEN, created=WHEN),
    dict(path="SUB/DEEP", data=bytes(range(256)) * 20, file_type=6, aux_type=0x2000, comment="a note"),
    dict(path="FORKED", data=b"d" * 600, rsrc=b"r" * 1500, file_type=0xB3),
    dict(path="DISK", disk=bytes(143360)),
]


@pytest.mark.parametrize("packing", range(8))
def test_recompress_keeps_contents(packing):
    old = archives.write_nufx(FILES, 2, WHEN)
    new = changes.recompressed(old, packing)
    assert changes.thread_crcs(new) == changes.thread_crcs(old) and changes.archive_files(new) == changes.archive_files(old)
    formats = {t["format"] for r in archives.read_nufx(new) for t in r["threads"] if t["thread_class"] == 2}
    assert formats <= {0, packing}


def test_wrapper_is_kept_up_to_date():
    old = changes.wrapped(archives.write_nufx(FILES, 3), "A.SHK")
    new = changes.recompressed(old, 0)
    assert len(new) > len(old) and len(new) % 128 == 0
    (member,) = archives.read_binary2(new)
    assert changes.archive_files(member["data"]) == changes.archive_files(old) and member["aux_type"] == 0x8002
    assert changes.laundered(new)[:6] == archives.NUFILE


def test_launder_drops_what_is_damaged():
    data = bytearray(archives.write_nufx(FILES[:3], 0))
    at = data.index(b"hi there hi")
    data[at] ^= 1
    with pytest.raises(ValueError):
        changes.recompressed(bytes(data))
    assert [f["path"] for f in changes.archive_files(changes.laundered(bytes(data)))] == ["SUB/DEEP", "FORKED"]


def test_add_by_policy():
    old = archives.write_nufx(FILES[:2])
    late = dict(path="HELLO", data=b"new", modified=datetime(1999, 1, 1))
    add = lambda **o: changes.added(old, [late, dict(path="X", data=b"x")], changes.values(**o))
    for o, what in ((dict(), "skipped"), (dict(policy="always"), "replaced"), (dict(policy="maybe"), "ask"), (dict(policy="always", only_newer=True), "replaced"), (dict(allow_duplicates=True), "added")):
        out, done = add(**o)
        assert done == [("HELLO", what), ("X", "added")]
        names = [f["path"] for f in changes.archive_files(out)]
        assert len(names) == 3 + (what == "added") and ("HELLO" in names) == (what in ("replaced", "added"))
    with pytest.raises(ValueError):
        add(policy="must")
    early = dict(late, modified=datetime(1980, 1, 1))
    assert changes.added(old, [early], changes.values(policy="always", only_newer=True))[1] == [("HELLO", "skipped")]
    assert changes.added(None, [dict(path="a/b", data=b"1")], changes.values(junk_paths=True))[1] == [("b", "added")]
    with pytest.raises(ValueError):
        changes.values(nonsense=1)


def test_delete_comment_transfer():
    old = archives.write_nufx(FILES)
    assert [f["path"] for f in changes.archive_files(changes.without(old, ["hello", "disk"]))] == ["SUB/DEEP", "FORKED"]
    with pytest.raises(ValueError):
        changes.without(old, [f["path"] for f in FILES])
    notes = lambda d: {f["path"]: f.get("comment") for f in changes.archive_files(d)}
    assert notes(changes.commented(old, "hello", "Grüße"))["Hello"] == "Grüße" and notes(changes.commented(old, "SUB/deep", None))["SUB/DEEP"] is None
    out, done = changes.transferred(old, archives.write_nufx(FILES[2:3]), ["hello", "forked"])
    assert done == [("Hello", "added"), ("FORKED", "skipped")] and len(changes.archive_files(out)) == 2


def test_stream_reads_forwards_only():
    data = archives.write_nufx(FILES, 3, WHEN)
    for prefix, step in ((b"", 7), (b"junk" * 30, 1000)):
        source = io.BytesIO(prefix + data + b"tail")
        got = list(changes.stream_records(lambda n: source.read(min(n, step))))  # noqa: B023
        assert got == list(archives.read_nufx(data))
    cut = list(changes.stream_records(io.BytesIO(data[:-10]).read))
    assert [r["status"] for r in cut] == ["ok", "ok", "ok", "damaged"]


def test_images_convert():
    dos = filesystems.build_dos([dict(path="HELLO", kind="T", data=b"\xc1\xc2")])
    blocks = changes.converted_image("a.do", dos, "po")
    assert blocks == nibbles.reorder(dos, "prodos", "dos")
    for to in ("po", "2mg", "nib", "app", "ddd", "hdv", "shk", "po.gz", "po.zip", "do"):
        out = changes.converted_image("a.do", dos, to, "note")
        name = f"a.{to}"
        back = changes.archived_images(out)[0][1] if to == "shk" else changes.converted_image(name, out, "po")
        assert back == blocks, to
    big = filesystems.build_prodos("BIG", [], 1600)
    assert changes.converted_image("a.dc", changes.converted_image("a.po", big, "dc42"), "po") == big
    with pytest.raises(ValueError):
        changes.converted_image("a.po", big, "nib")


def test_image_edits():
    image = disk.Image(filesystems.build_dos([]), "dos")
    new = changes.edited(image, [("sector", 5, 3, 10, b"abc"), ("block", 7, 500, b"tail of block"[:12]), ("track", 20, bytes(4096))])
    assert new.sector(5, 3)[10:13] == b"abc" and new.block(7)[500:512] == b"tail of bloc" and new.sector(5, 3)[:10] == image.sector(5, 3)[:10]
    assert sum(a != b for a, b in zip(new.data, image.data)) <= 15 + 4096
    for bad in (("block", 7, 510, b"abc"), ("sector", 99, 0, 0, b"a"), ("track", 1, b"x"), ("nothing", b"")):
        with pytest.raises(ValueError):
            changes.edited(image, [bad])
    assert not any(changes.zeroed(image).data)
    block = disk.Image(bytes(1600 * 512))
    assert changes.with_block(block, 1599, b"z" * 512).block(1599) == b"z" * 512
    assert changes.copied_volume(b"v" * 512, bytes(2048), 2) == bytes(1024) + b"v" * 512 + bytes(512)
    with pytest.raises(ValueError):
        changes.copied_volume(bytes(1024), bytes(1024), 1)


def test_2mg_properties():
    old = disk.write_2mg(disk.Image(filesystems.build_prodos("A", [])), "old note")
    new = changes.edited_2mg(old, comment="new", creator=b"test", volume=7, locked=True)
    image = disk.read_2mg(new)
    assert ("info", "new") in image.notes and image.volume == 7 and new[4:8] == b"test" and image.data == disk.read_2mg(old).data
    assert int.from_bytes(new[16:20], "little") >> 31 and disk.read_2mg(changes.edited_2mg(new, volume=-1)).volume is None


def test_sst_merge():
    track = bytearray(b"\x7f" * 40 + bytes(range(0x80, 0x100)) * 60)[:6656]
    turned = track[-100:] + track[:-100]
    first, second = disk.Image(bytes(143360), "dos"), disk.Image(bytes(143360), "dos")
    for t in range(35):
        for virtual, numbers, at in ((2 * t, range(13, -1, -1), 3072), (2 * t + 1, range(15, 3, -1), 0)):
            for i, s in enumerate(numbers):
                part = bytes(turned[at + 256 * i : at + 256 * i + 256])
                if virtual < 35:
                    first = changes.with_sector(first, virtual, s, part)
                else:
                    second = changes.with_sector(second, virtual - 35, s, part)
    out = changes.merged_sst(first.data, second.data)
    assert out == bytes(b | 0x80 for b in track) * 35


def test_new_and_rebuilt_volumes():
    assert filesystems.open_filesystem(disk.Image(changes.created("ProDOS", 1600, "FRESH"))).volume == "FRESH"
    assert filesystems.open_filesystem(disk.Image(changes.created("DOS"), "dos")).name == "DOS" and not any(changes.created("blank"))


def tree(image):
    fs = filesystems.open_filesystem(image)
    return fs.volume, {e["path"]: e["data"] for e in fs.entries()}


def test_rebuilt_volumes():
    old = bytearray(filesystems.build_prodos("OLD", [dict(path="A/B", data=b"1" * 700, aux_type=5, modified=WHEN), dict(path="C", data=b"2")], 400))
    old[:4] = b"boot"
    image = disk.Image(bytes(old))
    new = changes.rebuilt(image, lambda files: [dict(f, path=f["path"].replace("A", "Z")) for f in files if f["path"] != "C"], "FRESH")
    assert tree(new) == ("FRESH", {"Z": None, "Z/B": b"1" * 700}) and new.data[:4] == b"boot" and len(new.data) == len(old)
    new = changes.with_files(changes.with_directory(image, "A/EMPTY"), [dict(path="A/NEW", data=b"3")])
    assert set(tree(new)[1]) == {"A", "A/B", "A/EMPTY", "A/NEW", "C"}
    assert set(tree(changes.deleted(new, ["a"]))[1]) == {"C"}
    for bad in (lambda: changes.with_files(image, [dict(path="c", data=b"")]), lambda: changes.with_directory(image, "c"), lambda: changes.rebuilt(disk.Image(bytes(143360)), list)):
        with pytest.raises(ValueError):
            bad()
    fs = filesystems.open_filesystem(changes.with_files(image, [dict(path="C", data=b"9")], overwrite=True))
    got = {e["path"]: e for e in fs.entries()}
    assert got["C"]["data"] == b"9" and got["A/B"]["aux_type"] == 5 and got["A/B"]["modified"] == WHEN and set(fs.used) == fs.marked()


@pytest.mark.parametrize("order", ["dos", "prodos", "physical"])
def test_rebuilt_dos_in_any_order(order):
    files = [dict(path="HELLO", kind="A", data=b"prog" * 100), dict(path="BIN", kind="B", data=b"x" * 900, aux_type=0x300, locked=True), dict(path="TEXT", kind="T", data=b"\xc1\x8d" * 200)]
    image = disk.Image(nibbles.reorder(filesystems.build_dos(files), order, "dos"), order)
    new = changes.with_files(changes.deleted(image, ["hello"]), [dict(path="MORE", kind="T", data=b"\xc2" * 300)])
    assert tree(new)[1] == {"BIN": b"x" * 900, "TEXT": b"\xc1\x8d" * 200, "MORE": b"\xc2" * 300}
    rows = {e["path"]: e for e in filesystems.open_filesystem(new).entries()}
    assert rows["BIN"]["access"] == 0x21 and rows["BIN"]["aux_type"] == 0x300
    assert filesystems.open_filesystem(changes.rebuilt(image, list, "77")).vtoc[6] == 77


def test_rebuilt_pascal():
    image = disk.Image(filesystems.build_pascal("WORK", [dict(path="A.TEXT", data=b"z" * 1500, kind=3), dict(path="B.CODE", data=b"q" * 512, kind=2)]))
    new = changes.with_files(changes.deleted(image, ["a.text"]), [dict(path="C.DATA", data=b"c")])
    assert tree(new) == ("WORK", {"B.CODE": b"q" * 512, "C.DATA": b"c"}) and tree(changes.rebuilt(image, list, "OTHER"))[0] == "OTHER"


def test_rebuilt_hfs():
    image = disk.Image(more_filesystems.build_hfs("Mac", [dict(path="One", data=b"1" * 700, rsrc=b"r" * 90), dict(path="Two", data=b"2")]))
    new = changes.with_files(changes.deleted(image, ["two"]), [dict(path="Three", data=b"3" * 2000)])
    fs = filesystems.open_filesystem(new)
    assert {e["path"]: (e["data"], e["rsrc"] or b"") for e in fs.entries()} == {"One": (b"1" * 700, b"r" * 90), "Three": (b"3" * 2000, b"")}
    assert filesystems.open_filesystem(changes.rebuilt(image, list, "New")).volume == "New"


def test_dos_volumes_embedded_in_prodos():
    dos = nibbles.reorder(filesystems.build_dos([dict(path="INSIDE", kind="T", data=b"\xc1" * 300)]), "prodos", "dos")
    for count in (1, 3):
        image = bytearray(filesystems.build_prodos("OUTER", [dict(path="F", data=b"x" * 3000)], 1600))
        start = 1600 - 280 * count
        for i in range(count):
            image[(start + 280 * i) * 512 : (start + 280 * i + 280) * 512] = dos
        for b in range(start, 1600):
            image[6 * 512 + b // 8] &= ~(0x80 >> b % 8)
        found = list(reader.scan("x.po", bytes(image)))
        assert [v["fs_format"] for v, _, _ in found] == ["ProDOS"] + ["DOS"] * count
        assert all([e["path"] for e in entries] == ["INSIDE"] and entries[0]["data"] == b"\xc1" * 300 for v, entries, _ in found[1:])
        system = found[0][2]
        assert set(system.used) == system.marked()


def test_changed_frame(spark):
    files = spark.createDataFrame([("a.shk", bytearray(archives.write_nufx(FILES[:2]))), ("b.shk", bytearray(b"no archive")), ("c.shk", None)], "path string, content binary")
    got = {r.path: r for r in changes.changed(files, lambda path, data: changes.recompressed(data, 0)).collect()}
    assert [got[p].status for p in ("a.shk", "b.shk", "c.shk")] == ["changed", "failed", "failed"]
    assert bytes(got["b.shk"].content) == b"no archive" and changes.archive_files(bytes(got["a.shk"].content)) == changes.archive_files(archives.write_nufx(FILES[:2]))


def test_transfer_and_delete_keep_packed_threads(monkeypatch):
    """What is packed as asked is not packed again, and what is not wanted is not expanded; what is wanted is still checked."""
    old = archives.write_nufx(FILES, 3)
    want = {f["path"]: f for f in changes.archive_files(old)}
    other = archives.write_nufx(FILES, 2)

    def compress(data, kind):
        assert not kind or len(data) < 64, "packed again"
        return 0, data

    with monkeypatch.context() as m:
        m.setattr(archives, "compress", compress)
        moved = changes.transferred(old, None, ["hello", "forked"])[0]
        rest = changes.without(old, ["hello", "forked"])
        noted = changes.commented(old, "hello", "new")
        with pytest.raises(AssertionError):
            changes.transferred(other, None, ["hello"])
    assert changes.archive_files(moved) == [want["Hello"], want["FORKED"]]
    assert changes.archive_files(rest) == [want["SUB/DEEP"], want["DISK"]]
    assert changes.archive_files(noted)[0] == want["Hello"] | {"comment": "new"} and changes.archive_files(noted)[1:] == changes.archive_files(old)[1:]
    again = changes.transferred(other, None, ["hello"])[0]
    assert again == changes.transferred(old, None, ["hello"])[0]

    payload = next(t["payload"] for r in archives.read_nufx(old) for t in r["threads"] if r["path"] == "SUB/DEEP" and t["thread_class"] == 2)
    broken = bytearray(old)
    broken[old.index(payload) + len(payload) // 2] ^= 1
    assert changes.transferred(bytes(broken), None, ["hello"])[0] == again
    assert [f["path"] for f in changes.archive_files(changes.without(bytes(broken), ["sub/deep"]))] == ["Hello", "FORKED", "DISK"]
    for change in (lambda: changes.transferred(bytes(broken), None, ["sub/deep"]), lambda: changes.without(bytes(broken), ["hello"])):
        with pytest.raises(ValueError):
            change()


def test_packing_of_runs_and_words():
    """The streams of LZW/1 and LZW/2 are what they were, however they are made; their lengths and digests are of the code before."""
    body = b"".join(b"line %d of the text\n" % (i * i % 977) for i in range(2000)) + b"\xdb" * 700 + b"a" * 5000 + bytes(range(256)) * 20
    got = [(len(p), hashlib.md5(p).hexdigest()) for p in (codecs.lzw1(body), codecs.lzw2(body))]
    assert got == [(11007, "e8b75ac4cad69bbbc204eb2b2f59e9aa"), (7374, "0a9b43f97d7e668f4e69fd3595e38976")]
    assert codecs.unlzw(codecs.lzw1(body), len(body), 1) == codecs.unlzw(codecs.lzw2(body), len(body), 2) == body
