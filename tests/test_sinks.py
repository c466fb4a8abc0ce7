"""Listings, extraction, packed and ring images, and names."""

import os

import pytest

from pomona.functions import ddd
from pomona.operators import names
from pomona.sources import disk, filesystems, reader, sinks

DOS = [dict(path="HELLO", kind="A", data=b"prog" * 100), dict(path="A/B:C", kind="B", data=b"x" * 5000, aux_type=0x300), dict(path="TEXT", kind="T", data=b"\xc1" * 400, locked=True)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("disks")
    image = disk.Image(filesystems.build_dos(DOS), "dos")
    (d / "a.ddd").write_bytes(disk.write_ddd(image, 9))
    (d / "b.app").write_bytes(disk.write_trackstar(image, "some disk"))
    return d


def test_wrapped_images(spark, folder):
    v = {r.volume_id.rsplit("/", 1)[-1]: r for r in reader.read_volumes(spark, str(folder)).collect()}
    assert (v["a.ddd"].file_format, v["a.ddd"].dos_volume_num, v["a.ddd"].fs_format) == ("ddd", 9, "DOS")
    assert (v["b.app"].file_format, v["b.app"].fs_format, v["b.app"].notes[0].text) == ("trackstar", "DOS", "some disk")
    e = reader.read_entries(spark, str(folder), payload=True).collect()
    assert sorted(bytes(r.data) for r in e) == sorted(2 * [f["data"] for f in DOS])
    with pytest.raises(ValueError):
        ddd.unpack(bytes(50000))


def test_catalog_lines(spark, folder):
    lines = [r.line for r in sinks.text_catalog(reader.read_entries(spark, str(folder)), reader.read_volumes(spark, str(folder))).where("volume_id like '%a.ddd'").orderBy("line_no").collect()]
    assert lines[0] == "Disk: DOS 254 (140KB)" and len(lines) == 4
    assert lines[1].startswith(" HELLO".ljust(34)) and lines[3][0] == "*" and "[No Date]" in lines[1] and "$0300" in lines[2]


def test_extraction(spark, folder, tmp_path):
    out = sinks.extract_files(reader.read_entries(spark, str(folder), payload=True), str(tmp_path)).collect()
    assert len(out) == 6 and all(os.path.getsize(r.file) == r.length for r in out)
    assert sorted(os.listdir(tmp_path / "a.ddd")) == ["A%2fB%3aC#060300", "HELLO#fc0801", "TEXT#040000"]


def test_extraction_with_conversion(spark, tmp_path):
    files = [dict(path="NOTE", data=b"\xc1\xc2\x8d" * 20, file_type=4), dict(path="SUB/PIC", data=bytes(32768), file_type=0xC1), dict(path="PLAIN.BIN", data=b"\x60", file_type=6), dict(path="FORKED", data=b"d", rsrc=b"r" * 9, file_type=0xB3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "v.po").write_bytes(filesystems.build_prodos("V", files, 400))
    e = reader.read_entries(spark, str(tmp_path / "in"), payload=True)
    out = {os.path.basename(r.file): r for r in sinks.extract_files(e, str(tmp_path / "a"), preserve=False, convert=True).collect()}
    assert set(out) == {"NOTE.txt", "PIC.bmp", "PLAIN.BIN.txt", "FORKED.txt"} and open(out["NOTE.txt"].file, newline="").read() == "AB\r\n" * 20
    assert open(out["PIC.bmp"].file, "rb").read(2) == b"BM"
    out = sinks.extract_files(e, str(tmp_path / "b"), preserve=False, extensions=True, path_filter=lambda p: None if p.startswith("SUB") else "../../x/" + p).collect()
    assert sorted(os.path.relpath(r.file, tmp_path / "b") for r in out) == ["x/FORKED.S16", "x/FORKED.S16r", "x/NOTE.TXT", "x/PLAIN.BIN"]
    (tmp_path / "c").write_text("no folder")
    out = sinks.extract_files(e, str(tmp_path / "c"), on_error="skip").collect()
    assert len(out) == 5 and all(r.length is None and r.error for r in out)
    assert [bytes(r.content) for r in sinks.get_file(e, "sub/pic").collect()] == [bytes(32768)]


def test_tab_separated(spark, folder):
    assert all(r.line.count("\t") == 7 for r in sinks.tab_separated(reader.read_entries(spark, str(folder))).collect())


def test_names(spark):
    assert names.title_case("THE WAY OF THE IIGS AND PRODOS III BBS") == "The Way of the IIgs and ProDOS III BBS"
    assert names.title_case("Not ALL") == "Not ALL" and names.title_case("A-B/C.D") == "A-B/C.D"
    df = spark.createDataFrame([('one "two three" fo"u r" ', "NEW FILE")], "line string, name string")
    r = df.select(names.command_words(df.line).alias("w"), names.title_cased(df.name).alias("n")).first()
    assert r.w == ["one", "two three", "fou r"] and r.n == "New File"
