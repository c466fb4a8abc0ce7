"""Overrides and plug-ins of the readers, conversions of texts, and what volumes list."""

import sys
from collections import Counter

from pyspark import cloudpickle
from pyspark.sql import functions as F

from pomona.functions import nibbles
from pomona.operators import integrity as I
from pomona.operators import symbols as B
from pomona.operators import text as T
from pomona.sources import disk, filesystems, reader

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
FILES = [dict(path="HELLO", kind="T", data=b"\xc1\xc2" * 50)]


class Tiny:
    """A file system of one file: a mark, then its bytes."""

    name = "Tiny"

    def __init__(self, image):
        if image.block(0)[:4] != b"TINY":
            raise ValueError("no such volume")
        self.image, self.volume, self.used = image, "T", Counter([0])

    def marked(self):
        return {0}

    def entries(self):
        yield filesystems.entry(path="ONE", data=self.image.block(0)[4:9], data_len=5, format=self.name)


def boxed(data):
    """An image behind eight bytes of its own."""
    if data[:8] != b"BOXEDIMG":
        raise ValueError("no box")
    return disk.Image(data[8:], None, file_format="boxed")


def test_order_can_be_forced():
    data = nibbles.reorder(filesystems.build_dos(FILES), "prodos", "dos")
    first = lambda **o: next(iter(reader.scan("x.dsk", data, **o)))
    assert first(order="prodos")[0]["sector_order"] == "prodos" and first(order="prodos")[0]["fs_format"] == "DOS"
    assert "can't be read in odd order" in first(order="odd")[0]["error"] and first(fs="Pascal")[0]["fs_format"] == "unknown"


def test_plug_ins(spark):
    files = [("a.bin", bytearray(b"BOXEDIMG" + b"TINYhello".ljust(1024, b"\0"))), ("b.do", bytearray(filesystems.build_dos(FILES)))]
    df = spark.createDataFrame(files, "path string, content binary")
    e = {r.container_path: r for r in reader.entries(df, payload=True, extra=(Tiny,), wrappers=(boxed,)).collect()}
    assert bytes(e["a.bin"].data) == b"hello" and e["a.bin"].format == "Tiny" and e["b.do"].path == "HELLO"
    v = {r.container_path: r for r in reader.volumes(df, extra=(Tiny,), wrappers=(boxed,)).collect()}
    assert v["a.bin"].file_format == "boxed" and v["a.bin"].fs_format == "Tiny"
    assert reader.chunks(df.where("path = 'a.bin'"), extra=(Tiny,), wrappers=(boxed,)).first().users == 1


def test_text_conversions(spark):
    def one(text, *args, **kw):
        return spark.range(1).select(T.converted(F.lit(text), *args, **kw).alias("x")).first().x

    assert one("a\rb\nc\r\nd", "lf") == "a\nb\nc\nd" and one("a\rb", "cr") == "a\rb" and one("a\r", mode="off") == "a\r"
    high = "".join(chr(ord(c) | 0x80) for c in "hi\rho")
    assert one(high, high="on") == "hi\r\nho" and one(high, high="auto") == "hi\r\nho" and one(high + "x", high="auto") == high + "x" and one("a\0b", strip_nulls=True) == "ab"
    body = "plain text, long enough to be told\r" * 3
    assert one(body, mode="auto") == body.replace("\r", "\r\n") and one(body.replace("\r", "\r\n"), mode="auto") == body.replace("\r", "\r\n")
    assert one("\1\2\3\r" * 30, mode="auto") == "\1\2\3\r" * 30


def test_chunk_letters(spark):
    rows = [(0, 1, True, "system"), (1, 1, True, "data"), (2, 2, True, "data"), (3, 0, True, None), (4, 1, False, "data"), (5, 0, False, None), (6, 1, True, None), (40, 1, True, "structure")]
    df = spark.createDataFrame([("v", *r) for r in rows], "volume string, chunk int, users int, marked boolean, purpose string")
    df = df.withColumn("letter", I.chunk_letter(F.col("users"), F.col("marked"), F.col("purpose")))
    assert {r.line: r.map for r in I.chunk_map(df, "volume", "chunk", "letter").collect()} == {0: "SF#X!.?".ljust(32, "-"), 1: "-" * 8 + "I" + "-" * 23}


def test_symbol_files(spark):
    lines = ["junk", "* Tools", "0A02 _First", "0a02 _Again", "020A  _Second ", "no", "* P8", "0A02 OPEN"]
    table = B.symbol_table(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_no int, line string"))
    assert B.names_of(table) == {("Tools", 0x0A02): "_First", ("Tools", 0x020A): "_Second", ("P8", 0x0A02): "OPEN"}
    assert [(r.section, r.value, r.place) for r in B.sorted_symbols(table).orderBy("section", "place").collect()] == [("P8", 0x0A02, 1), ("Tools", 0x020A, 1), ("Tools", 0x0A02, 2)]
