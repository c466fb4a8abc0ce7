"""Types, selections and summaries against plain Python."""

import pytest
from pyspark.sql import functions as F

from pomona.operators import edits as X
from pomona.operators import selection as L
from pomona.operators import summary as M
from pomona.operators import types as Y


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_types(spark):
    table = Y.name_table()
    assert table[0] == "NON" and table[0x04] == "TXT" and table[0xB3] == "S16" and table[0xFF] == "SYS" and table[0xA0] == "WP " and 0x17 not in table and len(table) == 100
    got = [r.x for r in spark.range(260).select(Y.type_name(F.col("id")).alias("x")).collect()]
    assert got[:256] == [table.get(i, f"${i:02X}") for i in range(256)] and set(got[256:]) == {"???"}
    assert one(spark, Y.type_name(F.lit(None).cast("long"))) is None
    assert one(spark, Y.type_description(F.lit(0xC0), F.lit(2))) == "Super hi-res (Apple Preferred Format)" and one(spark, Y.type_description(F.lit(0xC0), F.lit(99))) == "Packed super hi-res image"


def test_extensions(spark):
    def ext(name, code, fork="data", added=None):
        return one(spark, Y.extracted_extension(F.lit(name), F.lit(code), F.lit(fork), added=None if added is None else F.lit(added)))

    assert [ext("a", 4), ext("a.txt", 4), ext("a.me", 4), ext("a", 0xFC), ext("a", 0), ext("a", 0x17), ext("a.longer", 6), ext("a.12", 6), ext("a", 0, "disk"), ext("a.po", 0, "disk")] == [".TXT", "", ".TXT", ".BAS", "", "", "", "", ".PO", ""]
    assert ext("a.txt", 4, added=".txt") == ".TXT"
    kinds = {n: tuple(one(spark, Y.type_of_extension(F.lit(n)))) for n in ("x.shk", "x.C", "x.bas", "x.zzz", "x", "x.text")}
    assert kinds == {"x.shk": (0xE0, 0x8002), "x.C": (0xB0, 0x000A), "x.bas": (0xFC, 0), "x.zzz": (None, None), "x": (None, None), "x.text": (4, 0)}


def test_archive_names(spark):
    def name(local, **more):
        return tuple(one(spark, Y.archive_name(F.lit(local), **more)))

    assert name("A\\B%2fC%%#FC0801") == ("A/B/C%", 0xFC, 0x801, "data")
    assert name("../x/./y#b3db07r") == ("x/./y", 0xB3, 0xDB07, "rsrc")
    assert name("C:\\dir\\a.shk", extended=True) == ("dir/a.shk", 0xE0, 0x8002, "data")
    assert name("dir/a.shk") == ("dir/a.shk", 0, 0, "data") and name("/dir/a", junk=True) == ("a", 0, 0, "data")
    assert name("a#040000", preserved=False) == ("a#040000", 0, 0, "data")


def test_selection(spark):
    e = spark.createDataFrame([("v", 0, "A", True), ("v", 1, "A/b", False), ("v", 2, "a/B/c", False), ("v", 3, "AB", None)], "volume_id string, ordinal int, path string, selected boolean")
    assert [r.selected for r in L.with_children(e.fillna(False)).orderBy("ordinal").collect()] == [True, True, True, False]
    assert [r.selected for r in L.marked(e, "invert").orderBy("ordinal").collect()] == [False, True, True, True]
    assert [r.selected for r in L.marked(e.drop("selected"), "all").collect()] == [True] * 4
    assert [r.ordinal for r in L.by_path(e, "a/b").collect()] == [1] and [r.path for r in L.by_number(e, position=2).collect()] == ["a/B/c"]
    assert one(spark, L.find_in_text(F.lit("the The bathe"), "the")) == [1, 5, 11] and one(spark, L.find_in_text(F.lit("the The bathe"), "the", whole=True)) == [1, 5]
    assert one(spark, L.find_in_text(F.lit("a.a\nA.A"), "a.A", match_case=True)) == [] and one(spark, L.find_in_text(F.lit(""), "x")) == []
    places = F.array(F.lit(1), F.lit(5), F.lit(11))
    assert [one(spark, L.next_hit(places, F.lit(c), d)) for c, d in ((1, True), (11, True), (5, False), (1, False))] == [5, 1, 1, 11]
    assert one(spark, L.may_edit(F.lit("ProDOS"), F.lit(False))) and not one(spark, L.may_edit(F.lit("CP/M"), F.lit(False))) and not one(spark, L.may_edit(F.lit("odd"), F.lit(None).cast("boolean")))
    assert one(spark, L.in_list(F.lit("SHK"), F.lit("bxy; shk ;po"))) and not one(spark, L.in_list(F.lit(""), F.lit("a;;b")))


def test_sorted_catalog_over_many_partitions(spark):
    rows = [(i, f"n{i * 37 % 101}", i % 5, i * 7919 % 4294967296, "file", 1, None, 1, "f", 0xE3, None) for i in range(300)]
    e = spark.createDataFrame(rows, "ordinal int, path string, file_type long, aux_type long, record_kind string, data_len long, rsrc_len long, packed_len long, format string, access int, modified_at timestamp")
    for c in ("path", "type"):
        for down in (False, True):
            got = [r.ordinal for r in M.sorted_catalog(e.repartition(7), c, down).orderBy("rank").collect()]
            key = (lambda r: (r[1], r[0])) if c == "path" else (lambda r: (Y.name_table()[r[2]].lower(), r[3], r[0]))
            assert got == [r[0] for r in sorted(rows, key=key, reverse=down)]


def test_histogram_and_folds(spark):
    data = [b"aab", b"", None, bytes(range(256)), b"\xff" * 300]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(data)], "i int, d binary")
    got = {r.value: r.n for r in M.byte_histogram(df, "d").collect()}
    assert got[97] == 3 and got[255] == 301 and got[0] == 1 and len(got) == 256
    assert [r.value for r in M.byte_histogram(df, "d", 2).orderBy("rank").collect()] == [255, 97]

    def fold(b):
        out = 0xFF
        for x in b:
            out ^= x
        return out

    assert [r.x for r in df.orderBy("i").select(M.xor_fold(F.col("d")).alias("x")).collect()] == [None if b is None else fold(b) for b in data]


def test_required_blocks(spark):
    e = spark.createDataFrame([("a", "file", 0, None), ("a", "file", 513, None), ("a", "forked", 10, 140000), ("a", "directory", 0, None), ("b", "file", 40_000_000, None)], "v string, record_kind string, data_len long, rsrc_len long")
    got = {r.v: (r.blocks, r.disk_blocks) for r in M.required_blocks(e, "v").collect()}
    assert got["a"] == (7 + 1 + 3 + (1 + (274 + 2 + 1) + 1) + 1, 800) and got["b"][1] is None


def test_delete_records(spark):
    records, doomed = spark.range(5).withColumn("x", F.lit("a")), spark.createDataFrame([(1,), (3,), (3,), (9,)], "id long")
    assert sorted(r.id for r in X.delete_records(records, doomed, "id").collect()) == [0, 2, 4]
    assert X.delete_records(records.where("false"), doomed, "id").count() == 0
    with pytest.raises(Exception, match="must keep a record"):
        X.delete_records(records, spark.range(9), "id").collect()
