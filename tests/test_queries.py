"""Every registered query with SQL gives DuckDB's rows; the entry works with and without the training-data operators."""

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

from pomona.plans import catalog, containers, images, records

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
ORACLES = catalog.ORACLES | containers.ORACLES | images.ORACLES | records.ORACLES
QUERIES = catalog.QUERIES | containers.QUERIES | images.QUERIES | records.QUERIES


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(columns, data):
    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    got = tables.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in got.description], got.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).collect()


def test_text_detection_of_all_documents(spark, tmp_path):
    texts = [None, "", "plain " * 9, "Grüße aus Köln und München, ÄÖÜß\n" * 4, "naïve café\n" * 9, "À" * 60 + "\n", "日本語" * 30, "é" * 200 + "\n", "x" * 39 + "é", "short\n", "x" * 99 + "\u0081\n", "x\x01\x02" + "y" * 60, "’" + "z" * 120 + "\n"]
    rows = [(i if i < 30 else None, texts[i % len(texts)]) for i in range(36)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def kind(i, text):
        b = (text or "").replace("\n", {1: "\r", 2: "\r\n"}.get(i is not None and i % 3, "\n")).encode()
        lf, cr = b.count(b"\n"), b.count(b"\r")
        binary = sum(c < 8 or c == 11 or 14 <= c < 32 or c == 127 or 128 <= c < 160 for c in b)
        if len(b) < 40 or binary > (1 if len(b) < 100 else len(b) // 100):
            return "off"
        return "lf" if lf and not cr else "cr" if cr and not lf else "crlf" if lf and lf == cr else "unknown"

    got = [(r.doc_id, r.kind) for r in catalog.QUERIES["text_detection"](spark, str(tmp_path)).collect()]
    want = [(i, kind(i, x)) for i, x in rows]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {k for _, k in want} == {"off", "lf", "cr", "crlf", "unknown"}


def test_catalog_sort_of_the_whole_list(spark, tmp_path):
    rows = [(i * 7 % 301, [None, "Large Tin", "large tin", "SMALL", "small Tin"][i % 5], i % 3) for i in range(301)]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_size int").repartition(5).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["catalog_sort"](spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").lower(), r[2], r[0]))
    assert [r.p_partkey for r in sorted(got, key=lambda r: r.rank)] == [r[0] for r in order]
    assert sorted(r.rank for r in got) == list(range(1, 302))


def test_recompress_compare_of_all_documents(spark, tmp_path):
    rows = [(i if i < 40 else None, f"text {i}") for i in range(45)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sides = {r.side: r.n for r in catalog.QUERIES["recompress_compare"](spark, str(tmp_path)).collect()}
    assert sides == {"lost": 4, "new": 4}


def test_entry_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("pomona.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "eol_statistics" in e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_does_not_hide_errors():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "pomona.llm.common":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
try:
    import __spark_entry__
except ModuleNotFoundError:
    sys.exit(7)
"""
    if (ROOT / "corpus_pipeline.py").exists() and (ROOT / "pomona" / "llm").exists():
        assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 7


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "chars", "cr", "lf", "crlf", "high"] and df.count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
