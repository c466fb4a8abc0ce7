"""Streamed containers give the rows that a scan of the folder gives."""

import os

from pomona.sources import archives, filesystems, reader
from pomona.streaming import catalog


def drain(df, name, folder, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_streamed_entries(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(4):
        (d / f"{i}.shk").write_bytes(archives.write_nufx([dict(path=f"F{i}", data=b"x" * (100 + i)), dict(path="G", data=b"same")]))
    (d / "v.po").write_bytes(filesystems.build_prodos("V", [dict(path="A/B", data=b"1" * 600)]))
    (d / "copy.shk").write_bytes((d / "0.shk").read_bytes())
    for i, f in enumerate(sorted(os.listdir(d))):
        os.utime(d / f, (1_700_000_000 + 600 * i,) * 2)
    files = catalog.stream_files(spark, str(d), 2)
    got = drain(catalog.stream_entries(files, payload=True), "entries", tmp_path / "c1")
    want = reader.read_entries(spark, str(d), payload=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 12
    assert {r.volume_name for r in drain(catalog.stream_volumes(files), "volumes", tmp_path / "c2")} == {None, "V"}
    rows = drain(catalog.arrivals(files, "30 minutes"), "arrivals", tmp_path / "c3", "complete")
    assert sum(r.files for r in rows) == 6 and sum(r.bytes for r in rows) == sum(os.path.getsize(d / f) for f in os.listdir(d)) and len(rows) == 3
    assert len(drain(catalog.first_of_each(files), "firsts", tmp_path / "c4")) == 5
