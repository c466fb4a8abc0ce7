"""Cassette signals, whole and in pieces."""

import random

import numpy as np

from pomona.streaming import cassette


def test_decoder_in_any_pieces():
    rng = random.Random(1)
    for rate in (22050, 44100, 48000):
        a, b = rng.randbytes(200), rng.randbytes(33)
        x = np.r_[np.zeros(500), cassette.signal(a, rate), cassette.signal(b, rate, 1000)]
        d = cassette.Decoder(rate)
        got = d.feed(x) + d.finish()
        assert [(r[2], r[3]) for r in got] == [(a, True), (b, True)]
        d, parts, at = cassette.Decoder(rate), [], 0
        while at < len(x):
            n = rng.randint(1, 5000)
            parts += d.feed(x[at : at + n])
            at += n
        assert [r[2:] for r in parts + d.finish()] == [r[2:] for r in got]


def test_lost_tone_and_wrong_checksum():
    d = cassette.Decoder(44100)
    assert d.feed(cassette.signal(b"abc", tone=300)) + d.finish() == []
    x = cassette.signal(bytes(100))
    cut = x[: len(x) - 2000]
    d = cassette.Decoder(44100)
    got = d.feed(np.r_[cut, np.zeros(2000)]) + d.finish()
    assert len(got) == 1 and not got[0][3]


def test_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(cassette.write_wav(cassette.signal(b"hello")))
    (tmp_path / "b.wav").write_bytes(b"no wave")
    got = cassette.decode_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(bytes(r.data), r.checksum_ok) for r in got] == [(b"hello", True)]


def test_stream(spark, tmp_path):
    rng = random.Random(2)
    data = {f"s{i}": rng.randbytes(40 + i) for i in range(3)}
    schema = "signal string, piece long, rate int, samples binary"
    for k in range(4):
        rows = []
        for name, d in data.items():
            x = np.r_[cassette.signal(d), np.zeros(500, np.int16)].astype("<i2")
            rows.append((name, k, 44100, bytearray(np.array_split(x, 4)[k].tobytes())))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = cassette.decode_stream(src).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = {r.signal: (bytes(r.data), r.checksum_ok) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: (v, True) for k, v in data.items()}
