"""What the operators of this folder share: reading tables, shared storage, folds and Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task handles at once; longer single texts are handled whole.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """df written once to the cluster's shared checkpoint folder, with its lineage cut.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a session in one process
    (tests) gets a folder of its own; a cluster is refused, as its executors would not share one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Ids are broadcast to a scan up to this number (16 MB), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """df joined (left_semi or left_anti) with one column of ids; wide rows are only shuffled if the ids are too many to broadcast."""
    ids = shared_checkpoint(ids.distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, ids.columns, how).select(*df.columns)


def carried(columns: Sequence[str]) -> list[Column]:
    """Columns that go through an operator untouched, under names of its own."""
    return [F.col(c).alias(f"carried_{i}") for i, c in enumerate(columns)]


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


@functools.lru_cache(1)
def _heap_trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def trim() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    _heap_trimmer()(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut between rows so that each holds about `limit` bytes of the text column at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(lengths) - lengths) // limit
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
            trim()


def filled(array: pa.Array) -> pa.Array:
    """Text as large_string in buffers of its own, with nulls as empty texts."""
    if array.offset:  # some string kernels read a slice from the start of its buffers
        array = array.take(pa.array(np.arange(len(array))))
    return pc.fill_null(array.cast(pa.large_string()), "")


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of texts with A-Z lower-cased.

    Returns each text's first word position (one more than texts), each word's index into the
    distinct words, and the distinct words as binary.
    """
    low = pc.ascii_lower(filled(texts))
    lists = pc.ascii_split_whitespace(low)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.cast(pa.large_binary())
    blank = np.flatnonzero(pc.binary_length(distinct).to_numpy(zero_copy_only=False) == 0)
    if len(blank):  # the splitter gives empty words at the ends of a text
        keep = ids != blank[0]
        kept = np.r_[0, np.cumsum(keep)]
        offsets, ids = kept[offsets], ids[keep]
    return offsets, ids, distinct


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_bytes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """xxh64 of each binary value."""
    import xxhash

    f = xxhash.xxh64_intdigest
    return np.fromiter((f(v, seed) for v in values.to_pylist()), np.uint64, len(values))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts, counts)


def pack_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(raw, other columns) -> (block, data): texts dealt into blocks, as compressed binary rows.

    A row's block follows from its columns and its partition's number, which parts repeated rows. So a
    task that is run again deals them alike.
    """
    columns = docs.columns
    docs = docs.withColumn("block", F.pmod(F.xxhash64(*columns, F.spark_partition_id()), F.lit(blocks)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in text_slices(batches, "raw", 12 << 20):
            block = b.column("block").to_numpy()
            rest = b.select(columns)
            order = np.argsort(block, kind="stable")
            found, data = [], []
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                sink = pa.BufferOutputStream()
                some = rest.take(pa.array(part))
                with pa.ipc.new_stream(sink, some.schema, options=options) as w:
                    w.write_batch(some)
                found.append(int(block[part[0]]))
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])

    return docs.mapInArrow(run, "block int, data binary")


def unpack_block(t: pa.Table) -> pa.Table:
    """A block's texts in one order, whatever the order of the rows that hold them."""
    parts = pa.concat_tables([pa.ipc.open_stream(d).read_all() for d in sorted(t.column("data").to_pylist())])
    return parts.combine_chunks()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays one after another: unsigned ones as they are, signed ones as small numbers in a byte with the others behind."""
    out = []
    for a in arrays:
        if a.dtype.kind == "u":
            out += [np.array([len(a)], np.int64).tobytes(), a.tobytes()]
        else:
            big = a[a > 254]
            out += [np.array([len(a), len(big)], np.int64).tobytes(), np.minimum(a, 255).astype(np.uint8).tobytes(), big.astype(np.int64).tobytes()]
    return b"".join(out)


def unpack_arrays(data: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays that `pack_arrays` wrote; kinds: 8, 4, 2 or 1 (bytes of an unsigned number) or s (small numbers)."""
    out, at = [], 0
    for k in kinds:
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        at += 8
        if k != "s":
            out.append(np.frombuffer(data, f"<u{k}", n, at))
            at += n * int(k)
            continue
        m = int(np.frombuffer(data, np.int64, 1, at)[0])
        a = np.frombuffer(data, np.uint8, n, at + 8).astype(np.int64)
        a[a == 255] = np.frombuffer(data, np.int64, m, at + 8 + n)
        at += 8 + n + 8 * m
        out.append(a)
    return out
