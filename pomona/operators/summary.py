"""Totals and orders of catalogues: sizes, savings, damage, free space, checksums, and the orders of lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pomona.operators import display, types

#: Columns of a list, in the order in which they are shown.
COLUMNS = ("path", "type", "aux", "date", "format", "size", "ratio", "packed", "access")
#: Block counts of disks that are made, by the sizes that are offered.
DISK_BLOCKS = (280, 800, 1600, 2880, 4096, 8192, 16384, 32768, 65535)


def archive_totals(entries: DataFrame, *by: str) -> DataFrame:
    """Entries, files, bytes before and after packing, what packing saved, and how many are damaged."""
    total, packed = F.coalesce(F.col("data_len"), F.lit(0)) + F.coalesce(F.col("rsrc_len"), F.lit(0)), F.coalesce(F.col("packed_len"), F.lit(0))
    out = [
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("record_kind").isin("file", "forked", "disk")).alias("files"), F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum(packed), F.lit(0)).cast("long").alias("packed"), F.coalesce(F.sum(total - packed), F.lit(0)).cast("long").alias("saved"), F.count_if(F.col("quality") == "damaged").alias("damaged"),
    ]
    return entries.groupBy(*by).agg(*out)


def scan_statistics(volumes: DataFrame, entries: DataFrame) -> DataFrame:
    """What a scan of many containers found: files, volumes, those that failed, entries and bytes, in one row."""
    v = volumes.agg(F.countDistinct("container_path").alias("containers"), F.count(F.lit(1)).alias("volumes"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.col("damaged")).alias("damaged_volumes"))
    one = F.lit(1).alias("__one")
    return v.select("*", one).join(archive_totals(entries).select(one, "entries", "files", "total", "damaged"), "__one").drop("__one")


def damage_summary(volumes: DataFrame, entries: DataFrame) -> DataFrame:
    """volume_id, damaged, suspicious entries, and whether the volume or any of its own entries is damaged."""
    e = entries.groupBy("volume_id").agg(F.count_if(F.col("quality") == "damaged").alias("damaged_entries"), F.count_if(F.col("quality") == "suspicious").alias("suspicious_entries"))
    out = volumes.select("volume_id", F.coalesce("damaged", F.lit(False)).alias("volume_damaged")).join(e, "volume_id", "left").fillna(0, ["damaged_entries", "suspicious_entries"])
    return out.withColumn("any_damage", F.col("volume_damaged") | (F.col("damaged_entries") > 0))


def record_summary(threads: DataFrame, *keys: str) -> DataFrame:
    """What a catalogue shows of a record's threads: kind, lengths of both forks, packed length, format, comments.

    The last of resource forks and disk images decides the kind; a plain file only where neither is; a
    directory control thread overrules all. Missing forks have the length -1.
    """
    cls, kind, i = F.col("thread_class"), F.col("kind"), F.col("thread_idx")
    data = cls == 2
    first = lambda k: F.coalesce(F.min_by("eof", F.when(data & (kind == k), i)), F.lit(-1)).cast("long")
    strong = F.max_by(F.when(kind == 2, "forked").otherwise("disk"), F.when(data & kind.isin(1, 2), i))
    record = F.when(F.bool_or((cls == 1) & (kind == 0)), "directory").when(strong.isNotNull(), strong).when(F.bool_or(data & (kind == 0)), "file").otherwise("unknown")
    packed = F.coalesce(F.sum(F.when(data, F.col("comp_eof"))), F.lit(0)).cast("long")
    form = F.coalesce(F.min_by("format", F.when(data & (F.col("format") != "stored"), i)), F.lit("stored"))
    comment = (cls == 0) & (kind == 1)
    return threads.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("threads"), record.alias("record_kind"), first(0).alias("data_len"), first(2).alias("rsrc_len"), first(1).alias("disk_len"), packed.alias("packed_len"), form.alias("format"),
        F.bool_or(comment).alias("has_comment"), F.bool_or(comment & (F.col("eof") > 0)).alias("comment_nonempty"),
    )


def paired_forks(files: DataFrame, group: str, name: str, order: str, is_rsrc: Column) -> DataFrame:
    """(group, name, n, data, rsrc): the n-th data fork of a name with its n-th resource fork, -1 for none.

    Names pair without regard to case.
    """
    low = files.withColumn("__low", F.lower(name)).withColumn("__rsrc", is_rsrc)
    w = Window.partitionBy(group, "__low", "__rsrc").orderBy(order)
    n = low.withColumn("n", F.row_number().over(w).cast("long"))
    out = n.groupBy(group, "__low", "n").agg(F.max(F.when(~F.col("__rsrc"), F.col(order))).alias("data"), F.max(F.when(F.col("__rsrc"), F.col(order))).alias("rsrc"))
    return out.select(group, F.col("__low").alias(name), "n", F.coalesce("data", F.lit(-1)).alias("data"), F.coalesce("rsrc", F.lit(-1)).alias("rsrc"))


def recompress_savings(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Bytes of all records before and after packing anew, those saved, and the percent that is left."""
    packed = lambda df, n: df.groupBy(*keys).agg(F.sum("packed_len").cast("long").alias(n))
    j = packed(before, "before").join(packed(after, "after"), list(keys), "full_outer").fillna(0, ["before", "after"])
    return j.select(*keys, "before", "after", (F.col("before") - F.col("after")).alias("saved"), display.percent(F.col("after"), F.col("before")).alias("percent_left"))


def crc_compare(before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
    """side, n: CRC rows that only one of two archives has, with their numbers; none if a rewrite kept all contents."""
    a, b = before.select(*columns), after.select(*columns)
    only = lambda x, y, side: x.exceptAll(y).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return only(a, b, "lost").unionByName(only(b, a, "new"))


def free_space(chunks: DataFrame, unit: int = 512) -> DataFrame:
    """volume_id, free and used chunks by the bitmap, free bytes; nulls where a file system keeps none."""
    known = F.count("is_marked_used") > 0
    used = F.count_if(F.col("is_marked_used"))
    return chunks.groupBy("volume_id").agg(F.when(known, used).alias("used"), known.alias("__known")).select("volume_id", "used", F.when(F.col("__known"), F.lit(unit)).alias("unit"))


def volume_space(volumes: DataFrame, chunks: DataFrame) -> DataFrame:
    """volume_id, total, used and free chunks and free bytes; a chunk is a sector of 256 bytes on DOS disks, else a block.

    Chunks are used if the bitmap says so, and on file systems without one if a file holds them.
    """
    c = chunks.groupBy("volume_id").agg(F.count_if(F.coalesce("is_marked_used", F.col("users") > 0)).alias("used"))
    unit = F.when(F.col("fs_format") == "DOS", 256).otherwise(512)
    total = F.when(F.col("fs_format") == "DOS", F.col("num_tracks") * F.col("sect_per_track")).otherwise(F.col("num_blocks")).cast("long")
    j = volumes.select("volume_id", "fs_format", unit.alias("unit"), total.alias("total")).join(c, "volume_id", "left").fillna(0, ["used"])
    free = F.greatest(F.col("total") - F.col("used"), F.lit(0))
    return j.select("volume_id", "fs_format", "total", "used", free.alias("free"), (free * F.col("unit")).alias("free_bytes"))


def required_blocks(entries: DataFrame, *by: str) -> DataFrame:
    """blocks that a ProDOS volume needs for all entries, and the smallest disk offered that holds them (null if none does).

    A file takes its data blocks, an index block from two on, and a master index block beyond 256; a forked file both
    forks and a block for them; a directory one block for 13 entries; the volume its directory, boot and bitmap.
    """
    fork = lambda n: F.greatest(F.ceil(n / 512), F.lit(1)) + F.when(n > 512, F.ceil(n / 131072)).otherwise(0) + F.when(n > 131072, 1).otherwise(0)
    data, rsrc = F.coalesce(F.col("data_len"), F.lit(0)), F.col("rsrc_len")
    own = F.when(F.col("record_kind") == "directory", 1).when(rsrc.isNotNull(), fork(data) + fork(rsrc) + 1).otherwise(fork(data))
    need = entries.groupBy(*by).agg((F.coalesce(F.sum(own), F.lit(0)) + 7).cast("long").alias("files"))
    need = need.withColumn("blocks", F.col("files") + F.ceil(F.col("files") / 4096) - 1)
    size = F.lit(None).cast("int")
    for n in reversed(DISK_BLOCKS):
        size = F.when(F.col("blocks") <= n, n).otherwise(size)
    return need.select(*by, "blocks", size.alias("disk_blocks"))


def sparse_length(length: Column, stored: Column, unit: int = 512) -> Column:
    """The length without holes: chunks that are stored, but never more than the length."""
    return F.least(length, stored * unit)


def byte_histogram(df: DataFrame, data: str, top: int | None = None) -> DataFrame:
    """value, n: how often each byte stands in a binary column, and its rank; all 256 counters are summed in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for v in b.column(0):
                if v.is_valid and len(v.as_buffer()):
                    total += np.bincount(np.frombuffer(v.as_buffer(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["value", "n"])

    n = df.select(data).mapInArrow(run, "value int, n long").groupBy("value").agg(F.sum("n").alias("n")).where("n > 0")
    out = n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))  # at most 256 rows
    return out if top is None else out.where(F.col("rank") <= top)


def xor_fold(data: Column, seed: int = 0xFF) -> Column:
    """The XOR of all bytes of a binary column and the seed, as tapes keep it behind their data."""
    byte = lambda i: F.conv(F.substring(F.hex(data), 2 * i + 1, 2), 16, 10).cast("int")
    return F.when(data.isNotNull(), F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0))), lambda i: F.coalesce(byte(i), F.lit(0))), F.lit(seed), lambda a, x: a.bitwiseXOR(x)))


def _aux_key(quirk: bool) -> tuple[Column, Column]:
    """Disks come first; then the aux type. quirk: as a 32-bit difference, under which large values wrap around."""
    aux = F.col("aux_type")
    return F.when(F.col("record_kind") == "disk", 0).otherwise(1), (F.pmod(aux + F.lit(1 << 31), F.lit(1 << 32)) - (1 << 31)) if quirk else aux


def sort_keys(column: str, quirk: bool = False) -> list[Column]:
    """The columns by which a list is ordered for one of COLUMNS; ties keep the file order."""
    total = F.coalesce(F.col("data_len"), F.lit(0)) + F.coalesce(F.col("rsrc_len"), F.lit(0))
    plus = F.when(F.col("record_kind") == "forked", "+").otherwise("")
    kind = F.when(F.col("record_kind") == "disk", "Disk").otherwise(F.concat(types.type_name(F.col("file_type")), plus))
    aux = list(_aux_key(quirk))
    return {
        "path": [F.lower("path")], "type": [F.lower(kind), *aux], "aux": aux, "date": [F.col("modified_at")], "format": [F.col("format")], "size": [total],
        "ratio": [display.ratio(total, F.col("packed_len"))[1]], "packed": [F.col("packed_len")], "access": [F.col("access")],
    }[column]


def sorted_catalog(entries: DataFrame, column: str, descending: bool = False, quirk: bool = False, group: str | None = None) -> DataFrame:
    """Entries with `rank`, their place in the order of a column (within each group, if one is given).

    Without a group, ranks come from a range-partitioned sort and the partitions' sizes, so that no task sees all rows.
    """
    keys = [k.desc() if descending else k.asc() for k in sort_keys(column, quirk)] + [F.col("ordinal").desc() if descending else F.col("ordinal").asc()]
    if group is not None:
        return entries.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*keys)))
    parts = entries.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())
    w = Window.partitionBy("__part").orderBy(*keys)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row for each partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return parts.join(F.broadcast(before), "__part").withColumn("rank", F.row_number().over(w) + F.col("__before")).drop("__part", "__before")


def delete_order(entries: DataFrame, path: str = "path", sep: str = "/") -> DataFrame:
    """Entries with `depth` and `step`, the order in a volume in which they can be deleted: what lies deepest goes first."""
    depth = F.size(F.split(F.col(path), f"[{sep}]"))
    w = Window.partitionBy("volume_id").orderBy(F.desc("depth"), F.desc("ordinal"))
    return entries.withColumn("depth", depth).withColumn("step", F.row_number().over(w))


def listing_order(entries: DataFrame, path: str = "path", sep: str = "/") -> DataFrame:
    """Entries with `place`: every directory in front of what it holds, names without regard to case, file order for ties."""
    parts = F.split(F.lower(F.col(path)), f"[{sep}]")
    return entries.withColumn("place", F.row_number().over(Window.partitionBy("volume_id").orderBy(parts, "ordinal")))


def insert_places(entries: DataFrame, incoming: DataFrame, path: str = "path", sep: str = "/") -> DataFrame:
    """(volume_id, path, after): the ordinal behind which each incoming path goes, so that a directory's entries stay together.

    It goes behind the last entry of its own directory, or behind the directory itself if that is empty; -1 for the front.
    """
    parent = lambda c: F.when(F.instr(c, sep) > 0, F.expr(f"substring_index({c}, '{sep}', size(split({c}, '[{sep}]')) - 1)")).otherwise("")
    low = entries.select("volume_id", "ordinal", F.lower(path).alias("__p"))
    # an entry counts for every directory above it, and a directory for itself
    above = F.array_union(F.transform(F.sequence(F.lit(0), F.size(F.split("__p", f"[{sep}]")) - 1), lambda n: F.array_join(F.slice(F.split("__p", f"[{sep}]"), F.lit(1), n), sep)), F.array("__p"))
    last = low.select("volume_id", F.explode(above).alias("__dir"), "ordinal").groupBy("volume_id", "__dir").agg(F.max("ordinal").alias("after"))
    new = incoming.select("volume_id", F.col(path)).withColumn("__low", F.lower(path)).withColumn("__dir", parent("__low"))
    return new.join(last, ["volume_id", "__dir"], "left").select("volume_id", path, F.coalesce("after", F.lit(-1)).alias("after"))


def trailing_run(chunks: DataFrame) -> DataFrame:
    """(volume_id, first, length): the run of chunks at a volume's end that the bitmap marks but no file uses.

    Other volumes may be hidden there. Without such a run, length is 0.
    """
    c = chunks.groupBy("volume_id").agg(F.max("chunk_idx").alias("top"), F.coalesce(F.max(F.when(F.col("users") > 0, F.col("chunk_idx"))), F.lit(-1)).alias("last"), F.collect_set(F.when(F.col("is_marked_used") & (F.col("users") == 0), F.col("chunk_idx"))).alias("__idle"))
    idle = F.filter("__idle", lambda x: x > F.col("last"))
    low = F.coalesce(F.array_min(idle), F.col("top") + 1)
    whole = F.size(idle) == F.col("top") - low + 1  # without a gap up to the end
    return c.select("volume_id", F.when(whole, low).otherwise(F.col("top") + 1).cast("long").alias("first"), F.when(whole, F.size(idle)).otherwise(0).cast("long").alias("length"))
