"""Queries that put the driver's documents into containers and read them back through the scans.

The tables hold no images, so each query first builds containers of a few documents each (a writer), then
catalogues and extracts them (a reader). What comes back must be the documents, which SQL can tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pomona.functions import codecs, converters
from pomona.operators import summary
from pomona.sources import archives, changes, disk, filesystems, reader

#: Documents in one container.
EACH = 8
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_BACK = "select doc_id, cast(strlen(text) as bigint) as n_bytes, md5(text) as digest from documents"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("data"), F.coalesce(F.floor(F.col("doc_id") / EACH), F.lit(-1)).alias("box"))


def _boxes(docs: DataFrame, build) -> DataFrame:
    """(path, content) of one container for each box; `build(box, files)` gives a file name and its bytes."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("doc_id")
        files = [dict(path="D" if pd.isna(i) else f"D{int(i)}", data=bytes(d or b""), file_type=4) for i, d in zip(t["doc_id"], t["data"])]
        name, content = build(int(t["box"].iloc[0]), files)
        return pd.DataFrame({"path": [name], "content": [content]})

    return docs.groupBy("box").applyInPandas(run, "path string, content binary")


def _read_back(files: DataFrame) -> DataFrame:
    e = reader.entries(files, payload=True).where("quality = 'good' and data is not null")
    return e.select(F.expr("try_cast(substring(path, 2) as bigint)").alias("doc_id"), "data_len", "data").select("doc_id", F.col("data_len").alias("n_bytes"), F.md5("data").alias("digest"))


def _query(f):
    QUERIES[f.__name__] = f
    ORACLES[f.__name__] = _BACK
    return f


def _prodos(box: int, files: list[dict]) -> tuple[str, bytes]:
    """A ProDOS volume, in one of six wrappers by turns."""
    need = 30 + sum(len(f["data"]) // 512 + 4 for f in files)
    image = disk.Image(filesystems.build_prodos(f"BOX{box}", files, max(280, need)))
    kind = box % 6
    if kind == 0:
        return f"{box}.po", image.data
    if kind in (1, 2):
        return f"{box}.po" + (".gz" if kind == 1 else ".zip"), disk.wrap(image.data, "gzip" if kind == 1 else "zip", f"{box}.po")
    if kind == 3:
        return f"{box}.2mg", disk.write_2mg(image, f"box {box}")
    if kind == 4:
        return f"{box}.hdv", disk.write_hdv(image)
    return f"{box}.shk", archives.write_nufx([dict(path="DISK", disk=image.data)], 6)


@_query
def images_prodos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(_boxes(_documents(spark, sf_dir), _prodos))


@_query
def images_pascal(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(box, files):
        return f"{box}.po", filesystems.build_pascal("BOX", files, max(280, 10 + sum(len(f["data"]) // 512 + 1 for f in files)))

    return _read_back(_boxes(_documents(spark, sf_dir), build))


@_query
def archives_nufx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box is packed with one of the eight thread formats by turns."""
    return _read_back(_boxes(_documents(spark, sf_dir), lambda box, files: (f"{box}.shk", archives.write_nufx(files, box % 8))))


@_query
def archives_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary II and ACU by turns."""
    return _read_back(_boxes(_documents(spark, sf_dir), lambda box, files: (f"{box}.bny", archives.write_binary2(files)) if box % 2 else (f"{box}.acu", archives.write_acu(files))))


@_query
def archives_recompressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives packed one way, packed anew another way, and read back."""
    boxes = _boxes(_documents(spark, sf_dir), lambda box, files: (f"{box}.shk", archives.write_nufx(files, box % 8)))
    return _read_back(changes.changed(boxes, lambda path, data: changes.recompressed(data, (len(path) + len(data)) % 8)))


@_query
def archives_laundered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives behind a Binary II header, made clean and bare."""
    boxes = _boxes(_documents(spark, sf_dir), lambda box, files: (f"{box}.bxy", changes.wrapped(archives.write_nufx(files, 2), f"BOX{box}.SHK")))
    return _read_back(changes.changed(boxes, lambda path, data: changes.laundered(data), lambda path: path[:-4] + ".shk"))


@_query
def archives_transferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each archive's files moved into a new archive, the other half deleted from a copy; both together hold all."""

    def half(path: str, data: bytes) -> bytes:
        paths = changes.archive_paths(data)
        if path.startswith("a"):
            return changes.transferred(data, None, paths[::2])[0]
        return changes.without(data, paths[::2]) if paths[1::2] else archives.write_nufx([])

    boxes = _boxes(_documents(spark, sf_dir), lambda box, files: (f"{box}.shk", archives.write_nufx(files, 3)))
    twice = F.explode(F.array(F.concat(F.lit("a"), "path"), F.concat(F.lit("b"), "path")))  # each archive is built once
    return _read_back(changes.changed(boxes.select(twice.alias("path"), "content"), half))


@_query
def archives_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives read forwards only, record by record."""

    def run(batches):
        import io

        for b in batches:
            rows = []
            for content in b["content"]:
                for r in changes.stream_records(io.BytesIO(bytes(content)).read):
                    data = next(archives.thread_bytes(t) for t in r["threads"] if t["thread_class"] == 2)
                    rows.append((int(r["path"][1:]), len(data), hashlib.md5(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "digest"])

    boxes = _boxes(_documents(spark, sf_dir), lambda box, files: (f"{box}.shk", archives.write_nufx(files, box % 8)))
    return boxes.mapInPandas(run, "doc_id long, n_bytes long, digest string")


@_query
def images_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes in one format, converted to another."""
    to = ("po", "2mg", "hdv", "po.gz", "shk", "po.zip")

    def build(box, files):
        return f"{box}.{('po', '2mg', 'hdv')[box % 3]}", changes.converted_image("x.po", _prodos(6, files)[1], ("po", "2mg", "hdv")[box % 3])

    def other(path: str) -> str:
        return to[int(path.split(".")[0]) * 5 % 6]

    boxes = _boxes(_documents(spark, sf_dir), build)
    return _read_back(changes.changed(boxes, lambda path, data: changes.converted_image(path, data, other(path)), lambda path: path.split(".")[0] + "." + other(path)))


def _with_sql(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@_with_sql(f"""select cast(doc_id // {EACH} % 8 as int) as kind, count(*) as threads, count(*) as good, cast(sum(strlen(text)) as bigint) as bytes from documents group by 1""")
def archive_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thread expanded and its CRC checked: the packing asked for, threads, good ones, bytes."""
    t = reader.threads(_boxes(_documents(spark, sf_dir), lambda box, files: (f"{box}.shk", archives.write_nufx(files, box % 8)))).where("thread_class = 2")
    kind = (F.regexp_extract("container_path", r"(\d+)\.shk", 1).cast("long") % 8).cast("int").alias("kind")
    return t.groupBy(kind).agg(F.count(F.lit(1)).alias("threads"), F.count_if((F.col("status") == "ok") & (F.col("actual_eof") == F.col("eof"))).alias("good"), F.sum("eof").alias("bytes"))


def _of_bytes(kind: str, f) -> Callable:
    """A column function of one byte string each."""

    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else f(bytes(b)))

    return F.pandas_udf(run, kind)


_FIRST = "xor(c >> 8, b)"
_MIXED = f"xor({_FIRST}, {_FIRST} >> 4)"


@_with_sql(f"""with p as (select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint)) as h from documents)
select doc_id, list_reduce(list_prepend(65535::bigint, h), lambda c, b: xor(xor(xor(c << 8, {_MIXED} << 12), {_MIXED} << 5), {_MIXED}) & 65535) as crc16 from p""")
def thread_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = _of_bytes("long", lambda b: codecs.crc16(b, 0xFFFF))
    return _documents(spark, sf_dir).select("doc_id", crc("data").alias("crc16"))


#: Characters beyond ASCII that Mac OS Roman has.
_MAC = "".join(chr(c) for c in sorted(ord(bytes([b]).decode("mac_roman")) for b in range(128, 256)))


@_with_sql(r"""with l as (select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '.{1,32}'), lambda s, i: rtrim(printf('%08x: ', 16 * (i - 1)) || rpad(rtrim(regexp_replace(lower(s), '(..)', '\1 ', 'g')), 47, ' ') || ' ' ||
  array_to_string(list_transform(regexp_extract_all(s, '..'), lambda x: case when (cast('0x' || x as int) & 127) between 32 and 126 then chr(cast('0x' || x as int) & 127) else '.' end), ''))) as lines from documents)
select doc_id, cast(length(dump) as bigint) as chars, md5(dump) as digest from (select doc_id, array_to_string(lines, chr(13) || chr(10)) || case when len(lines) > 0 then chr(13) || chr(10) else '' end as dump from l)""")
def hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of each document's dump; every line ends with CRLF."""
    d = _documents(spark, sf_dir).select("doc_id", _of_bytes("string", converters.hex_lines)("data").alias("dump"))
    return d.select("doc_id", F.length("dump").cast("long").alias("chars"), F.md5("dump").alias("digest"))


@_with_sql(f"""select doc_id, text = back as same, md5(back) as digest from (select doc_id, text, regexp_replace(text, '[^\\x00-\\x7F{_MAC}]', '?', 'g') as back from documents)""")
def mac_roman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as Mac OS Roman and back; a question mark stands for what that set lacks."""

    @F.pandas_udf("string")
    def back(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else s.encode("mac_roman", "replace").decode("mac_roman"))

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", back("text").alias("back"))
    return d.select("doc_id", (F.col("text") == F.col("back")).alias("same"), F.md5("back").alias("digest"))


#: Blocks of the volume that each box is built into, and those in use: boot, directory and bitmap, then each file's own and index blocks.
_SPACE = f"""with f as (select doc_id // {EACH} as box, greatest((strlen(text) + 511) // 512, 1) as n, strlen(text) // 512 + 4 as room from documents),
b as (select box, greatest(280, 30 + sum(room)) as total, 7 + sum(n + case when n > 256 then (n + 255) // 256 + 1 when n > 1 then 1 else 0 end) as used from f group by box),
v as (select *, box || case box % 6 when 0 then '.po' when 1 then '.po.gz' when 2 then '.po.zip' when 3 then '.2mg' when 4 then '.hdv' else '.shk:DISK' end as volume_id from b)"""


@_with_sql(_SPACE + " select volume_id, cast(used as bigint) as good, cast(0 as bigint) as unmarked, cast(0 as bigint) as unused, cast(0 as bigint) as conflict from v")
def volume_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in use against the bitmap for every volume that was built: all must agree."""
    c = reader.chunks(_boxes(_documents(spark, sf_dir), _prodos))
    state = F.when(F.col("users") > 1, "conflict").when((F.col("users") == 1) & F.col("is_marked_used"), "good").when(F.col("users") == 1, "unmarked").otherwise("unused")
    return c.withColumn("state", state).groupBy("volume_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("good", "unmarked", "unused", "conflict")))


@_with_sql(_SPACE + " select volume_id, 'ProDOS' as fs_format, cast(total as bigint) as total, cast(used as bigint) as used, cast(total - used as bigint) as free, cast((total - used) * 512 as bigint) as free_bytes from v")
def volume_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, used and free blocks of every volume that was built."""
    boxes = _boxes(_documents(spark, sf_dir), _prodos)
    return summary.volume_space(reader.volumes(boxes).where("fs_format = 'ProDOS'"), reader.chunks(boxes))


@_with_sql(f"""with f as (select doc_id // {EACH} as box, strlen(text) as n from documents), b as (select box, cast(sum(greatest((n + 511) // 512, 1) + case when n > 512 then (n + 131071) // 131072 else 0 end + case when n > 131072 then 1 else 0 end) + 7 as bigint) as files from f group by box)
select box || '.shk' as container_path, files + (files + 4095) // 4096 - 1 as blocks, cast(case """ + " ".join(f"when files + (files + 4095) // 4096 - 1 <= {n} then {n}" for n in summary.DISK_BLOCKS) + """ end as int) as disk_blocks from b""")
def required_disk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that a volume needs for each archive's files, and the smallest disk that holds them."""
    e = reader.entries(_boxes(_documents(spark, sf_dir), lambda box, files: (f"{box}.shk", archives.write_nufx(files, 0))))
    return summary.required_blocks(e, "container_path")


@_with_sql(f"""select doc_id // {EACH} || '.shk' as container_path, count(*) as entries, count(*) as files, cast(sum(strlen(text)) as bigint) as total, cast(sum(strlen(text)) as bigint) as packed, cast(0 as bigint) as saved, cast(0 as bigint) as damaged from documents group by 1""")
def entry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of archives whose files are stored as they are."""
    e = reader.entries(_boxes(_documents(spark, sf_dir), lambda box, files: (f"{box}.shk", archives.write_nufx(files, 0))))
    return summary.archive_totals(e, "container_path")


@_with_sql(f"""select count(distinct doc_id // {EACH}) as containers, count(distinct doc_id // {EACH}) as volumes, cast(0 as bigint) as failed, cast(0 as bigint) as damaged_volumes, count(*) as entries, count(*) as files, cast(sum(strlen(text)) as bigint) as total, cast(0 as bigint) as damaged from documents""")
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(_documents(spark, sf_dir), lambda box, files: (f"{box}.acu", archives.write_acu(files)))
    return summary.scan_statistics(reader.volumes(boxes), reader.entries(boxes))
