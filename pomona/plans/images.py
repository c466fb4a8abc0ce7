"""Queries that write the driver's documents into further images, archives and programs, and read them back.

Documents are cut into pieces that fit small disks; a document that comes back is the pieces of all its disks in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pomona.functions import converters
from pomona.functions.nibbles import reorder
from pomona.operators import names
from pomona.plans.containers import _BACK, EACH, _boxes, _documents, _prodos
from pomona.sources import archives, changes, disk, filesystems, more_filesystems, reader, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Bytes of a piece, and of the pieces on one disk.
PIECE, FLOPPY, LARGE = 14_000, 98_000, 600_000


def _query(sql: str = _BACK):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _disks(docs: DataFrame, room: int, build: Callable[[int, int, list[dict]], tuple[str, bytes]]) -> DataFrame:
    """(path, content) of as many disks for each box as its documents' pieces need."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        box, out, pieces, size = int(t["box"].iloc[0]), [], [], 0
        for i, d in zip(t.sort_values("doc_id")["doc_id"], t.sort_values("doc_id")["data"]):
            d = bytes(d or b"")
            for k in range(max(1, -(-len(d) // PIECE))):
                part = d[k * PIECE : (k + 1) * PIECE]
                if pieces and size + len(part) > room:
                    out.append(build(box, len(out), pieces))
                    pieces, size = [], 0
                pieces.append(dict(path=f"D{int(i)}.{k}", data=part, kind="T", file_type=4))
                size += len(part) + 600
        out.append(build(box, len(out), pieces))
        return pd.DataFrame(out, columns=["path", "content"])

    return docs.where("doc_id is not null").groupBy("box").applyInPandas(run, "path string, content binary")


def _whole(files: DataFrame, **options) -> DataFrame:
    """Each document's pieces put together; a piece that is missing or damaged leaves it short."""
    e = reader.entries(files, payload=True, **options).where("record_kind <> 'directory'")
    name = F.split("path", "[.]")
    e = e.select(name[0].substr(F.lit(2), F.lit(20)).cast("long").alias("doc_id"), name[1].cast("int").alias("k"), "data")
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.hex("data").alias("h")))), lambda x: x["h"]), "")
    return e.groupBy("doc_id").agg(F.unhex(data).alias("data")).select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


FLOPPIES = ("do", "po", "nib", "app", "ddd", "2mg", "do.gz", "po.zip")


@_query()
def images_dos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOS volumes in eight formats by turns."""

    def build(box, n, files):
        kind = FLOPPIES[(box + n) % len(FLOPPIES)]
        return f"{box}-{n}.{kind}", changes.converted_image("x.do", filesystems.build_dos(files), kind)

    return _whole(_disks(_documents(spark, sf_dir), FLOPPY, build))


@_query()
def images_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ProDOS and DOS volumes on sector images whose names say nothing of their order."""

    def build(box, n, files):
        prodos = filesystems.build_prodos("V", files, 280)
        data, order = ((prodos, "prodos"), (filesystems.build_dos(files), "dos"))[(box + n) % 2]
        return f"{box}-{n}.dsk", reorder(data, ("dos", "prodos", "cpm", "physical")[box % 4], order)

    return _whole(_disks(_documents(spark, sf_dir), FLOPPY, build))


@_query()
def images_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """800K disks: checksummed images of ProDOS and HFS volumes."""

    def build(box, n, files):
        data = filesystems.build_prodos("BIG", files, 1600) if (box + n) % 2 else more_filesystems.build_hfs("Big", files)
        return f"{box}-{n}.{'dc' if box % 3 else 'po'}", disk.write_dc42(disk.Image(data), f"box {box}") if box % 3 else data

    return _whole(_disks(_documents(spark, sf_dir), LARGE, build))


@_query()
def images_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """800K ProDOS disks that hide one DOS volume or two in their last blocks, and keep every other piece themselves."""

    def build(box, n, files):
        count = 1 + (box + n) % 2
        inner, rest = files[::2], files[1::2]
        data = bytearray(filesystems.build_prodos("OUTER", rest, 1600))
        for i in range(count):
            at = 1600 - 280 * (i + 1)
            data[at * 512 : (at + 280) * 512] = reorder(filesystems.build_dos(inner[i::count]), "prodos", "dos")
        for b in range(1600 - 280 * count, 1600):
            data[6 * 512 + b // 8] &= ~(0x80 >> b % 8)
        return f"{box}-{n}.po", bytes(data)

    return _whole(_disks(_documents(spark, sf_dir), FLOPPY, build))


def _mac_map(parts: list[bytes]) -> bytes:
    out, at = bytearray(b"ER".ljust(512, b"\0")), 64
    for i, p in enumerate(parts):
        row = b"PM\0\0" + len(parts).to_bytes(4, "big") + at.to_bytes(4, "big") + (len(p) // 512).to_bytes(4, "big") + f"Part {i}".encode().ljust(32, b"\0") + b"Apple_PRODOS".ljust(32, b"\0")
        out += row.ljust(512, b"\0")
        at += len(p) // 512
    return bytes(out).ljust(64 * 512, b"\0") + b"".join(parts)


def _micro_drive(parts: list[bytes]) -> bytes:
    head, at = bytearray(512 * 256), 256
    head[:2], head[12] = b"\xca\xcc", len(parts)
    for i, p in enumerate(parts):
        head[32 + 4 * i : 36 + 4 * i], head[64 + 4 * i : 68 + 4 * i] = at.to_bytes(4, "little"), (len(p) // 512).to_bytes(4, "little")
        at += len(p) // 512
    return bytes(head) + b"".join(parts)


def _focus_drive(parts: list[bytes]) -> bytes:
    head, at = bytearray(512 * 3), 3
    head[:14], head[15] = b"Parsons Engin.", len(parts)
    for i, p in enumerate(parts):
        head[32 + 16 * i : 40 + 16 * i] = at.to_bytes(4, "little") + (len(p) // 512).to_bytes(4, "little")
        head[512 + 32 * i : 544 + 32 * i] = f"PART{i}".encode().ljust(32, b"\0")
        at += len(p) // 512
    return bytes(head) + b"".join(parts)


@_query()
def images_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ProDOS volumes under one of three partition maps by turns."""

    def build(box, n, files):
        parts = [filesystems.build_prodos(f"P{i}", files[i::2], 1600) for i in (0, 1)]
        return f"{box}-{n}.po", (_mac_map, _micro_drive, _focus_drive)[(box + n) % 3](parts)

    return _whole(_disks(_documents(spark, sf_dir), LARGE, build))


@_query()
def archives_applesingle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{i}.as", archives.write_applesingle(dict(path=f"D{i}.0", data=bytes(d or b""), file_type=4))) for i, d in zip(b["doc_id"], b["data"])]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return _whole(_documents(spark, sf_dir).where("doc_id is not null").select("doc_id", "data").mapInPandas(run, "path string, content binary"))


# --- converters

_PLAIN = "regexp_replace(text, '[^\\x0A\\x20-\\x7E]', '', 'g')"


def _converted(spark: SparkSession, sf_dir: str, encode: Callable[[str], bytes], name: str | None, file_type: int, aux_type: int = 0) -> DataFrame:
    """Printable ASCII of the documents as files of a kind, through a converter: its name and its output's digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "data": [encode(t) for t in b["text"]]})

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x0A\\x20-\\x7E]", "").alias("text"))
    files = d.mapInPandas(run, "doc_id long, data binary").select(F.col("doc_id").cast("string").alias("volume_id"), F.lit(0).alias("ordinal"), F.lit("X").alias("path"), F.lit(file_type).cast("long").alias("file_type"), F.lit(aux_type).cast("long").alias("aux_type"), F.lit("ProDOS").alias("source_fs"), "data", F.lit(None).cast("binary").alias("rsrc"))
    out = converters.outputs(files, name)
    return out.select(F.col("volume_id").cast("long").alias("doc_id"), "converter", F.md5("text").alias("digest"))


@_query(f"select doc_id, 'text' as converter, md5(replace({_PLAIN}, chr(10), chr(13) || chr(10))) as digest from documents")
def converted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High ASCII with returns, as DOS disks keep texts."""
    return _converted(spark, sf_dir, lambda t: bytes(ord(c) | 0x80 for c in t.replace("\n", "\r")), "text", 4)


@_query(f"select doc_id, 'gs_text' as converter, md5(replace({_PLAIN}, chr(10), chr(13) || chr(10))) as digest from documents")
def converted_gs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir, lambda t: t.replace("\n", "\r").encode(), None, 0x50)


@_query(f"select doc_id, 'pascal_text' as converter, md5(replace(regexp_replace({_PLAIN}, '(^|\\n)', '\\1   ', 'g'), chr(10), chr(13) || chr(10))) as digest from documents")
def converted_pascal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with a count of three blanks, in blocks filled up with zeros."""

    def encode(t: str) -> bytes:
        body = "\r".join("\x10#" + line for line in t.split("\n")).encode()
        return bytes(1024) + body + bytes(-len(body) % 1024)

    return _converted(spark, sf_dir, encode, None, 3)


@_query(f"""with l as (select doc_id, string_split({_PLAIN}, chr(10)) as lines from documents)
select doc_id, 'applesoft' as converter, md5(array_to_string(list_transform(lines, lambda x, i: ' ' || (10 * i) || '  REM ' || x), chr(13) || chr(10)) || chr(13) || chr(10)) as digest from l""")
def converted_applesoft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of remarks, one for each line."""

    def encode(t: str) -> bytes:
        out, at = bytearray(), 0x801
        for i, line in enumerate(t.split("\n"), 1):
            body = b"\xb2" + line.encode()
            at += 5 + len(body)
            out += (at & 0xFFFF or 1).to_bytes(2, "little") + (10 * i).to_bytes(2, "little") + body + b"\0"
        return bytes(out + b"\0\0")

    return _converted(spark, sf_dir, encode, None, 0xFC)


@_query(f"""with l as (select doc_id, flatten(list_transform(string_split({_PLAIN}, chr(10)), lambda x: case when x = '' then [''] else regexp_extract_all(x, '.{{1,200}}') end)) as lines from documents)
select doc_id, 'sc_assembler' as converter, md5(array_to_string(list_transform(lines, lambda x, i: printf('%04d', 10 * i) || ' ' || x || chr(13) || chr(10)), '')) as digest from l""")
def converted_assembler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of numbered lines; a longer line goes on in the next one, as a line's length is a byte."""

    def encode(t: str) -> bytes:
        lines = [x[i : i + 200] for x in t.split("\n") for i in range(0, max(1, len(x)), 200)]
        return b"".join(bytes((len(x) + 4,)) + (10 * i).to_bytes(2, "little") + x.encode() + b"\0" for i, x in enumerate(lines, 1))

    return _converted(spark, sf_dir, encode, "sc_assembler", 0xFA)


# --- tables and listings


def _stored(box: int, files: list[dict]) -> tuple[str, bytes]:
    return f"{box}.shk", archives.write_nufx(files, 0)


@_query(f"""with b as (select doc_id // {EACH} as box, greatest(280, 30 + sum(strlen(text) // 512 + 4)) as total from documents group by 1)
select box || case box % 6 when 0 then '.po' when 1 then '.po.gz' when 2 then '.po.zip' when 3 then '.2mg' when 4 then '.hdv' else '.shk:DISK' end as volume_id, case when box % 6 = 1 then 'gzip' when box % 6 = 2 then 'zip' end as outer_format,
  case box % 6 when 3 then '2mg' when 4 then 'sim2e' else 'sector' end as file_format, 'ProDOS' as fs_format, cast(total as bigint) as num_blocks, 'BOX' || box as volume_name, false as damaged, 'ok' as status from b""")
def volume_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan says of each volume."""
    v = reader.volumes(_boxes(_documents(spark, sf_dir), _prodos)).where("fs_format is not null")
    return v.select("volume_id", "outer_format", "file_format", "fs_format", "num_blocks", "volume_name", "damaged", "status")


@_query(f"""select doc_id // {EACH} || '.shk' as container_path, 'D' || doc_id as path, x.thread_class, 0 as kind, 'stored' as format, cast(case when x.thread_class = 3 then length('D' || doc_id) else strlen(text) end as bigint) as eof, 'ok' as status
from documents, (select unnest([2, 3]) as thread_class) x""")
def thread_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thread of archives whose files are stored: names and contents."""
    t = reader.threads(_boxes(_documents(spark, sf_dir), _stored))
    return t.select("container_path", "path", "thread_class", "kind", "format", "eof", "status")


@_query(f"""with d as (select doc_id // {EACH} as box, doc_id, row_number() over (partition by doc_id // {EACH} order by doc_id) as n, strlen(text) as size from documents)
select box || '.shk' as volume_id, cast(0 as bigint) as line_no, 'Disk: ? (0KB)' as line from (select distinct box from d) union all
select box || '.shk', n, ' ' || rpad('D' || doc_id, 32, ' ') || '  TXT   $0000 [No Date]       stored   100% ' || lpad(cast(size as varchar), 9, ' ') from d""")
def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(_documents(spark, sf_dir), _stored)
    return sinks.text_catalog(reader.entries(boxes), reader.volumes(boxes)).select("volume_id", F.col("line_no").cast("long").alias("line_no"), "line")


@_query(f"""select doc_id, 'D' || doc_id || chr(9) || '4' || chr(9) || '0' || chr(9) || '' || chr(9) || 'stored' || chr(9) || strlen(text) || chr(9) || strlen(text) || chr(9) || '227' as line from documents""")
def clipboard_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sinks.tab_separated(reader.entries(_boxes(_documents(spark, sf_dir), _stored)))
    return lines.select(F.regexp_extract("line", r"^D(\d+)", 1).cast("long").alias("doc_id"), "line")


@_query("select doc_id, 'D%2f' || doc_id || '%3f%%#040000' as local_path, 'D_' || doc_id || '_%' as plain_path from documents")
def extraction_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with signs that other systems reserve, with and without preservation."""
    e = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("D/"), F.col("doc_id").cast("string"), F.lit("?%")).alias("path"), F.lit(":").alias("fssep"), F.lit(4).cast("long").alias("file_type"), F.lit(0).cast("long").alias("aux_type"))
    return sinks.extraction_names(e).select("doc_id", "local_path", names.local_name(F.col("path"), False).alias("plain_path"))
