"""DataFrames of containers: volumes, entries, threads and chunks of whatever files a path holds.

Files are read by Spark's binaryFile source, so any store that Spark reaches will do, and each file is one
row of work. A damaged file gives a row with its error and never fails the job. Payloads are only carried
when asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pomona.functions.nibbles import TO_PHYSICAL
from pomona.sources import archives
from pomona.sources.disk import TRACK, Image, open_image, unwrap
from pomona.sources.filesystems import open_filesystem
from pomona.sources.partitions import embedded, open_partitions

VOLUMES = "container_path string, volume_id string, parent_volume_id string, depth int, outer_format string, file_format string, physical_format string, sector_order string, fs_format string, num_tracks int, sect_per_track int, num_blocks long, volume_name string, dos_volume_num int, damaged boolean, notes array<struct<level: string, text: string>>, status string, error string"
ENTRIES = "container_path string, volume_id string, ordinal int, path string, fssep string, sub_volume string, record_kind string, file_type long, aux_type long, access int, created_at timestamp_ntz, modified_at timestamp_ntz, data_len long, rsrc_len long, packed_len long, format string, source_fs string, quality string, data binary, rsrc binary"
THREADS = "container_path string, ordinal int, path string, thread_idx int, thread_class int, kind int, format string, crc16 int, eof long, comp_eof long, actual_eof long, status string, payload binary"
CHUNKS = "container_path string, volume_id string, chunk_idx long, users int, is_marked_used boolean"
#: An embedded image inside an archive is opened in turn, this deep.
DEPTH = 4
#: Rows of many containers go to Spark together, up to so many rows or bytes of payload.
FRAME_ROWS, FRAME_BYTES = 4096, 4 << 20


def _names(schema: str) -> list[str]:
    depth, out, start = 0, [], 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].split()[0])
            start = i + 1
    return out


def _archive(name: str, data: bytes, expand: bool = True):
    """(kind, entries, embedded disk images) of a file archive, or None. expand: NuFX entries get their contents, which checks them."""
    try:
        if archives.find_nufx(data) >= 0:
            rows, disks = [], []
            for r in archives.read_nufx(data):
                e = archives.record_entry(r)
                for t in r["threads"]:
                    what = archives.DATA_KINDS.get(t["kind"]) if t["thread_class"] == 2 else None
                    if what is None or (what != "disk" and not expand):
                        continue
                    try:
                        body = archives.thread_bytes(t, r.get("storage", 0))
                    except (ValueError, OSError):
                        e["quality"] = "damaged"
                        continue
                    if what == "disk":
                        disks.append((r["path"], body))
                    else:
                        e[what] = body
                rows.append(e)
            return "nufx", rows, disks
    except ValueError:
        pass
    for kind, read in (("binary2", archives.read_binary2), ("acu", archives.read_acu), ("applesingle", lambda d: [archives.read_applesingle(d, name)])):
        try:
            return kind, list(read(data)), []
        except (ValueError, IndexError, KeyError, struct.error):
            continue
    return None


def _image(name: str, body: bytes, wrappers: Sequence[Callable[[bytes], Image]]) -> tuple[Image, str | None]:
    for read in wrappers:
        try:
            return read(body), None
        except (ValueError, IndexError, struct.error):
            continue
    return open_image(name, body)


def scan(path: str, data: bytes, fs: str | None = None, order: str | None = None, extra: Sequence[type] = (), wrappers: Sequence[Callable[[bytes], Image]] = (), expand: bool = True) -> Iterator[tuple[dict, list[dict], object]]:
    """(volume, entries, file system) of a file and, below it, of the images inside it.

    fs and order: force a file system, and the order in which 16-sector tracks are kept. extra: further file systems.
    wrappers: further image formats, functions that read one or raise ValueError; they are tried first. expand: without
    it the files of NuFX archives are listed only, so a wrong CRC of their contents doesn't show.
    """
    stack: list[tuple] = [(path.rsplit("/", 1)[-1], data, path, None, 0)]
    while stack:
        name, body, volume_id, parent, depth = stack.pop()
        volume = dict(container_path=path, volume_id=volume_id, parent_volume_id=parent, depth=depth, damaged=False, notes=[], status="ok", error=None)
        entries, system = [], None
        try:
            inner, plain, outer, notes = (name, body, None, []) if isinstance(body, Image) else unwrap(name, body)
            found = None if isinstance(body, Image) else _archive(inner, plain, expand)
            if found:
                kind, entries, disks = found
                volume |= dict(outer_format=outer, file_format=kind, notes=list(notes))
                if depth < DEPTH:
                    stack += [(n, d, f"{volume_id}:{n}", volume_id, depth + 1) for n, d in disks]
            else:
                image, outer = (body, None) if isinstance(body, Image) else _image(name, body, wrappers)
                if order is not None and depth == 0:
                    if order not in TO_PHYSICAL or image.sectors != 16 or len(image.data) % TRACK:
                        raise ValueError(f"the image can't be read in {order} order")
                    image = replace(image, order=order)
                parts = open_partitions(image) if depth < DEPTH and fs is None else None
                system = None if parts else open_filesystem(image, fs, extra, settled=order is not None and depth == 0)
                used = system.image if system else image
                volume |= dict(outer_format=outer, file_format=image.file_format, physical_format=image.physical, sector_order=used.order, fs_format=parts[0] if parts else system.name if system else "unknown", num_tracks=image.tracks, sect_per_track=image.sectors, num_blocks=image.blocks, volume_name=system.volume if system else None, dos_volume_num=image.volume, damaged=image.damaged, notes=list(image.notes))
                entries = list(system.entries()) if system else []
                for n, part, blocks in embedded(system) if depth < DEPTH and fs is None else ():
                    system.used.update(blocks)
                    stack.append((n, part, f"{volume_id}:{n}", volume_id, depth + 1))
                for n, part in parts[1] if parts else ():
                    if part is None:  # a partition that can't be read is still listed
                        yield dict(container_path=path, volume_id=f"{volume_id}:{n}", parent_volume_id=volume_id, depth=depth + 1, damaged=True, notes=[], status="failed", error="the partition lies beyond the image"), [], None
                    else:
                        stack.append((n, part, f"{volume_id}:{n}", volume_id, depth + 1))
        except (ValueError, OSError, IndexError) as e:
            volume |= dict(status="failed", error=str(e)[:200])
        yield volume, entries, system


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _table(files: DataFrame, schema: str, rows) -> DataFrame:
    names = _names(schema)

    def frame(out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in names})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                for r in rows(path, bytes(content)):
                    out.append(r)
                    size += sum(len(r.get(n) or b"") for n in ("data", "rsrc", "payload"))
                    if len(out) >= FRAME_ROWS or size >= FRAME_BYTES:
                        yield frame(out)
                        out, size = [], 0
        if out:
            yield frame(out)

    return files.mapInPandas(run, schema)


def volumes(files: DataFrame, fs: str | None = None, **options) -> DataFrame:
    """One row per volume of the files (path, content), embedded ones included. options: those of `scan`."""

    def rows(path, content):
        for v, _, _ in scan(path, content, fs, expand=False, **options):
            yield v | {"notes": [{"level": a, "text": b} for a, b in v["notes"]]}

    return _table(files, VOLUMES, rows)


def entries(files: DataFrame, fs: str | None = None, payload: bool = False, **options) -> DataFrame:
    """One row per file in the containers; `sub_volume` names the volume inside a container. options: those of `scan`.

    Without payloads the files of archives are not expanded; their quality is then that of their headers alone.
    """

    def rows(path, content):
        for v, found, system in scan(path, content, fs, expand=payload, **options):
            inside = v["volume_id"][len(path) + 1 :]
            for i, e in enumerate(found):
                own = dict(container_path=path, volume_id=v["volume_id"], ordinal=i, sub_volume=inside, created_at=e["created"], modified_at=e["modified"], source_fs=system.name if system else v.get("file_format"))
                yield e | own | ({} if payload else {"data": None, "rsrc": None})

    return _table(files, ENTRIES, rows)


def threads(files: DataFrame, payload: bool = False) -> DataFrame:
    """One row per thread of NuFX archives, each expanded and its CRC checked."""

    def rows(path, content):
        try:
            for r in archives.read_nufx(unwrap(path, content)[1]):
                for t in r["threads"]:
                    try:
                        body, status = archives.thread_bytes(t, r.get("storage", 0)), "ok"
                    except (ValueError, OSError) as e:
                        body, status = None, str(e)
                    yield t | dict(container_path=path, ordinal=r["ordinal"], path=r["path"], format=archives.FORMATS.get(t["format"], "unknown"), actual_eof=None if body is None else len(body), status=status, payload=body if payload else None)
        except ValueError:
            return

    return _table(files, THREADS, rows)


def chunks(files: DataFrame, fs: str | None = None, **options) -> DataFrame:
    """One row per block (or sector, as track * sectors + sector) that a file uses or the bitmap marks."""

    def rows(path, content):
        for v, _, system in scan(path, content, fs, expand=False, **options):
            if system is None:
                continue
            flat = lambda c: c[0] * system.image.sectors + c[1] if isinstance(c, tuple) else c
            used, marked = {flat(c): n for c, n in system.used.items()}, system.marked()
            marked = None if marked is None else {flat(c) for c in marked}
            for c in sorted(used.keys() | (marked or set())):
                yield dict(container_path=path, volume_id=v["volume_id"], chunk_idx=c, users=used.get(c, 0), is_marked_used=None if marked is None else c in marked)

    return _table(files, CHUNKS, rows)


def read_volumes(spark: SparkSession, path: str, **options) -> DataFrame:
    return volumes(_files(spark, path), **options)


def read_entries(spark: SparkSession, path: str, **options) -> DataFrame:
    return entries(_files(spark, path), **options)


def read_threads(spark: SparkSession, path: str, **options) -> DataFrame:
    return threads(_files(spark, path), **options)


def read_chunks(spark: SparkSession, path: str, **options) -> DataFrame:
    return chunks(_files(spark, path), **options)


class EntriesSource(DataSource):
    """``spark.read.format("pomona")``: the entries of containers on a file system that all executors mount.

    For other stores use read_entries. Options: path, fs (forces a file system), payload.
    """

    @classmethod
    def name(cls) -> str:
        return "pomona"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _EntriesReader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _EntriesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.fs, self.payload = options["path"], options.get("fs"), options.get("payload", "false") == "true"

    def partitions(self):
        from pathlib import Path

        p = Path(self.path.removeprefix("file:"))
        return [_File(str(f)) for f in (sorted(x for x in p.rglob("*") if x.is_file()) if p.is_dir() else [p])]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            content = f.read()
        names = _names(ENTRIES)
        for v, found, system in scan(partition.value, content, self.fs):
            for i, e in enumerate(found):
                row = e | dict(container_path=partition.value, volume_id=v["volume_id"], ordinal=i, created_at=e["created"], modified_at=e["modified"], source_fs=system.name if system else v.get("file_format"))
                if not self.payload:
                    row |= {"data": None, "rsrc": None}
                yield tuple(row.get(n) for n in names)
