"""Sinks: listings of catalogues, and files extracted from containers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pomona.functions import converters
from pomona.operators import display, selection, types
from pomona.operators.names import local_name, preservation_tag


def text_catalog(entries: DataFrame, volumes: DataFrame) -> DataFrame:
    """(container_path, volume_id, line_no, line): a fixed-width listing for each volume, headed by its name and size.

    Lengths show as ???? where a packed file has no length; damaged files have the format BROKEN.
    """
    v = volumes.where("status = 'ok'").select(
        "container_path", "volume_id", F.lit(-1).alias("ordinal"),
        F.format_string("Disk: %s (%dKB)", F.coalesce("volume_name", F.lit("?")), F.floor(F.coalesce("num_blocks", F.lit(0)) / 2)).alias("line"),
    )
    e = entries.withColumn("total", F.col("data_len") + F.coalesce("rsrc_len", F.lit(0)))
    name = F.when(F.length("path") == 0, "<blank filename>").otherwise(F.col("path"))
    kind = F.rpad(F.coalesce(types.type_shown(F.col("source_fs"), F.col("file_type"), F.col("record_kind"), F.col("aux_type")), F.lit("???")), 5, " ")
    aux = F.concat(F.lit("$"), F.lpad(F.hex(F.col("aux_type").cast("long")), 4, "0"))
    shown = F.when(F.col("quality") == "damaged", "BROKEN").otherwise(F.rpad("format", 6, " "))
    length = F.when((F.col("total") == 0) & (F.col("packed_len") > 0), "????").otherwise(F.col("total").cast("string"))
    ratio = display.ratio(F.col("total"), F.col("packed_len"))[0]
    line = F.concat_ws(" ", display.listed_name(name, display.read_only(F.col("access"))), kind, aux, F.rpad(display.short_date(F.col("modified_at")), 15, " "), shown, F.lpad(ratio, 6, " "), F.lpad(length, 9, " "))
    rows = v.unionByName(e.select("container_path", "volume_id", "ordinal", line.alias("line")))
    w = Window.partitionBy("volume_id").orderBy("ordinal")
    return rows.select("container_path", "volume_id", (F.row_number().over(w) - 1).alias("line_no"), "line")


def extraction_names(entries: DataFrame, preserve: bool = True) -> DataFrame:
    """Entries with `local_path`: each component made acceptable, with a preservation tag if asked for."""
    sep = F.when((F.col("fssep") == "\0") | F.col("fssep").isNull(), "\x01").otherwise(F.col("fssep"))
    parts = F.split(F.replace("path", sep, F.lit("\x01")), "\x01")
    path = F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: local_name(p, preserve)), "/")
    tag = preservation_tag(F.col("file_type"), F.col("aux_type"), F.lit("data"))
    return entries.withColumn("local_path", F.concat(path, tag) if preserve else path)


#: Extensions of what a converter makes.
KINDS = {"text": ".txt", "rtf": ".rtf", "csv": ".csv", "bitmap": ".bmp", "raw": ""}
ERRORS = ("fail", "skip")


def extract_files(entries: DataFrame, folder: str, preserve: bool = True, convert: bool = False, extensions: bool = False, path_filter: Callable[[str], str | None] | None = None, on_error: str = "fail") -> DataFrame:
    """Writes each data and resource fork below `folder`, which all executors must share; returns what was written.

    convert: data forks go through their best converter, and get its output's extension; what can't be converted is
    written as it is. extensions: names get their type's extension. path_filter: gives another path below the folder
    for each, or None to leave a fork out; a path can't leave the folder. on_error: a file that can't be written
    fails the job, or is a row with its error and no length. Files are written under a temporary name and renamed, so a task
    that runs again leaves whole files.
    """
    if on_error not in ERRORS:
        raise ValueError(on_error)
    named = extraction_names(entries.where("data is not null or rsrc is not null"), preserve)
    if extensions:
        tail = types.extracted_extension(F.col("path"), F.col("file_type"), F.lit("data"))
        named = named.withColumn("local_path", F.concat("local_path", tail))
    src = named.select("volume_id", "ordinal", "path", "local_path", "file_type", "aux_type", "source_fs", "data", "rsrc")

    def bodies(r: dict) -> Iterator[tuple[bytes, str]]:
        data, rsrc = (None if r[k] is None else bytes(r[k]) for k in ("data", "rsrc"))
        if convert:
            out = converters.convert({**r, "data": data or b"", "rsrc": rsrc, "file_type": int(r["file_type"] or 0), "aux_type": int(r["aux_type"] or 0)})
            made = out["bitmap"] if out["kind"] == "bitmap" else None if out["text"] is None else out["text"].encode("latin-1" if out["kind"] == "raw" else "utf-8")
            if made is not None:
                yield made, KINDS.get(out["kind"], "")
                return
        if data is not None:
            yield data, ""
        if rsrc is not None:
            yield rsrc, "r"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                for body, mark in bodies(r):
                    wanted = r["local_path"] + mark
                    if path_filter is not None and (wanted := path_filter(wanted)) is None:
                        continue
                    inside = os.path.normpath(os.path.join("/", r["volume_id"].rsplit("/", 1)[-1].replace(":", "_"), wanted.lstrip("/")))
                    path = folder + inside
                    try:
                        os.makedirs(os.path.dirname(path), exist_ok=True)
                        with open(path + ".part", "wb") as f:
                            f.write(body)
                        os.replace(path + ".part", path)
                    except OSError as e:
                        if on_error == "fail":
                            raise
                        rows.append((r["volume_id"], r["ordinal"], path, None, str(e)[:200]))
                        continue
                    rows.append((r["volume_id"], r["ordinal"], path, len(body), None))
            yield pd.DataFrame(rows, columns=["volume_id", "ordinal", "file", "length", "error"]).astype({"length": "Int64"})

    return src.mapInPandas(run, "volume_id string, ordinal int, file string, length long, error string")


def get_file(entries: DataFrame, path: str, fork: str = "data") -> DataFrame:
    """(volume_id, content) of the first file with this path in each volume, as one command hands a file on."""
    return selection.by_path(entries, path).select("volume_id", F.col(fork).alias("content"))


def tab_separated(entries: DataFrame) -> DataFrame:
    """One line per entry for a clipboard: cells parted by tabs, quotes doubled where a cell has any."""
    cell = lambda c: F.when(F.col(c).cast("string").rlike('["\t]'), display.csv_cell(F.col(c).cast("string"))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return entries.select("volume_id", "ordinal", F.concat_ws("\t", *map(cell, ("path", "file_type", "aux_type", "modified_at", "format", "data_len", "packed_len", "access"))).alias("line"))
