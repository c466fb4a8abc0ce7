"""Which entries an action takes: masks, marks, capabilities, look-ups by path or number, and checks of names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pomona.operators import names

#: What an action can ask of an entry, as bits: kinds of threads, and whether it may be a directory or a volume.
DATA, RSRC, DISK, COMMENT, DIRECTORY, VOLUME = (1 << i for i in range(6))
#: Features of a file archive, and which kinds of containers have them.
FEATURES = ("read_only", "hierarchic", "forks", "comments", "disk_images", "rename_volume", "case_kept", "sets_attributes")
CAPABILITIES = {
    "nufx": {"hierarchic", "forks", "comments", "disk_images", "case_kept", "sets_attributes"},
    "binary2": {"read_only", "hierarchic"},
    "acu": {"read_only", "hierarchic"},
    "applesingle": {"read_only", "forks"},
    "ProDOS": {"hierarchic", "forks", "rename_volume", "case_kept", "sets_attributes"},
    "HFS": {"hierarchic", "forks", "rename_volume", "case_kept", "sets_attributes"},
    "DOS": {"rename_volume", "case_kept"},
    "Pascal": {"rename_volume"},
    "CP/M": {"read_only"},
    "RDOS": {"read_only"},
    "Gutenberg": {"read_only"},
    "FAT": {"read_only"},
}
#: What names may be on each file system.
VALID = {
    "ProDOS": r"^[A-Za-z][A-Za-z0-9.]{0,14}$",
    "DOS": r"^[A-Za-z@\[\\\]^_][^,]{0,28}[^, ]$|^[A-Za-z@\[\\\]^_]$",
    "Pascal": r"^[^$=?,#: ]{1,15}$",
    "HFS": r"^[^:]{1,31}$",
    "nufx": r"^.{1,1000}$",
}


def thread_mask(entries: DataFrame, threads: DataFrame, keys: tuple[str, ...] = ("container_path", "ordinal")) -> DataFrame:
    """Entries with `mask`, the bits of what they hold: their data threads' kinds and comments."""
    kind = F.when((F.col("thread_class") == 2) & (F.col("kind") == 0), DATA).when((F.col("thread_class") == 2) & (F.col("kind") == 2), RSRC).when((F.col("thread_class") == 2) & (F.col("kind") == 1), DISK).when((F.col("thread_class") == 0) & (F.col("kind") == 1), COMMENT).otherwise(0)
    bits = threads.groupBy(*keys).agg(F.bit_or(kind).alias("__bits"))
    own = F.when(F.col("record_kind") == "directory", DIRECTORY).when(F.col("record_kind") == "volume", VOLUME).otherwise(0)
    return entries.join(bits, list(keys), "left").withColumn("mask", F.coalesce("__bits", F.lit(0)).bitwiseOR(own)).drop("__bits")


def selected(entries: DataFrame, wanted: int, mask: str = "mask", damaged: Column | None = None) -> DataFrame:
    """Entries that hold anything of what is wanted; damaged ones never."""
    sound = ~F.coalesce(damaged if damaged is not None else F.col("quality") == "damaged", F.lit(False))
    return entries.where(sound & (F.col(mask).bitwiseAND(wanted) != 0))


def marked(entries: DataFrame, change: str, mark: str = "selected") -> DataFrame:
    """Entries with every mark set (all), cleared (none) or turned over (invert)."""
    old = F.coalesce(F.col(mark), F.lit(False)) if mark in entries.columns else F.lit(False)
    new = {"all": F.lit(True), "none": F.lit(False), "invert": ~old}[change]
    return entries.withColumn(mark, new)


def with_children(entries: DataFrame, mark: str = "selected", path: str = "path", sep: str = "/") -> DataFrame:
    """Marks also what lies below a marked entry: each path meets its own ancestors, so this is a join by equality."""
    tops = entries.where(F.col(mark)).select(F.lower(path).alias("__top")).distinct()
    n = F.monotonically_increasing_id()
    e = entries.withColumn("__n", n)
    below = e.select("__n", F.explode(names.ancestors(F.lower(path), sep)).alias("__top")).join(tops, "__top", "left_semi").select("__n").distinct().withColumn("__below", F.lit(True))
    return e.join(below, "__n", "left").withColumn(mark, F.col(mark) | F.coalesce("__below", F.lit(False))).drop("__n", "__below")


def can(kind: Column, feature: str) -> Column:
    """Whether containers of a kind have a feature; unknown kinds have none and are read-only."""
    if feature not in FEATURES:
        raise ValueError(feature)
    have = [k for k, f in CAPABILITIES.items() if feature in f]
    known = kind.isin(*CAPABILITIES)
    return F.coalesce(kind.isin(*have) | (~known if feature == "read_only" else F.lit(False)), F.lit(feature == "read_only"))


def may_edit(kind: Column, damaged: Column, opened_read_only: Column | None = None) -> Column:
    """Whether a container can be changed: its kind is written, it is whole, and it wasn't opened read-only."""
    out = ~can(kind, "read_only") & ~F.coalesce(damaged, F.lit(False))
    return out if opened_read_only is None else out & ~F.coalesce(opened_read_only, F.lit(False))


def by_path(entries: DataFrame, path: str, name: str = "path") -> DataFrame:
    """The first entry of each volume with this path, without regard to case."""
    hit = entries.where(F.lower(name) == path.lower())
    first = hit.groupBy("volume_id").agg(F.min("ordinal").alias("ordinal"))
    return hit.join(first, ["volume_id", "ordinal"], "left_semi")


def by_number(entries: DataFrame, index: int | None = None, position: int | None = None, ids: str = "record_idx", ordinal: str = "ordinal") -> DataFrame:
    """Records by their lasting number, or by their place in the archive, from 0."""
    if (index is None) == (position is None):
        raise ValueError("either an index or a position")
    return entries.where(F.col(ids) == index) if index is not None else entries.where(F.col(ordinal) == position)


def in_list(value: Column, listed: Column) -> Column:
    """Whether a value is one of a list parted by semicolons, without regard to case and blanks; the empty value never is."""
    items = F.split(F.lower(F.replace(listed, F.lit(" "), F.lit(""))), ";")
    return (F.length(value) > 0) & F.array_contains(items, F.lower(value))


def valid_name(name: Column, kind: str) -> Column:
    """Whether a file system takes the name as it is; null names are none."""
    return F.coalesce(name.rlike(VALID[kind]), F.lit(False))


def find_in_text(text: Column, what: str, match_case: bool = False, whole: bool = False) -> Column:
    """The places (from 1) of all hits in a document, from left to right without overlap; whole words if asked for."""
    pattern = re.escape(what)
    if whole:
        pattern = rf"(?<![A-Za-z0-9]){pattern}(?![A-Za-z0-9])"
    flag = "" if match_case else "(?i)"
    hits = F.regexp_extract_all(text, F.lit(f"{flag}({pattern})"), F.lit(1))
    steps = F.zip_with(F.slice(F.split(text, f"{flag}{pattern}", -1), F.lit(1), F.size(hits)), hits, lambda before, hit: F.struct(F.length(before).alias("gap"), F.length(hit).alias("hit")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, start, lambda a, x: F.struct((a["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out")), lambda a: a["out"])


def next_hit(places: Column, cursor: Column, down: bool = True) -> Column:
    """The first place beyond the cursor, going on from the other end; null without any."""
    ahead = F.filter(places, lambda p: p > cursor if down else p < cursor)
    first = lambda a: F.array_min(a) if down else F.array_max(a)
    return F.coalesce(first(ahead), first(places))
