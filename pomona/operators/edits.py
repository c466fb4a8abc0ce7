"""Edits of archives as new snapshots: deletes, renames, attributes, threads. Nothing is changed until it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each class and kind of data thread excludes in the same record.
EXCLUDES = {"data": ("data", "disk"), "disk": ("data", "disk", "rsrc"), "rsrc": ("rsrc", "disk")}


def delete_records(records: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Records without the doomed ones; an archive can't lose all of its records, which fails when the result is read."""
    j = records.join(doomed.select(key).distinct().withColumn("__doomed", F.lit(True)), key, "left").withColumn("__one", F.lit(1))
    rest = j.groupBy("__one").agg(F.count_if(F.col("__doomed").isNull()).alias("__rest"))  # one row
    none = F.raise_error(F.lit("an archive must keep a record")).cast("boolean")
    return j.join(rest, "__one").where(F.when(F.col("__rest") == 0, none).otherwise(F.col("__doomed").isNull())).select(*records.columns)


def rename_records(records: DataFrame, changes: DataFrame, key: str, name: str, new_name: str) -> DataFrame:
    """Records with `status`: renamed, kept, or collision, where two names would differ at most by case.

    On a collision those that were to be renamed keep their old names.
    """
    j = records.join(changes.select(key, F.col(new_name).alias("__new")), key, "left").withColumn("__name", F.coalesce("__new", name))
    clash = j.groupBy(F.lower("__name").alias("__low")).agg((F.count(F.lit(1)) > 1).alias("__clash"))
    j = j.withColumn("__low", F.lower("__name")).join(clash, "__low")
    moved = F.col("__new").isNotNull() & (F.col("__new") != F.col(name))
    status = F.when(~moved, "kept").when(F.col("__clash"), "collision").otherwise("renamed")
    out = j.withColumn("status", status).withColumn(name, F.when(F.col("status") == "renamed", F.col("__new")).otherwise(F.col(name)))
    return out.select(*records.columns, "status")


def set_attributes(records: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Records with every non-null attribute of their row of changes."""
    names = [c for c in changes.columns if c != key]
    j = records.join(changes.select(key, *(F.col(c).alias(f"__{c}") for c in names)), key, "left")
    return j.select(*(F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in records.columns))


def _among(values: tuple[str, ...]):
    return lambda m: m.isin(*values)


def thread_conflicts(threads: DataFrame, incoming: DataFrame, key: str, kind: str) -> DataFrame:
    """Incoming threads with `allowed`: not if the record has, or is to get, a thread that excludes this one."""
    have = threads.groupBy(key).agg(F.collect_set(kind).alias("__have"))
    more = incoming.groupBy(key).agg(F.collect_list(kind).alias("__more"))
    j = incoming.join(have, key, "left").join(more, key)
    barred = F.lit(False)
    for k, others in EXCLUDES.items():
        own = F.size(F.filter("__more", _among(others))) > 1
        old = F.arrays_overlap(F.coalesce("__have", F.array().cast("array<string>")), F.array(*map(F.lit, others)))
        barred = F.when(F.col(kind) == k, own | old).otherwise(barred)
    return j.select(*incoming.columns, (~barred).alias("allowed"))
