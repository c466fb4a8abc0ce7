"""Tables of names for numbers: calls, vectors and addresses of a system, read from text and looked up by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symbol_table(lines: DataFrame, text: str = "line", order: str = "line_no") -> DataFrame:
    """(section, value, name) from lines: ``*`` begins a section with its name, others are four hex digits, a blank and a name.

    Of equal values in a section the first counts. Other lines are passed over.
    """
    t = F.col(text)
    # a line's section is the last head at or before it; heads are few, lines meet them in one window over the file
    head = F.when(t.startswith("*"), F.trim(F.substring(t, 2, 1000)))
    src = lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = src.where(t.rlike("^[0-9A-Fa-f]{4} ")).select("section", F.conv(F.substring(t, 1, 4), 16, 10).cast("int").alias("value"), F.trim(F.substring(t, 6, 1000)).alias("name"), F.col(order).alias("__n"))
    return rows.groupBy("section", "value").agg(F.min_by("name", "__n").alias("name"))


def sorted_symbols(table: DataFrame) -> DataFrame:
    """The table with `place`, from 1, in the order of values within each section."""
    return table.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("value", "name")))


def lookup(rows: DataFrame, table: DataFrame, section: Column, value: Column, name: str = "name") -> DataFrame:
    """Rows with the name of their value in their section, null if it has none."""
    t = table.select(F.col("section").alias("__section"), F.col("value").alias("__value"), F.col("name").alias(name))
    return rows.join(t, (section == F.col("__section")) & (value == F.col("__value")), "left").drop("__section", "__value")


def names_of(table: DataFrame) -> dict[tuple[str, int], str]:
    """The table for listings, which take it along; a system has some thousand names."""
    most = 50_000
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    return {(r["section"], r["value"]): r["name"] for r in rows}
