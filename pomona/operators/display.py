"""How catalogue columns are shown: ratios, access letters, types, dates, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The letters of the access bits, most significant first.
ACCESS_LETTERS = "dnb  iwr"


def percent(part: Column, full: Column) -> Column:
    """Whole percent, rounded down but at least 1 unless `full` is 0; nothing of nothing is 100."""
    exact = F.when(part < 21474836, F.floor(part * 100 / full)).otherwise(F.floor(part / F.floor(full / 100)))
    return F.when((part == 0) & (full == 0), 100).when((exact == 0) & (full != 0), 1).otherwise(exact).cast("int")


def ratio(total: Column, packed: Column) -> tuple[Column, Column]:
    """The percent column and its sort key: -1 if just one side is 0, 101 if packing made it larger."""
    odd = ((total == 0) & (packed != 0)) | ((total != 0) & (packed == 0))
    number = F.when(odd, -1).when(total < packed, 101).otherwise(percent(packed, total)).cast("int")
    shown = F.when(odd, "---").when(total < packed, ">100%").otherwise(F.concat(number.cast("string"), F.lit("%")))
    return shown, number


def access(bits: Column) -> Column:
    """The letters of the bits that are set."""
    return F.concat(*(F.when(bits.bitwiseAND(0x80 >> i) != 0, F.lit(letter)).otherwise("") for i, letter in enumerate(ACCESS_LETTERS)))


def read_only(bits: Column) -> Column:
    return bits.isin(0x21, 0x01)


def listed_name(name: Column, locked: Column) -> Column:
    """34 characters: a star if locked, then the name, or two dots and its last 30 characters."""
    shown = F.when(F.length(name) <= 32, F.rpad(name, 32, " ")).otherwise(F.concat(F.lit(".."), F.substring(name, -30, 30)))
    return F.concat(F.when(locked, "*").otherwise(" "), shown, F.lit(" "))


def aux_type(aux: Column, is_disk: Column, length: Column) -> Column:
    return F.when(is_disk, F.concat(F.floor(length / 1024).cast("string"), F.lit("k"))).otherwise(F.concat(F.lit("$"), F.lpad(F.hex(aux), 4, "0")))


def mac_type(code: Column) -> Column:
    """Four characters of a 32-bit code, high byte first; bytes that don't print become question marks."""
    byte = lambda n: F.shiftright(code, n).bitwiseAND(0xFF)
    return F.concat(*(F.when(byte(n).between(0x20, 0x7E), F.chr(byte(n))).otherwise("?") for n in (24, 16, 8, 0)))


def short_date(when: Column, none: Column | None = None, invalid: Column | None = None) -> Column:
    shown = F.date_format(when, "dd-MMM-yy HH:mm")
    out = F.when(when.isNull() if none is None else none, "[No Date]")
    return (out if invalid is None else out.when(invalid, "<invalid>")).otherwise(shown)


def size_text(n: Column) -> Column:
    """Bytes, or whole KB, MB or GB with one decimal."""
    one = lambda d: F.format_string("%.1f", F.floor(n * 10 / d) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, F.concat(one(1 << 10), F.lit("KB"))).when(n < 1 << 30, F.concat(one(1 << 20), F.lit("MB"))).otherwise(F.concat(one(1 << 30), F.lit("GB")))


def csv_cell(text: Column) -> Column:
    """A quoted cell, its quotes doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def listed(entries: DataFrame) -> DataFrame:
    """(volume_id, ordinal) and the nine columns of a list as they are shown: path, type, aux, date, format, size, ratio, packed, access."""
    from pomona.operators import types

    total = F.coalesce(F.col("data_len"), F.lit(0)) + F.coalesce(F.col("rsrc_len"), F.lit(0))
    disk = F.col("record_kind") == "disk"
    path = F.when(F.length("path") == 0, "<blank filename>").otherwise(F.col("path"))
    if "sub_volume" in entries.columns:
        path = F.when(F.coalesce("sub_volume", F.lit("")) != "", F.concat(F.lit("_"), F.col("sub_volume"), F.lit(":"), path)).otherwise(path)
    return entries.select(
        "volume_id", "ordinal", path.alias("path"), types.type_shown(F.coalesce(F.col("source_fs"), F.lit("")) if "source_fs" in entries.columns else F.lit(""), F.col("file_type"), F.col("record_kind"), F.col("aux_type")).alias("type"),
        F.when(~disk & ((F.col("file_type") > 0xFF) | (F.col("aux_type") > 0xFFFF)), mac_type(F.col("aux_type"))).otherwise(aux_type(F.col("aux_type"), disk, total)).alias("aux"), short_date(F.col("modified_at")).alias("date"), F.when(F.col("quality") == "damaged", "BROKEN").otherwise(F.col("format")).alias("format"),
        total.cast("string").alias("size"), ratio(total, F.coalesce(F.col("packed_len"), F.lit(0)))[0].alias("ratio"), F.coalesce(F.col("packed_len"), F.lit(0)).cast("string").alias("packed"), access(F.col("access")).alias("access"),
    )
