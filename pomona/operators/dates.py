"""Packed dates of old file systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_prodos(when: Column) -> tuple[Column, Column]:
    """Date bits yyyyyyymmmmddddd and time bits 000hhhhh00mmmmmm."""
    year = F.pmod(F.year(when), F.lit(100))
    return (F.shiftleft(year, 9) + F.shiftleft(F.month(when), 5) + F.dayofmonth(when)).cast("int"), (F.shiftleft(F.hour(when), 8) + F.minute(when)).cast("int")


def windowed_year(two_digits: Column) -> Column:
    """Years below 40 are in the 2000s."""
    return F.when(two_digits < 40, two_digits + 2000).otherwise(two_digits + 1900)


def unpack_prodos(date: Column, time: Column) -> Column:
    """A timestamp, or null if the date is zero or no date."""
    year, month, day = windowed_year(F.shiftright(date, 9).bitwiseAND(0x7F)), F.shiftright(date, 5).bitwiseAND(0xF), date.bitwiseAND(0x1F)
    hour, minute = F.shiftright(time, 8).bitwiseAND(0x1F), time.bitwiseAND(0x3F)
    ok = (date != 0) & month.between(1, 12) & (day >= 1) & (hour < 24) & (minute < 60)
    return F.when(ok, F.try_make_timestamp_ntz(year, month, day, hour, minute, F.lit(0)))
