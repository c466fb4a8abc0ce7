"""Names and paths: parts, searches, comparisons across separators, and their forms on other systems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_name(path: Column, sep: str) -> Column:
    """The last component; one separator at the end is overlooked."""
    cut = F.when(path.endswith(sep), path.substr(F.lit(1), F.length(path) - 1)).otherwise(path)
    return F.substring_index(cut, sep, -1)


def extension(path: Column, sep: str) -> Column:
    """From the last dot of the last component on; a dot at the very end, or none, is no extension."""
    name = F.substring_index(path, sep, -1)
    tail = F.substring_index(name, ".", -1)
    return F.when(~name.contains(".") | (tail == ""), "").otherwise(F.concat(F.lit("."), tail))


def finds(name: Column, what: str, sep: str, match_case: bool = False, whole: bool = False) -> Column:
    """Substring search; whole: only between separators or the ends."""
    name, what = (name, what) if match_case else (F.lower(name), what.lower())
    if not whole:
        return name.contains(what)
    return name.rlike(f"(^|{re.escape(sep)}){re.escape(what)}({re.escape(sep)}|$)")


def find_next(entries: DataFrame, order: str, cursor: int, hit: Column, down: bool = True) -> DataFrame:
    """The first hit after the cursor, going on from the other end; the cursor's own row comes last."""
    ahead = F.col(order) > cursor if down else F.col(order) < cursor
    way = F.col(order).asc() if down else F.col(order).desc()
    return entries.where(hit).orderBy(F.when(ahead, 0).otherwise(1), way).limit(1)


def comparable(path: Column, sep: str) -> Column:
    """A form in which paths with different separators compare: a separator only equals a separator."""
    return F.replace(F.lower(path), F.lit(sep), F.lit("\x01"))


def ancestors(path: Column, sep: str) -> Column:
    """All directories above the path, for joins by equality instead of by prefix."""
    parts = F.split(path, re.escape(sep))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def below_count(entries: DataFrame, path: str, sep: str) -> DataFrame:
    """directory, entries: how many entries lie below each directory, without regard to case.

    Each path meets its own ancestors (as many as it has components), so this is one aggregation and
    not a join of all entries with all directories.
    """
    e = entries.select(F.lower(path).alias("p"))
    e = e.where(F.instr("p", sep) > 0)
    return e.select(F.explode(ancestors(F.col("p"), sep)).alias("directory")).groupBy("directory").agg(F.count(F.lit(1)).alias("entries"))


def unique_names(entries: DataFrame, name: str, group: str, order: str, width: int) -> DataFrame:
    """Repeated names in a group get a dot and a number, cut so that they still fit."""
    w = Window.partitionBy(group, name).orderBy(order)
    n = F.row_number().over(w) - 1
    tail = F.concat(F.lit("."), F.col("__n").cast("string"))
    out = entries.withColumn("__n", n)
    return out.withColumn("unique_name", F.when(F.col("__n") == 0, F.col(name)).otherwise(F.concat(F.col(name).substr(F.lit(1), F.least(F.length(name), F.lit(width) - F.length(tail))), tail))).drop("__n")


def preservation_tag(file_type: Column, aux: Column, fork: Column) -> Column:
    """``#tt`` and ``aaaa``, or eight digits each if either is too large; r for a resource fork, i for a disk image."""
    digits = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    short = (file_type < 0x100) & (aux < 0x10000)
    body = F.when(short, F.concat(digits(file_type, 2), digits(aux, 4))).otherwise(F.concat(digits(file_type, 8), digits(aux, 8)))
    return F.concat(F.lit("#"), body, F.when(fork == "rsrc", "r").when(fork == "disk", "i").otherwise(""))


def read_tag(name: Column) -> Column:
    """Struct (base, file_type, aux_type, fork) of a name with a preservation tag; nulls without one."""
    whole = r"^(.*)#([0-9a-fA-F]{6}|[0-9a-fA-F]{16})([ri]?)$"
    part = lambda i: F.regexp_extract(name, whole, i)
    half = F.when(F.length(part(2)) == 6, 2).otherwise(8)
    number = lambda c: F.conv(c, 16, 10).cast("long")
    ok = name.rlike(whole)
    return F.struct(
        F.when(ok, part(1)).otherwise(name).alias("base"),
        F.when(ok, number(part(2).substr(F.lit(1), half))).alias("file_type"),
        F.when(ok, number(part(2).substr(half + 1, F.lit(8)))).alias("aux_type"),
        F.when(ok, F.when(part(3) == "r", "rsrc").when(part(3) == "i", "disk").otherwise("data")).alias("fork"),
    )


def local_name(name: Column, preserve: bool) -> Column:
    """A name that other systems accept: signs they reserve become ``_``, or ``%`` and two digits if kept; device names are marked."""
    reserved = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(?=\.|$)"
    bad = r'[\\/:*?"<>|\x00-\x1f\x7f-￿]'
    if not preserve:
        out = F.regexp_replace(name, bad, "_")
        return F.when(name.rlike(reserved), F.concat(F.lit("_"), out)).otherwise(out)
    out = F.replace(name, F.lit("%"), F.lit("%%"))
    for ch in '\\/:*?"<>|':
        out = F.replace(out, F.lit(ch), F.lit("%%%02x" % ord(ch)))
    return F.when(name.rlike(reserved), F.concat(F.lit("%00"), out)).otherwise(out)


#: Characters that Pascal names can't have, and the longest extension, with its dot, that a cut keeps.
PASCAL_BAD, KEPT_EXTENSION = "$=?,[#:", 4
#: Longest names; HFS names beyond 31 characters are cut to 15.
LONGEST = {"ProDOS": 15, "DOS": 30, "Pascal": 15, "HFS": 31}


def _cut(name: Column, longest: int, to: int | None = None) -> Column:
    """A name cut to `to` characters if it is longer than `longest`; a short extension is kept."""
    to = longest if to is None else to
    tail = F.concat(F.lit("."), F.substring_index(name, ".", -1))
    keeps = name.contains(".") & (F.length(tail) <= KEPT_EXTENSION)
    short = F.when(keeps, F.concat(name.substr(F.lit(1), F.lit(to) - F.length(tail)), tail)).otherwise(F.substring(name, 1, to))
    return F.when(F.length(name) > longest, short).otherwise(name)


def prodos_name(name: Column) -> Column:
    """At most 15 letters, digits, dots and blanks, the first a letter: A goes before a digit, Z stands for nothing.

    Case is kept, and blanks too; ``prodos_stored`` gives what a directory holds.
    """
    start = F.regexp_replace(name, "^[^A-Za-z0-9]+", "")
    start = F.when(start == "", "Z").when(start.rlike("^[0-9]"), F.concat(F.lit("A"), start)).otherwise(start)
    return _cut(F.regexp_replace(start, "[^A-Za-z0-9. ]", ""), LONGEST["ProDOS"])


def prodos_stored(name: Column) -> Column:
    """The upper-case name of a directory entry; blanks are dots there."""
    return F.translate(F.upper(name), " ", ".")


def dos_name(name: Column) -> Column:
    """At most 30 printable ASCII characters in upper case, with ``_`` for a comma; BLANK if nothing is left."""
    out = F.substring(F.upper(F.translate(F.regexp_replace(name, "[^\\x20-\\x7E]", ""), ",", "_")), 1, LONGEST["DOS"])
    return F.when(out == "", "BLANK").otherwise(out)


def pascal_name(name: Column) -> Column:
    """At most 15 printable characters in upper case without blanks and those that Pascal reserves; BLANK if nothing is left."""
    out = F.substring(F.upper(F.regexp_replace(name, "[^\\x21-\\x7E]|[" + re.escape(PASCAL_BAD) + "]", "")), 1, LONGEST["Pascal"])
    return F.when(out == "", "BLANK").otherwise(out)


def hfs_name(name: Column) -> Column:
    return _cut(F.translate(name, ":", "_"), LONGEST["HFS"], LONGEST["ProDOS"])


def normalized(path: Column, kind: str, sep: str) -> Column:
    """A path as a file system takes it: flat ones get the last component, others all, parted by their own separator."""
    if kind in ("DOS", "Pascal"):
        return (dos_name if kind == "DOS" else pascal_name)(F.substring_index(path, sep, -1))
    own, part = ("/", prodos_name) if kind == "ProDOS" else (":", hfs_name)
    return F.array_join(F.transform(F.split(path, re.escape(sep)), part), own)


def lower_case_flags(name: Column, flags: Column) -> Column:
    """The name with the letters in lower case whose bit is set, from bit 14 down."""
    letters = F.split(name, "")
    return F.array_join(F.transform(letters, lambda ch, i: F.when(F.pmod(F.floor(flags / F.pow(F.lit(2.0), 14 - i)), F.lit(2)) == 1, F.lower(ch)).otherwise(ch)), "")


#: Words that keep their case, words with a spelling of their own, and short ones that start small after a blank.
AS_THEY_ARE = ("BBS", "3D")
SPELLED = ("ProDOS", "IIe", "IIc", "IIgs")
SMALL_WORDS = ("of", "the", "a", "an", "and", "to", "in")
_TOKEN = re.compile(r"[^ .:&\-+/\\()<>@*]+")


def title_case(name: str) -> str:
    """An all-capitals name in book-title case; one with any small letter stays as it is."""
    if name is None or any("a" <= c <= "z" for c in name):
        return name

    def cased(m: re.Match) -> str:
        token = m.group()
        if token.upper() in AS_THEY_ARE or not token.strip("IVX"):
            return token
        for word in SPELLED:
            if token.upper() == word.upper():
                return word
        small = name[m.start() - 1 : m.start()] == " " and token.lower() in SMALL_WORDS
        return token.lower() if small else token[0] + token[1:].lower()

    return _TOKEN.sub(cased, name)


def title_cased(name: Column) -> Column:
    def run(names: pd.Series) -> pd.Series:
        return names.map(title_case)

    return F.pandas_udf(run, "string")(name)


def command_words(line: Column) -> Column:
    """Words between blanks; quotes hold blanks together and are dropped."""
    return F.transform(F.regexp_extract_all(line, F.lit(r'((?:[^ \t"]|"[^"]*"?)+)'), F.lit(1)), lambda w: F.replace(w, F.lit('"'), F.lit("")))
