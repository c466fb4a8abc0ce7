"""File types: names, descriptions, how lists show them, and extensions both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pomona.operators import display, names

#: The names of ProDOS file types from a code on; codes without a name show as $ and two digits.
NAMES = {
    0x00: "NON BAD PCD PTX TXT PDA BIN FNT FOT BA3 DA3 WPF SOS",
    0x0F: "DIR RPD RPI AFD AFM AFR SCL PFS",
    0x19: "ADB AWP ASP",
    0x20: "TDM",
    0x2A: "8SC 8OB 8IC 8LD P8C",
    0x40: "DIC OCR FTD",
    0x50: "GWP GSS GDB DRW GDP HMD EDU STN HLP COM CFG ANM MUM ENT DVU FIN",
    0x6B: "BIO",
    0x6D: "TDR PRE HDV",
    0xA0: "WP_",
    0xAB: "GSB TDF BDF",
    0xB0: "SRC OBJ LIB S16 RTL EXE PIF TIF NDA CDA TOL DVR LDF FST",
    0xBF: "DOC PNT PIC ANI PAL",
    0xC5: "OOG SCR CDV FON FND ICN",
    0xD5: "MUS INS MDI SND",
    0xDB: "DBM",
    0xDD: "DDD",
    0xE0: "LBR",
    0xE2: "ATK",
    0xEE: "R16 PAS CMD",
    0xF9: "OS_ INT IVR BAS VAR REL SYS",
}
#: Extensions with the type and aux type that a file of theirs gets.
EXTENSIONS = {
    "ASM": (0xB0, 0x0003), "C": (0xB0, 0x000A), "H": (0xB0, 0x000A), "CPP": (0xB0, 0x0000), "BNY": (0xE0, 0x8000), "BQY": (0xE0, 0x8000), "BXY": (0xE0, 0x8000), "BSE": (0xE0, 0x8000),
    "SEA": (0xB3, 0xDB07), "TEXT": (0x04, 0x0000), "GIF": (0xC0, 0x8006), "JPG": (0x06, 0x0000), "JPEG": (0x06, 0x0000), "SHK": (0xE0, 0x8002),
}
#: Descriptions of types, with ranges of aux types; of several that fit, the last counts.
DESCRIPTIONS = (
    (0x00, 0x0000, 0xFFFF, "Untyped file"),
    (0x01, 0x0000, 0xFFFF, "Bad blocks"),
    (0x04, 0x0000, 0xFFFF, "ASCII text"),
    (0x06, 0x0000, 0xFFFF, "Binary"),
    (0x0F, 0x0000, 0xFFFF, "Directory"),
    (0x19, 0x0000, 0xFFFF, "AppleWorks data base"),
    (0x1A, 0x0000, 0xFFFF, "AppleWorks word processor"),
    (0x1B, 0x0000, 0xFFFF, "AppleWorks spreadsheet"),
    (0x50, 0x0000, 0xFFFF, "GS word processing"),
    (0x50, 0x5445, 0x5445, "Teach document"),
    (0x50, 0x8010, 0x8010, "AppleWorks GS word processor"),
    (0xB0, 0x0000, 0xFFFF, "Source code"),
    (0xB0, 0x0003, 0x0003, "APW 65816 Assembly source code"),
    (0xB0, 0x000A, 0x000A, "APW C source code"),
    (0xB1, 0x0000, 0xFFFF, "Object code"),
    (0xB2, 0x0000, 0xFFFF, "Library"),
    (0xB3, 0x0000, 0xFFFF, "GS/OS application"),
    (0xB3, 0xDB07, 0xDB07, "GSHK self-extracting archive"),
    (0xC0, 0x0000, 0xFFFF, "Packed super hi-res image"),
    (0xC0, 0x0000, 0x0000, "Paintworks packed super hi-res"),
    (0xC0, 0x0001, 0x0001, "Packed super hi-res"),
    (0xC0, 0x0002, 0x0002, "Super hi-res (Apple Preferred Format)"),
    (0xC0, 0x8005, 0x8005, "DreamGrafix document"),
    (0xC0, 0x8006, 0x8006, "GIF document"),
    (0xC1, 0x0000, 0xFFFF, "Super hi-res image"),
    (0xC1, 0x0000, 0x0000, "Super hi-res screen image"),
    (0xC1, 0x0002, 0x0002, "Super hi-res 3200 color screen image"),
    (0xE0, 0x0000, 0xFFFF, "Telecom library file"),
    (0xE0, 0x8000, 0x8000, "Binary II archive"),
    (0xE0, 0x8002, 0x8002, "ShrinkIt archive"),
    (0xFA, 0x0000, 0xFFFF, "Integer BASIC program"),
    (0xFB, 0x0000, 0xFFFF, "Integer BASIC variables"),
    (0xFC, 0x0000, 0xFFFF, "AppleSoft BASIC program"),
    (0xFD, 0x0000, 0xFFFF, "AppleSoft BASIC variables"),
    (0xFE, 0x0000, 0xFFFF, "Relocatable code"),
    (0xFF, 0x0000, 0xFFFF, "ProDOS 8 application"),
)
#: An extension is shorter than this.
LONGEST = 5


def name_table() -> dict[int, str]:
    """The names by code, without those of codes that have none."""
    return {first + i: n.replace("_", " ") for first, run in NAMES.items() for i, n in enumerate(run.split(" "))}


def type_name(code: Column) -> Column:
    """Three letters of a file type; ``???`` beyond one byte, null for null."""
    table = name_table()
    every = F.array(*(F.lit(table.get(i, f"${i:02X}")) for i in range(256)))
    return F.when((code >= 0) & (code < 256), F.element_at(every, code.cast("int") + 1)).when(code.isNotNull(), "???")


def type_description(code: Column, aux: Column, table: tuple = DESCRIPTIONS) -> Column:
    """The last description whose range holds the aux type, else null. For long tables, see integrity.last_range_match."""
    out = F.lit(None).cast("string")
    for kind, lo, hi, text in table:
        out = F.when((code == kind) & aux.between(lo, hi), text).otherwise(out)
    return out


def type_shown(kind: Column, code: Column, record_kind: Column, aux: Column) -> Column:
    """A list's type column: a name, or four letters of a Mac file's type, with + for forked files; what disks, volumes and folders are.

    kind: the entry's file system; folders of file systems without types show as DIR.
    """
    plus = F.when(record_kind == "forked", "+").otherwise("")
    mac = (code > 0xFF) | (aux > 0xFFFF)
    plain = F.concat(F.when(mac, display.mac_type(code)).otherwise(type_name(code)), plus)
    return F.when(record_kind == "disk", "Disk").when(record_kind == "volume", "Vol").when((record_kind == "directory") & ~kind.eqNullSafe("ProDOS"), "DIR").otherwise(plain)


def extracted_extension(local: Column, code: Column, fork: Column, sep: str = "/", added: Column | None = None) -> Column:
    """The extension, with its dot, that an extracted file gets; empty if none is to be added.

    Texts always are TXT and disk images PO; any other file keeps its extension, or gets its type's name. One that is
    there already, is too long, only digits, or holds a # is not added. `added`: an extension that a converter has
    appended, after which the wanted one is added even if the name had it.
    """
    own = F.substring(names.extension(local, sep), 2, 1000)
    by_type = F.when((code != 0) & ~type_name(code).rlike(r"^[$?]"), type_name(code))
    wanted = F.when(code == 4, "TXT").when(fork == "disk", "PO").when(own != "", own).otherwise(by_type)
    there = (own != "") & (F.upper(own) == F.upper(wanted))
    if added is not None:
        there &= added == ""
    bad = (F.length(wanted) >= LONGEST) | wanted.rlike("^[0-9]*$") | wanted.contains("#")
    return F.when(wanted.isNull() | there | bad, "").otherwise(F.concat(F.lit("."), wanted))


def type_of_extension(path: Column, sep: str = "/") -> Column:
    """Struct (file_type, aux_type) that a name's extension says, or nulls: known ones first, then a type's name, which is three letters."""
    known = {name: (code, 0) for code, name in name_table().items()} | EXTENSIONS
    table = F.create_map(*(F.lit(x) for name, (code, aux) in known.items() for x in (name, code << 16 | aux)))
    both = F.try_element_at(table, F.upper(F.substring(names.extension(path, sep), 2, 1000)))
    return F.struct(F.shiftright(both, 16).alias("file_type"), both.bitwiseAND(0xFFFF).alias("aux_type"))


def archive_name(local: Column, preserved: bool = True, extended: bool = False, junk: bool = False) -> Column:
    """Struct (path, file_type, aux_type, fork) of a local path that is added to an archive.

    Separators of both kinds become ``/``. A preservation tag gives type and fork and is cut off, and percent codes become
    their characters again; without a tag, `extended` takes the type from the extension. Leading ``./``, ``../``, slashes
    and drive letters go; junk drops all directories.
    """
    path = F.translate(local, "\\", "/")
    tag = names.read_tag(path)
    tagged = tag["file_type"].isNotNull() if preserved else F.lit(False)
    base = F.when(tagged, percent_decoded(tag["base"])).otherwise(path) if preserved else path
    base = F.regexp_replace(base, r"^([A-Za-z]:)?/*((\.{1,2})/+)*", "")
    if junk:
        base = F.substring_index(base, "/", -1)
    by_name = type_of_extension(base) if extended else F.struct(F.lit(None).cast("int").alias("file_type"), F.lit(None).cast("int").alias("aux_type"))
    pick = lambda f: F.coalesce(F.when(tagged, tag[f]), by_name[f].cast("long"), F.lit(0).cast("long"))
    return F.struct(base.alias("path"), pick("file_type").alias("file_type"), pick("aux_type").alias("aux_type"), F.when(tagged, tag["fork"]).otherwise("data").alias("fork"))


def percent_decoded(text: Column) -> Column:
    """Percent codes of printable characters as these, ``%%`` as a percent sign, and a leading ``%00`` as nothing."""
    plain = F.regexp_replace(text, r"(^|/)%00", "$1")
    tokens = F.regexp_extract_all(plain, F.lit("(?s)(%%|%[2-7][0-9A-Fa-f]|.)"), F.lit(1))
    code = lambda t: F.conv(F.substring(t, 2, 2), 16, 10).cast("int")
    one = lambda t: F.when(t == "%%", "%").when((F.length(t) == 3) & (code(t) < 0x7F), F.chr(code(t))).otherwise(t)
    return F.array_join(F.transform(tokens, one), "")


def described(entries: DataFrame) -> DataFrame:
    """Entries with `type_name` and `type_description`."""
    return entries.withColumn("type_name", type_name(F.col("file_type"))).withColumn("type_description", type_description(F.col("file_type"), F.col("aux_type")))
