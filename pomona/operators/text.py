"""Line ends and byte classes of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / F.lit(len(what))).cast("long")


def eol_statistics(text: Column) -> dict[str, Column]:
    """Characters, CR, LF, CRLF and characters beyond ASCII; CR and LF leave out those of a CRLF."""
    crlf = occurrences(text, "\r\n")
    return {
        "chars": F.length(text).cast("long"),
        "cr": occurrences(text, "\r") - crlf,
        "lf": occurrences(text, "\n") - crlf,
        "crlf": crlf,
        "high": F.length(F.regexp_replace(text, "[\\x00-\\x7F]", "")).cast("long"),
    }


def byte_text(text: Column) -> Column:
    """The text's UTF-8 bytes with one character a byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


#: Bytes that mark a binary file (controls but backspace, tab, line feed, form feed and return; delete; 80-9F).
BINARY = "[\\x00-\\x07\\x0B\\x0E-\\x1F\\x7F\\x80-\\x9F]"
LEAST_TEXT = 40


def text_kind(text: Column) -> Column:
    """off for short or binary texts, else the line ends: lf, cr, crlf or unknown. `text` holds one character a byte."""
    n = F.length(text)
    binary = n - F.length(F.regexp_replace(text, BINARY, ""))
    lf, cr = occurrences(text, "\n"), occurrences(text, "\r")
    allowed = F.when(n < 100, 1).otherwise(F.floor(n / 100))
    ends = F.when((lf > 0) & (cr == 0), "lf").when((lf == 0) & (cr > 0), "cr").when((lf > 0) & (lf == cr), "crlf").otherwise("unknown")
    return F.when((n < LEAST_TEXT) | (binary > allowed), "off").otherwise(ends)


def high_ascii(text: Column) -> Column:
    """Every byte has its top bit set, or is a blank or zero. `text` holds one character a byte."""
    return text.rlike("^[\\x80-\\xFF \\x00]*$")


def to_crlf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|\r|\n", "\r\n")


ENDS = {"crlf": "\r\n", "lf": "\n", "cr": "\r"}


def without_high_bits(text: Column) -> Column:
    """Every byte's top bit cleared. `text` holds one character a byte."""
    return F.translate(text, "".join(map(chr, range(128, 256))), "".join(map(chr, range(128))))


def converted(text: Column, ends: str = "crlf", mode: str = "on", high: str = "off", strip_nulls: bool = False) -> Column:
    """A file's bytes (one character each) with other line ends, and without high bits or zeros if asked for.

    mode: on, off, or auto, which converts what looks like text and hasn't CRLF line ends already. high: on, off, or auto,
    which clears the top bits of what has them in every byte. Without a conversion of line ends nothing else is done.
    """
    if mode not in ("on", "off", "auto") or high not in ("on", "off", "auto") or ends not in ENDS:
        raise ValueError("no such conversion")
    if mode == "off":
        return text
    plain = {"off": text, "on": without_high_bits(text), "auto": F.when(high_ascii(text), without_high_bits(text)).otherwise(text)}[high]
    out = F.regexp_replace(plain, "\r\n|\r|\n", ENDS[ends])
    if strip_nulls:
        out = F.replace(out, F.lit("\0"), F.lit(""))
    if mode == "on":
        return out
    kind = text_kind(plain)  # what has its top bits set is text once they are cleared
    return F.when((kind == "off") | (kind == "crlf"), text).otherwise(out)
