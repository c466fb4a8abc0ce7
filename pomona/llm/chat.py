"""Chat formatting by a grammar round trip, in DataFrame functions alone.

Template: each turn is one record ``### Role: text </turn>`` and a line feed. ``###`` runs (three or
more) and ``</turn>`` are control strings. The deterministic parser cuts a rendering at every
unescaped ``</turn>`` record end, takes the role from the record's head, and drops one backslash
from each run of backslashes that stands before a control string. A turn is first rendered as it
is; if the parser doesn't give back the same role and text from that rendering, or finds a control
string that isn't the template's, the text is escaped (one more backslash before each control
string) and parsed again. Both trials happen per row, before turns are gathered; the whole
conversation's rendering is parsed once more and compared with the source turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(\\*)(#{3,}|</turn>)"
ESCAPED = r"\\(\\*)(#{3,}|</turn>)"
BARE = r"(?<!\\)(?:(?<!#)#{3,}|</turn>)"
END = " </turn>\n"
#: Cuts at record ends; a text's own `` </turn>`` always has a backslash once it is escaped.
CUT = r" </turn>\n"
#: Characters of a role that would be taken for the template's own.
ROLE_MARKS = {"%": "%25", ":": "%3A", "\n": "%0A", "\r": "%0D", "#": "%23", "<": "%3C", "\\": "%5C", " ": "%20"}


def _role_in(role: Column) -> Column:
    for raw, coded in reversed(ROLE_MARKS.items()):
        role = F.replace(role, F.lit(coded), F.lit(raw))
    return role


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def _head(role: Column) -> Column:
    return F.concat(F.lit("### "), role, F.lit(": "))


def _parsed_body(record: Column) -> Column:
    """The record's text, still escaped: what follows the first ``: ``."""
    return record.substr(F.locate(": ", record) + 2, F.length(record))


def _parsed_role(record: Column) -> Column:
    return record.substr(F.lit(5), F.locate(": ", record) - 5)


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as one formatted text each, with a run-length loss mask.

    Returns ``conv`` and:
      formatted    the rendering,
      mask         array of (length, loss) runs in characters that cover `formatted` in order;
                   loss marks the assistant's texts,
      source       the source turns (role, text), for comparison,
      n_turns.
    Defined cases: null text is the empty text, null role the empty role; a null conversation id is
    a conversation of its own; turns are ordered by (turn, role, text) with null turns first, so
    ties and repeated rows keep a fixed order and every row stays a turn; an empty table gives an
    empty result; other columns are ignored.
    """
    src = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("tag", _role_shown(F.col("role")))
    # Trial parse of the plain rendering: it must hold no control string of its own and unescape to itself.
    plain_ok = ~F.col("text").rlike(BARE) & (unescape(F.col("text")) == F.col("text"))
    src = src.withColumn("body", F.when(plain_ok, F.col("text")).otherwise(escape(F.col("text"))))
    src = src.withColumn("body", F.when(unescape(F.col("body")) == F.col("text"), F.col("body")).otherwise(F.raise_error(F.lit("a turn does not survive its round trip"))))
    turns = src.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tag", "body"))).alias("turns"), F.count(F.lit(1)).alias("n_turns"))
    # array_sort puts null fields last inside structs; turns without a number come first by this contract
    turns = turns.withColumn("turns", F.concat(F.filter("turns", lambda t: t["turn"].isNull()), F.filter("turns", lambda t: t["turn"].isNotNull())))
    record = lambda t: F.concat(_head(t["tag"]), t["body"], F.lit(END))
    runs = lambda t: F.array(
        F.struct(F.length(_head(t["tag"])).cast("long").alias("length"), F.lit(False).alias("loss")),
        F.struct(F.length(t["body"]).cast("long").alias("length"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.lit(len(END)).cast("long").alias("length"), F.lit(False).alias("loss")),
    )
    return turns.select(
        F.col("conv_id").alias(conv),
        "n_turns",
        F.array_join(F.transform("turns", record), "").alias("formatted"),
        F.flatten(F.transform("turns", runs)).alias("mask"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )


def _role_shown(role: Column) -> Column:
    """The role with its template marks coded; the first letter is shown in upper case if that is reversible."""
    for raw, coded in ROLE_MARKS.items():
        role = F.replace(role, F.lit(raw), F.lit(coded))
    first = F.substring(role, 1, 1)
    shown = F.concat(F.upper(first), role.substr(F.lit(2), F.length(role)))
    # a role that itself starts with an upper-case letter is marked, so that reading back is exact
    return F.when(first.rlike("^[a-z]$"), shown).otherwise(F.concat(F.lit("="), role))


def _role_read(tag: Column) -> Column:
    plain = F.when(tag.startswith("="), tag.substr(F.lit(2), F.length(tag))).otherwise(F.concat(F.lower(F.substring(tag, 1, 1)), tag.substr(F.lit(2), F.length(tag))))
    return _role_in(plain)


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text, body) read back from a rendering; body is the text as it stands there."""
    records = F.filter(F.split(formatted, CUT), lambda r: r != "")
    return F.transform(records, lambda r: F.struct(_role_read(_parsed_role(r)).alias("role"), unescape(_parsed_body(r)).alias("text"), _parsed_body(r).alias("body")))


def checked_chat(df: DataFrame, **names: str) -> DataFrame:
    """format_chat with `turns`, read back from `formatted`; fails if any differs from the source."""
    out = format_chat(df, **names).withColumn("turns", parse_chat(F.col("formatted")))
    same = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.col("source")
    covered = F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["length"]) == F.length("formatted")
    ok = F.when(same & covered, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")))
    return out.withColumn("turns", ok).drop("source")


def chat_digest(df: DataFrame) -> DataFrame:
    """The query's digests, from the turns read back and the loss mask."""
    bodies = F.filter("mask", lambda m, i: i % 3 == 1)
    masked = F.filter(F.zip_with("turns", bodies, lambda t, m: F.struct(t["body"].alias("body"), m["loss"].alias("loss"), m["length"].alias("length"))), lambda x: x["loss"])
    loss = F.array_join(F.transform(masked, lambda x: unescape(F.substring(x["body"], F.lit(1), x["length"].cast("int")))), "")
    seq = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.withColumn("loss_text", loss).select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(seq, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
