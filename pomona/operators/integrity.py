"""Space accounting, integrity checks and keyed merges, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("never", "always", "maybe", "must")


def usage_check(used: DataFrame, marked: DataFrame, chunk: str) -> DataFrame:
    """chunk, state: ``X`` used and marked, ``!`` used but free in the bitmap, ``?`` marked but unused, ``#`` used twice."""
    u = used.groupBy(chunk).agg(F.count(F.lit(1)).alias("users"))
    m = marked.select(chunk).distinct().withColumn("marked", F.lit(True))
    j = u.join(m, chunk, "full_outer")
    state = F.when(F.col("users") > 1, "#").when(F.col("users").isNull(), "?").when(F.col("marked").isNull(), "!").otherwise("X")
    return j.select(chunk, state.alias("state"))


def usage_summary(states: DataFrame) -> DataFrame:
    return states.agg(*(F.count_if(F.col("state") == s).alias(n) for s, n in (("X", "good"), ("!", "unmarked"), ("?", "unused"), ("#", "conflicts"))))


def conflicts(uses: DataFrame, chunk: str, user: str, purpose: str) -> DataFrame:
    """chunk, users, purpose: what the only user says, or ``conflict``."""
    return uses.groupBy(chunk).agg(F.countDistinct(user).alias("users"), F.when(F.countDistinct(user) > 1, "conflict").otherwise(F.min(purpose)).alias("purpose"))


def usage_map(states: DataFrame, chunk: str, width: int = 32) -> DataFrame:
    """line, map: one letter for each chunk, `width` to a line; a line is bounded by its width."""
    s = states.withColumn("line", F.floor(F.col(chunk) / width))
    letters = F.array_sort(F.collect_list(F.struct(chunk, "state")))
    return s.groupBy("line").agg(F.array_join(F.transform(letters, lambda x: x["state"]), "").alias("map"))


#: Letters of what a chunk that is used and marked serves for.
PURPOSES = {"system": "S", "volume directory": "V", "directory": "D", "data": "F", "structure": "I", "embedded": "E", "conflict": "#"}


def chunk_letter(users: Column, marked: Column, purpose: Column) -> Column:
    """One letter for a chunk's state: . free, X marked only, ! used only, # used twice, else its purpose or ?."""
    used, m = F.coalesce(users, F.lit(0)) > 0, F.coalesce(marked, F.lit(False))
    of = F.lit("?")
    for p, letter in PURPOSES.items():
        of = F.when(purpose == p, letter).otherwise(of)
    return F.when(~used & ~m, ".").when(~used, "X").when(~m, "!").when(users > 1, "#").otherwise(of)


def chunk_map(chunks: DataFrame, volume: str, chunk: str, letter: str, width: int = 32) -> DataFrame:
    """volume, line, map: a volume's letters in lines of a fixed width, - where no chunk stands."""
    c = chunks.select(volume, F.floor(F.col(chunk) / width).alias("line"), F.pmod(F.col(chunk), F.lit(width)).cast("int").alias("at"), F.col(letter).alias("letter"))
    letters = F.map_from_entries(F.collect_list(F.struct("at", "letter")))  # at most `width` entries
    place = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("letters", i), F.lit("-")))
    return c.groupBy(volume, "line").agg(letters.alias("letters")).select(volume, "line", F.array_join(place, "").alias("map"))


def largest_gaps(extents: DataFrame, volume: str, start: str, stop: str) -> DataFrame:
    """volume, after, gap: the largest free run between consecutive extents; the first of equals."""
    w = Window.partitionBy(volume).orderBy(start, stop)
    g = extents.withColumn("gap", F.lead(start).over(w) - F.col(stop)).where(F.col("gap").isNotNull())
    best = F.max(F.struct(F.col("gap"), (-F.col(start)).alias("at"))).alias("x")
    return g.groupBy(volume).agg(best).select(volume, (-F.col("x.at")).alias("after"), F.col("x.gap").alias("gap"))


def extent_overlaps(extents: DataFrame, volume: str, start: str, stop: str, total: str | None = None) -> DataFrame:
    """Extents [start, stop) with `overlaps`, where an earlier one of the volume reaches into them, and `outside`, where they are empty, backward or leave the volume.

    Volumes without a bitmap can be checked no further.
    """
    before = Window.partitionBy(volume).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    bad = F.col(stop) <= F.col(start)
    if total is not None:
        bad |= (F.col(stop) > F.col(total)) | (F.col(start) < 0)
    return extents.withColumn("overlaps", F.coalesce(F.max(stop).over(before) > F.col(start), F.lit(False))).withColumn("outside", bad)


def longest_runs(rows: DataFrame, group: str, order: str, same: str) -> DataFrame:
    """group, value, length: the longest run of equal values in order; the first value of equals."""
    w = Window.partitionBy(group).orderBy(order)
    r = rows.withColumn("__n", F.row_number().over(w)).withColumn("__k", F.row_number().over(Window.partitionBy(group, same).orderBy(order)))
    runs = r.groupBy(group, same, (F.col("__n") - F.col("__k")).alias("__run")).agg(F.count(F.lit(1)).alias("length"), F.min("__n").alias("__first"))
    best = F.max(F.struct(F.col("length"), (-F.col("__first")).alias("at"), F.col(same).alias("value"))).alias("x")
    return runs.groupBy(group).agg(best).select(group, F.col("x.value").alias("value"), F.col("x.length").alias("length"))


def upsert_actions(existing: DataFrame, incoming: DataFrame, key: str, when: str, policy: str, only_newer: bool = False) -> DataFrame:
    """key, action: keep, add, replace, skip, ask or error, for a merge of incoming rows into existing ones.

    only_newer: an incoming row that isn't newer is skipped whatever the policy; equal dates aren't newer.
    policy: never replaces nothing, always everything, maybe asks, must takes rows without a counterpart as errors.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    a, b = existing.select(key, F.col(when).alias("__old"), F.lit(True).alias("__a")), incoming.select(key, F.col(when).alias("__new"), F.lit(True).alias("__b"))
    j = a.join(b, key, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    stale = F.lit(only_newer) & ~F.coalesce(F.col("__old") < F.col("__new"), F.lit(False))
    clash = {"never": "skip", "always": "replace", "maybe": "ask", "must": "replace"}[policy]
    action = F.when(F.col("__b").isNull(), "keep").when(both & stale, "skip").when(both, clash).otherwise("error" if policy == "must" else "add")
    return j.select(key, action.alias("action"))


def last_range_match(rows: DataFrame, table: DataFrame, kind: str, value: str, lo: str, hi: str, position: str, text: str) -> DataFrame:
    """Rows with `text` of the last table row of the same kind whose range holds the value. Catalyst broadcasts the table if it is small."""
    j = rows.join(table.withColumnRenamed(kind, "__kind"), (F.col(kind) == F.col("__kind")) & F.col(value).between(F.col(lo), F.col(hi)), "left")
    return j.groupBy(*rows.columns).agg(F.max(F.struct(position, text)).alias("__x")).select(*rows.columns, F.col(f"__x.{text}").alias(text))


def best_choice(scores: DataFrame, item: str) -> DataFrame:
    """item, converter: the highest (level, preferred); ties keep the lowest converter id."""
    best = F.max(F.struct("level", "preferred", (-F.col("converter")).alias("__c"))).alias("x")
    return scores.where("level > 0").groupBy(item).agg(best).select(item, (-F.col("x.__c")).alias("converter"), F.col("x.level").alias("level"))
