r"""URL filters by a path-template tree per host, in DataFrame functions.

1. Every url is cut into host and path segments; urls that a rule covers are the labelled ones
   (allow or block).
2. Segments that vary by their shape (they hold a digit, or are long) become ``*``. Then each host's tree
   is walked from the root, one branching node of every path at a time: a node with more than
   ``max_children`` different children has all of them generalised into one ``*``;
3. labelled children whose blocked shares don't differ significantly (two-proportion z test) are merged, in
   order of that share, into one branch, whose children are pooled below. A branch without labels
   has no evidence of being like another and stays on its own.
4. A template is rejected if the purity of its merged leaf, the share of allowed labels smoothed towards
   ``prior`` with weight ``weight``, is below ``threshold``. Unlabelled templates keep the prior and are allowed.

Counts are summed per (host, generalised path) before anything is shuffled, so a hot host costs one
row per template. Runs of segments without a branch are passed in one step, so there are as many
rounds as a path has branching nodes, whatever its length. Windows run over the children of one node,
at most ``max_children`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pomona.llm.common import shared_checkpoint

#: (verdict, host and path prefix)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_CHILDREN, LONG_SEGMENT = 24, 24
PRIOR, WEIGHT, THRESHOLD, Z = 0.8, 4.0, 0.5, 1.96
#: Rules are inlined as one expression; they are configuration, not data.
MOST_RULES = 500


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Equal lengths: the first by text."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; give them as a table to join instead")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, _, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """The path's segments with varying ones as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > LONG_SEGMENT), F.lit("*")).otherwise(s))


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays share from their beginnings."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _tail(c: str, start: Column) -> Column:
    return F.slice(F.col(c), start, F.greatest(F.size(c) - start + 1, F.lit(0)))


def _classes(kids: DataFrame) -> DataFrame:
    """(host, node, child, l, b) -> class: the branch that a child belongs to."""
    share = F.col("b") / F.col("l")
    w = Window.partitionBy("host", "node").orderBy("share", "child")
    n0, b0 = F.lag("l").over(w), F.lag("b").over(w)
    pooled = (F.col("b") + b0) / (F.col("l") + n0)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / n0))
    differs = F.abs(F.col("share") - b0 / n0) > Z * F.greatest(spread, F.lit(1e-9))
    known = kids.where("l > 0").withColumn("share", share).withColumn("new", F.coalesce(differs, F.lit(False)).cast("int"))
    return known.withColumn("class", F.concat(F.lit("#"), F.sum("new").over(w).cast("string"))).select("host", "node", "child", "class")


def template_tree(labelled: DataFrame, max_children: int = MAX_CHILDREN) -> DataFrame:
    """(host, shape) -> template, purity, rejected. `labelled` has host, shape, blocked (1, 0 or null)."""
    t = labelled.groupBy("host", "shape").agg(F.count("blocked").alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"))
    # rest: the segments below the node; template: those above, generalised; node: the merged branches above
    t = shared_checkpoint(t.select("host", "shape", "l", "b", F.col("shape").alias("rest"), F.array().cast("array<string>").alias("template"), F.lit("").alias("node")))
    columns, leaves = t.columns, []
    while True:
        group = ["host", "node"]
        g = t.groupBy(*group).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        g = g.select(*group, _common(F.col("lo"), F.col("hi")).alias("k"), (F.col("lo") == F.col("hi")).alias("alone"))
        # down the run of segments that all below the node share; rows that are alone or end there are leaves
        run = F.slice("rest", F.lit(1), F.col("k"))
        x = t.join(g, group).withColumn("template", F.concat("template", run)).withColumn("node", F.concat("node", F.lit("/"), F.array_join(run, "/"))).withColumn("rest", _tail("rest", F.col("k") + 1))
        x = shared_checkpoint(x.withColumn("leaf", F.col("alone") | (F.size("rest") == 0)).select(*columns, "leaf"))
        leaves.append(x.where("leaf").withColumn("node", F.concat("node", F.lit("/."))))
        t = x.where("not leaf").withColumn("child", F.element_at("rest", 1))
        if t.isEmpty():
            break
        wide = t.groupBy(*group, "child").agg(F.lit(1)).groupBy(*group).agg(F.count(F.lit(1)).alias("children")).where(F.col("children") > max_children)
        t = t.join(wide, group, "left").withColumn("child", F.when(F.col("children").isNotNull(), F.lit("*")).otherwise(F.col("child")))
        kids = t.groupBy(*group, "child").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
        t = t.join(_classes(kids), [*group, "child"], "left")
        t = t.withColumn("template", F.concat("template", F.array("child"))).withColumn("rest", _tail("rest", F.lit(2)))
        t = t.withColumn("node", F.concat("node", F.lit("//"), F.coalesce("class", "child"))).select(*columns)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.union(x)
    merged = out.groupBy("host", "node").agg(F.sum("l").alias("n_labelled"), F.sum("b").alias("n_blocked"))
    purity = (F.col("n_labelled") - F.col("n_blocked") + WEIGHT * PRIOR) / (F.col("n_labelled") + WEIGHT)
    judged = out.join(merged, ["host", "node"]).select("host", "shape", "template", purity.alias("purity"))
    return judged.withColumn("rejected", F.col("purity") < THRESHOLD)


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, template, purity.

    Defined cases: a null url, or one without ``://``, has empty host and path, no rule, and the
    template of the empty host; null keys and repeated rows are kept as they are; an empty table gives
    an empty result; other columns are ignored; a path of any length is read whole, at any depth.
    """
    p = pages.select(F.col(key).alias("page_key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    p = p.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("path")))
    blocked = (F.col("fit.verdict") == "block").cast("int")
    tree = template_tree(p.select("host", "shape", blocked.alias("blocked")))
    out = p.join(tree, ["host", "shape"], "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("page_key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
