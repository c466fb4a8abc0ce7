"""The queries of this folder's operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pomona.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pomona.llm.lm_score import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pomona.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pomona.llm.lang_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pomona.llm.chat import chat_digest, checked_chat

    src = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_digest(checked_chat(src.unionByName(more)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pomona.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pomona.llm.ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pomona.llm.near_dup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pomona.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pomona.llm.packing import pack_texts

    return pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pomona.llm.jpeg import store_text

    return store_text(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_url_filters, op3_toxicity, op4_nearest_neighbours, op5_minhash_near_dedup, op6_byte_bpe, op7_packing, op8_media_columns, op9_language_id, op10_chat_formatting)}
_SAID = r"\### Assistant: </turn> ok"


#: Levels of the tree that the SQL spells out; nothing branches below in the tables it is for.
SQL_LEVELS = 8


def _template_sql() -> str:
    """The template tree of url_filter, level by level."""
    from pomona.llm import url_filter as U

    fits = lambda rule: f"(host = '{rule.split('/')[0]}' or ends_with(host, '.{rule.split('/')[0]}')) and starts_with(path, '/{rule.split('/', 1)[1]}')"
    rules = sorted(U.RULES, key=lambda r: (-len(r[1]), r[1]))
    case = lambda i: "case " + " ".join(f"when {fits(r[1])} then '{r[i]}'" for r in rules) + " end"
    out = [f"""with p as (select page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
q as (select *, {case(1)} as rule, {case(0)} as given, [case when regexp_matches(s, '[0-9]') or length(s) > {U.LONG_SEGMENT} then '*' else s end for s in string_split(path, '/') if s <> ''] as shape from p),
t0 as (select host, shape, [] :: varchar[] as template, '' as node, count(given) as l, count(case when given = 'block' then 1 end) as b from q group by host, shape)"""]
    for n in range(1, SQL_LEVELS + 1):
        out.append(f"""w{n} as (select host, node from t{n - 1} where len(shape) >= {n} group by all having count(distinct shape[{n}]) > {U.MAX_CHILDREN}),
c{n} as (select t.*, case when len(shape) >= {n} then case when w.host is not null then '*' else shape[{n}] end end as child from t{n - 1} t left join w{n} w on t.host = w.host and t.node = w.node),
k{n} as (select host, node, child, cast(sum(l) as double) as l, cast(sum(b) as double) as b from c{n} where child is not null group by all having sum(l) > 0),
g{n} as (select *, lag(l) over w as l0, lag(b) over w as b0 from k{n} window w as (partition by host, node order by b / l, child)),
m{n} as (select host, node, child, sum(case when abs(b / l - b0 / l0) > {U.Z} * greatest(sqrt((b + b0) / (l + l0) * (1 - (b + b0) / (l + l0)) * (1 / l + 1 / l0)), 1e-9) then 1 else 0 end) over (partition by host, node order by b / l, child) as branch from g{n}),
t{n} as (select c.host, c.shape, case when c.child is null then template else template || [c.child] end as template, c.node || '/' || coalesce('#' || branch, '=' || c.child, '.') as node, c.l, c.b
  from c{n} c left join m{n} m on c.host = m.host and c.node = m.node and c.child = m.child)""")
    out.append(f"""judged as (select host, shape, template || shape[{SQL_LEVELS + 1}:] as template, (sum(l) over g - sum(b) over g + {U.WEIGHT * U.PRIOR}) / (sum(l) over g + {U.WEIGHT}) as purity
  from t{SQL_LEVELS} window g as (partition by host, node, shape[{SQL_LEVELS + 1}:]))
select page_id, q.host, path, rule, coalesce(given, case when purity < {U.THRESHOLD} then 'block' else 'allow' end) as verdict, '/' || array_to_string(template, '/') as template, cast(purity as double) as purity
from q join judged j on j.host = q.host and j.shape = q.shape""")
    return ",\n".join(out)


ORACLES: dict[str, str] = {
    "op2_url_filters": _template_sql(),
    # Roles keep their length in the template; a turn is "### ", its role, ": ", the escaped text and " </turn>" with a line feed.
    "op10_chat_formatting": rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{_SAID}' union all select -7, 1, 'assistant', '{_SAID}'),
e as (select *, regexp_replace(text, '(\\*)(#{{3,}}|</turn>)', '\\\1\2', 'g') as body, role || chr(10) || text || chr(10) as line from c),
g as (select conv_id, count(*) as n_turns, string_agg(line, '' order by turn nulls first, role, text) as seq,
  coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
  sum(15 + length(role) + length(body)) as chars from e group by conv_id)
select conv_id, n_turns, sha256(seq) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from g""",
}
