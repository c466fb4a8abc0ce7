"""Registered queries of the catalogue, text and integrity operators, with their SQL for comparison.

The driver's tables hold no disk images; each query reads them as the operator's input would be, e.g. urls as
paths with the separator ``/``. Queries named ``envelope_*`` are plain relational ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pomona.operators import dates as D
from pomona.operators import display as S
from pomona.operators import edits as X
from pomona.operators import integrity as I
from pomona.operators import names as N
from pomona.operators import summary as M
from pomona.operators import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_EOLS = r"""
with d as (select doc_id, case doc_id % 3 when 1 then replace(text, chr(10), chr(13)) when 2 then replace(text, chr(10), chr(13) || chr(10)) else text end as t from documents)"""


def _line_ends(t) -> DataFrame:
    """The table's texts have no carriage return, so two thirds of them are given other line ends first."""
    k = F.col("doc_id") % 3
    text = F.when(k == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).when(k == 2, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return t("documents").select("doc_id", text.alias("t"))


@query(_EOLS + r""",
c as (select doc_id, t, cast((length(t) - length(replace(t, chr(13) || chr(10), ''))) // 2 as bigint) as crlf from d)
select doc_id, cast(length(t) as bigint) as chars, cast(length(t) - length(replace(t, chr(13), '')) - crlf as bigint) as cr,
  cast(length(t) - length(replace(t, chr(10), '')) - crlf as bigint) as lf, crlf,
  cast(length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) as bigint) as high from c""")
def eol_statistics(t):
    return _line_ends(t).select("doc_id", *(c.alias(n) for n, c in T.eol_statistics(F.col("t")).items()))


@query(_EOLS + """
select doc_id, cast(length(x) as bigint) as chars, md5(x) as digest from (select doc_id, replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10)) as x from d)""")
def eol_conversion(t):
    d = _line_ends(t).select("doc_id", T.to_crlf(F.col("t")).alias("x"))
    return d.select("doc_id", F.length("x").cast("long").alias("chars"), F.md5("x").alias("digest"))


@query(_EOLS + r""",
h as (select doc_id, coalesce(t, '') as t, regexp_extract_all(hex(encode(coalesce(t, ''))), '..') as h from d),
a as (select doc_id, strlen(t) as n, len(list_filter(h, lambda x: x <= '07' or x = '0B' or x between '0E' and '1F' or x = '7F' or x between '80' and '9F')) as b, length(t) - length(replace(t, chr(10), '')) as lf, length(t) - length(replace(t, chr(13), '')) as cr from h)
select doc_id, case when n < 40 or b > (case when n < 100 then 1 else n // 100 end) then 'off' when lf > 0 and cr = 0 then 'lf' when lf = 0 and cr > 0 then 'cr' when lf > 0 and lf = cr then 'crlf' else 'unknown' end as kind from a""")
def text_detection(t):
    """Every text, by its bytes in UTF-8; null is the empty text."""
    return _line_ends(t).select("doc_id", T.text_kind(T.byte_text(F.coalesce("t", F.lit("")))).alias("kind"))


@query("""select page_id, split_part(u, '/', -1) as name, case when position('.' in split_part(url, '/', -1)) = 0 or split_part(split_part(url, '/', -1), '.', -1) = '' then '' else '.' || split_part(split_part(url, '/', -1), '.', -1) end as extension
from (select page_id, url, case when url like '%/' then left(url, length(url) - 1) else url end as u from pages)""")
def file_name_parts(t):
    return t("pages").select("page_id", N.file_name(F.col("url"), "/").alias("name"), N.extension(F.col("url"), "/").alias("extension"))


@query("""select page_id, contains(lower(url), 'ththe') as part, regexp_matches(lower(url), '(^|/)en(/|$)') as whole from pages where contains(lower(url), 'th')""")
def component_find(t):
    u = F.col("url")
    return t("pages").where(N.finds(u, "TH", "/")).select("page_id", N.finds(u, "thTHe", "/").alias("part"), N.finds(u, "EN", "/", whole=True).alias("whole"))


@query("""with e as (select lower(url) as p, string_split(lower(url), '/') as s from pages where position('/' in url) > 0),
x as (select array_to_string(s[1:n], '/') as directory from (select s, unnest(range(1, greatest(len(s) - 1, 1) + 1)) as n from e))
select directory, count(*) as entries from x group by directory""")
def subtree_counts(t):
    return N.below_count(t("pages"), "url", "/")


@query("""with a as (select page_id, replace(lower(url), '/', chr(1)) as k from pages), b as (select page_id, replace(lower(replace(upper(replace(url, ':', ';')), '/', ':')), ':', chr(1)) as k from pages)
select a.page_id, b.page_id as other_id from a join b on replace(a.k, ':', ';') = b.k""")
def cross_separator_paths(t):
    p = t("pages")
    a = p.select("page_id", N.comparable(F.replace("url", F.lit(":"), F.lit(";")), "/").alias("k"))
    b = p.select(F.col("page_id").alias("other_id"), N.comparable(F.replace(F.upper(F.replace("url", F.lit(":"), F.lit(";"))), F.lit("/"), F.lit(":")), ":").alias("k"))
    return a.join(b, "k").select("page_id", "other_id")


@query("""with c as (select c_custkey, c_nationkey, c_mktsegment as name from customer), n as (select *, row_number() over (partition by c_nationkey, name order by c_custkey) - 1 as n from c)
select c_custkey, case when n = 0 then name else left(name, least(length(name), 15 - length('.' || n))) || '.' || n end as unique_name from n""")
def unique_names(t):
    c = t("customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("name"))
    return N.unique_names(c, "name", "c_nationkey", "c_custkey", 15).select("c_custkey", "unique_name")


_RATIO = """
with s as (select l_orderkey, l_linenumber, case when l_linenumber = 5 then 0 else cast(floor(l_extendedprice) as bigint) end as total,
  case when l_linenumber in (5, 6) then 0 when l_linenumber = 7 then cast(floor(l_extendedprice / 500) as bigint) else cast(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as bigint) end as packed0 from lineitem),
r as (select l_orderkey, l_linenumber, total, case when l_linenumber = 5 and l_orderkey % 2 = 0 then 7 else packed0 end as packed from s)"""


@query(_RATIO + """
select l_orderkey, l_linenumber, case when (total = 0) <> (packed = 0) then '---' when total < packed then '>100%' else p || '%' end as shown,
  cast(case when (total = 0) <> (packed = 0) then -1 when total < packed then 101 else p end as int) as percent
from (select *, case when total = 0 and packed = 0 then 100 when total = 0 then 0 else greatest(packed * 100 // total, 1) end as p from r)""")
def ratio_display(t):
    n, price = F.col("l_linenumber"), F.col("l_extendedprice")
    x = t("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(n == 5, 0).otherwise(F.floor(price)).cast("long").alias("total"),
        F.when((n == 5) & (F.col("l_orderkey") % 2 == 0), 7).when(n.isin(5, 6), 0).when(n == 7, F.floor(price / 500)).otherwise(F.floor(price * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))).cast("long").alias("packed"),
    )
    shown, number = S.ratio(F.col("total"), F.col("packed"))
    return x.select("l_orderkey", "l_linenumber", shown.alias("shown"), number.alias("percent"))


@query("""select p_partkey, """ + " || ".join(f"case when a & {0x80 >> i} <> 0 then '{c}' else '' end" for i, c in enumerate(S.ACCESS_LETTERS)) + """ as access, a in (33, 1) as read_only from (select p_partkey, (p_size * 5) & 255 as a from part)""")
def access_display(t):
    p = t("part").select("p_partkey", (F.col("p_size") * 5).bitwiseAND(255).alias("a"))
    return p.select("p_partkey", S.access(F.col("a")).alias("access"), S.read_only(F.col("a")).alias("read_only"))


@query("""select p_partkey, (case when p_size * 5 % 256 in (33, 1) then '*' else ' ' end) || (case when length(n) <= 32 then rpad(n, 32, ' ') else '..' || right(n, 30) end) || ' ' as listed,
  case when p_size > 45 then (p_partkey * 300 // 1024) || 'k' else '$' || lpad(upper(to_hex(p_size * 257)), 4, '0') end as aux
from (select *, p_name || '/' || p_brand || '/' || p_type || '/' || p_name as n from part)""")
def catalog_projection(t):
    p = t("part").withColumn("n", F.concat_ws("/", "p_name", "p_brand", "p_type", "p_name"))
    size = F.col("p_size")
    return p.select("p_partkey", S.listed_name(F.col("n"), S.read_only((size * 5) % 256)).alias("listed"), S.aux_type(size * 257, size > 45, F.col("p_partkey") * 300).alias("aux"))


@query("""select c_custkey, """ + " || ".join(f"case when (v >> {n}) & 255 between 32 and 126 then chr(cast((v >> {n}) & 255 as int)) else '?' end" for n in (24, 16, 8, 0)) + """ as mac from (select c_custkey, (c_custkey * 2654435) % 4294967296 as v from customer)""")
def mac_type_codes(t):
    c = t("customer").select("c_custkey", ((F.col("c_custkey") * 2654435) % 4294967296).alias("v"))
    return c.select("c_custkey", S.mac_type(F.col("v")).alias("mac"))


@query("""select l_orderkey, l_linenumber from lineitem where not (l_returnflag = 'R' and l_linestatus = 'F') and ((l_linenumber & 3) & (case when l_quantity > 25 then 1 else 2 end)) <> 0""")
def selection_mask(t):
    damaged = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    mask = F.when(F.col("l_quantity") > 25, 1).otherwise(2)
    return t("lineitem").where(~damaged & (F.col("l_linenumber").bitwiseAND(3).bitwiseAND(mask) != 0)).select("l_orderkey", "l_linenumber")


@query("""select p_partkey, row_number() over (order by lower(p_type), p_size, p_partkey) as rank from part""")
def catalog_sort(t):
    """The whole list by type without case, ties by aux type, then by key: a row's rank is its place in its type and size, after all that come before these."""
    p = t("part").select("p_partkey", F.lower("p_type").alias("kind"), "p_size")
    sizes = p.groupBy("kind", "p_size").agg(F.count(F.lit(1)).alias("n"))  # the window without partitions runs over these alone
    before = F.coalesce(F.sum("n").over(Window.orderBy("kind", "p_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("kind").alias("k"), F.col("p_size").alias("s"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("kind", "p_size").orderBy("p_partkey"))
    ranked = p.select("p_partkey", "kind", "p_size", place.alias("place"))
    return ranked.join(starts, F.col("kind").eqNullSafe(F.col("k")) & F.col("p_size").eqNullSafe(F.col("s"))).select("p_partkey", (F.col("before") + F.col("place")).alias("rank"))


@query("""(select 'down' as way, p_partkey from part where contains(lower(p_name), 'e') order by case when p_partkey > 120 then 0 else 1 end, p_partkey limit 1)
union all (select 'up', p_partkey from part where contains(lower(p_name), 'o') order by case when p_partkey < 3 then 0 else 1 end, p_partkey desc limit 1)""")
def find_next(t):
    p = t("part").select("p_partkey", "p_name")
    a = N.find_next(p, "p_partkey", 120, N.finds(F.col("p_name"), "E", "/"))
    b = N.find_next(p, "p_partkey", 3, N.finds(F.col("p_name"), "O", "/"), down=False)
    return a.select(F.lit("down").alias("way"), "p_partkey").unionByName(b.select(F.lit("up").alias("way"), "p_partkey"))


@query("""with c as (select cast(round(l_extendedprice * 100) as bigint) as a, cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint) as b, l_returnflag from lineitem)
select count(*) as entries, cast(sum(a) as bigint) as total, cast(sum(b) as bigint) as packed, cast(sum(a) - sum(b) as bigint) as saved, cast(count_if(l_returnflag = 'R') as bigint) as returned from c""")
def archive_totals(t):
    cents = lambda c: F.round(c * 100).cast("long")
    total, packed = F.sum(cents(F.col("l_extendedprice"))), F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))))
    return t("lineitem").agg(F.count(F.lit(1)).alias("entries"), total.alias("total"), packed.alias("packed"), (total - packed).alias("saved"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query("""select conv_id, count(*) as threads, cast(sum(length(text)) as bigint) as total, coalesce(arg_min(length(text), turn) filter (where role = 'user'), -1) as first_data, coalesce(arg_min(length(text), turn) filter (where role = 'assistant'), -1) as first_rsrc,
  bool_or(role = 'system') as has_comment, arg_max(role, turn) as kind from conversations group by conv_id""")
def record_summary(t):
    c = t("conversations").withColumn("n", F.length("text").cast("long"))
    first = lambda role: F.coalesce(F.min_by("n", F.when(F.col("role") == role, F.col("turn"))), F.lit(-1).cast("long"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("threads"), F.sum("n").alias("total"), first("user").alias("first_data"), first("assistant").alias("first_rsrc"), F.bool_or(F.col("role") == "system").alias("has_comment"), F.max_by("role", "turn").alias("kind"))


@query("""with u as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'user'),
a as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'assistant')
select coalesce(u.conv_id, a.conv_id) as conv_id, coalesce(u.n, a.n) as n, coalesce(u.turn, -1) as data_turn, coalesce(a.turn, -1) as rsrc_turn from u full join a on u.conv_id = a.conv_id and u.n = a.n""")
def fork_pairing(t):
    """The n-th data fork of a name pairs with its n-th resource fork, the first that is free; -1 stands for no fork."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    side = lambda role, name: t("conversations").where(F.col("role") == role).select("conv_id", F.row_number().over(w).cast("long").alias("n"), F.col("turn").alias(name))
    return side("user", "data_turn").join(side("assistant", "rsrc_turn"), ["conv_id", "n"], "full_outer").fillna(-1, ["data_turn", "rsrc_turn"])


_USED = "select l_orderkey as chunk, l_suppkey from lineitem"
_STATES = f"""with u as (select chunk, count(*) as users from ({_USED}) group by chunk), m as (select case when o_custkey % 5 = 0 then o_orderkey + 100000000 else o_orderkey end as chunk from orders where o_custkey % 3 <> 0),
s as (select coalesce(u.chunk, m.chunk) as chunk, case when users > 1 then '#' when users is null then '?' when m.chunk is null then '!' else 'X' end as state from u full join m on u.chunk = m.chunk)"""


def _used(t) -> DataFrame:
    return t("lineitem").select(F.col("l_orderkey").alias("chunk"), "l_suppkey")


def _states(t) -> DataFrame:
    """Orders as chunks that their lines use; the bitmap marks some of them, and some that nothing uses."""
    marked = t("orders").where(F.col("o_custkey") % 3 != 0).select(F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderkey") + 100000000).otherwise(F.col("o_orderkey")).alias("chunk"))
    return I.usage_check(_used(t), marked, "chunk")


@query(_STATES + " select chunk, state from s")
def usage_check(t):
    return _states(t)


@query(_STATES + " select " + ", ".join(f"cast(count_if(state = '{k}') as bigint) as {n}" for k, n in (("X", "good"), ("!", "unmarked"), ("?", "unused"), ("#", "conflicts"))) + " from s")
def usage_summary(t):
    return I.usage_summary(_states(t))


@query(_STATES + " select chunk // 32 as line, string_agg(state, '' order by chunk) as map from s group by 1")
def usage_map(t):
    return I.usage_map(_states(t), "chunk")


@query(f"select chunk, count(distinct l_suppkey) as users, case when count(distinct l_suppkey) > 1 then 'conflict' else cast(min(l_suppkey % 3) as varchar) end as purpose from ({_USED}) group by chunk")
def conflict_marking(t):
    return I.conflicts(_used(t).withColumn("purpose", (F.col("l_suppkey") % 3).cast("string")), "chunk", "l_suppkey", "purpose")


@query("""with g as (select user_id, event_id, lead(event_id) over (partition by user_id order by event_id) - (event_id + 1) as gap from events)
select user_id, max(gap) as gap, cast(arg_max(event_id + 1, struct_pack(a := gap, b := -event_id)) as bigint) as after from g where gap is not null group by user_id""")
def largest_gaps(t):
    e = t("events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("stop"))
    return I.largest_gaps(e, "user_id", "start", "stop").select("user_id", "gap", (F.col("after") + 1).alias("after"))


@query("""with a as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as n, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events),
r as (select user_id, event_type, count(*) as length, min(n) as first from a group by user_id, event_type, n - k)
select user_id, arg_max(event_type, struct_pack(a := length, b := -first)) as value, max(length) as length from r group by user_id""")
def longest_runs(t):
    e = t("events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return I.longest_runs(e, "user_id", "at", "event_type")


def _upsert(policy: str, newer: bool) -> tuple[str, Callable]:
    clash = {"never": "skip", "always": "replace", "maybe": "ask", "must": "replace"}[policy]
    sql = f"""with a as (select o_orderkey, o_orderdate from orders where o_orderkey % 3 <> 0), b as (select o_orderkey, o_orderdate + interval 1 day * (o_custkey % 3 - 1) as d from orders where o_orderkey % 2 = 0)
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'keep' when a.o_orderkey is null then '{"error" if policy == "must" else "add"}'
  {"when not (a.o_orderdate < b.d) then 'skip'" if newer else ""} else '{clash}' end as action from a full join b on a.o_orderkey = b.o_orderkey"""

    def run(t):
        o = t("orders")
        a = o.where(F.col("o_orderkey") % 3 != 0).select("o_orderkey", F.col("o_orderdate").alias("d"))
        b = o.where(F.col("o_orderkey") % 2 == 0).select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval((F.col("o_custkey") % 3 - 1).cast("int"))).alias("d"))
        return I.upsert_actions(a, b, "o_orderkey", "d", policy, newer)

    run.__name__ = f"upsert_{policy}" + "_newer" * newer
    return sql, run


for _p in I.POLICIES:
    for _n in (False, True):
        _sql, _f = _upsert(_p, _n)
        query(_sql)(_f)


@query("""select n_nationkey, coalesce(r_name, '$' || upper(to_hex(n_regionkey))) as kind from nation left join (select * from region where r_regionkey < 3) on r_regionkey = n_regionkey""")
def type_lookup(t):
    """A code's name from a dimension table, or the code itself in hex."""
    r = t("region").where(F.col("r_regionkey") < 3)
    return t("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce("r_name", F.concat(F.lit("$"), F.hex("n_regionkey"))).alias("kind"))


@query("""with t as (select * from (values (0, 0, 50, 0, 'any'), (1, 10, 30, 1, 'middle'), (1, 20, 40, 2, 'late'), (2, 0, 9, 3, 'low'), (2, 5, 9, 4, 'lower')) as x(kind, lo, hi, pos, descr))
select p_partkey, arg_max(descr, pos) as descr from (select p_partkey, cast(p_partkey % 3 as int) as kind, p_size from part) p left join t on p.kind = t.kind and p_size between lo and hi group by p_partkey""")
def type_description(t):
    """Of the ranges that hold the aux type the last one counts."""
    p = t("part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("kind"), "p_size")
    table = p.sparkSession.createDataFrame([(0, 0, 50, 0, "any"), (1, 10, 30, 1, "middle"), (1, 20, 40, 2, "late"), (2, 0, 9, 3, "low"), (2, 5, 9, 4, "lower")], "kind int, lo int, hi int, pos int, descr string")
    return I.last_range_match(p, table, "kind", "p_size", "lo", "hi", "pos", "descr").select("p_partkey", "descr")


@query("""with p as (select o_orderkey, o_orderdate, cast((year(o_orderdate) % 100) * 512 + month(o_orderdate) * 32 + day(o_orderdate) as int) as date_bits, cast(hour(o_orderdate) * 256 + minute(o_orderdate) as int) as time_bits from orders)
select o_orderkey, date_bits, time_bits, strftime(date_trunc('minute', o_orderdate), '%d-%b-%y %H:%M') as shown,
  cast(case when date_bits // 512 < 40 then 2000 else 1900 end + date_bits // 512 as int) as year_back from p""")
def prodos_dates(t):
    d, m = D.pack_prodos(F.col("o_orderdate"))
    p = t("orders").select("o_orderkey", d.alias("date_bits"), m.alias("time_bits"))
    back = D.unpack_prodos(F.col("date_bits"), F.col("time_bits"))
    return p.select("o_orderkey", "date_bits", "time_bits", S.short_date(back).alias("shown"), F.year(back).alias("year_back"))


@query("""select event_id, case when event_id % 7 = 0 then '[No Date]' when event_id % 11 = 0 then '<invalid>' else strftime(ts, '%d-%b-%y %H:%M') end as shown from events""")
def date_display(t):
    e = F.col("event_id")
    return t("events").select("event_id", S.short_date(F.col("ts"), e % 7 == 0, e % 11 == 0).alias("shown"))


@query("""select c_custkey, '"' || replace(n, '"', '""') || '","' || replace(c_mktsegment, '"', '""') || '"' as line from (select *, replace(c_name, '#', '"') as n from customer)""")
def csv_quoting(t):
    return t("customer").select("c_custkey", F.concat_ws(",", S.csv_cell(F.replace("c_name", F.lit("#"), F.lit('"'))), S.csv_cell(F.col("c_mktsegment"))).alias("line"))


@query("""with s as (select doc_id, converter, level, preferred from (select doc_id, 1 as converter, case when lang = 'en' then 5 else 2 end as level, 0 as preferred from documents
union all select doc_id, 2, cast(doc_id % 6 as int), cast(doc_id % 2 as int) from documents union all select doc_id, 3, case when source = 'src0' then 5 else 0 end, 1 from documents))
select doc_id, -arg_max(-converter, struct_pack(a := level, b := preferred, c := -converter)) as converter, max(level) as level from s where level > 0 group by doc_id""")
def converter_choice(t):
    d = t("documents").select("doc_id", "lang", "source")
    of = lambda n, level, preferred: d.select("doc_id", F.lit(n).alias("converter"), level.cast("int").alias("level"), preferred.cast("int").alias("preferred"))
    s = of(1, F.when(F.col("lang") == "en", 5).otherwise(2), F.lit(0)).union(of(2, F.col("doc_id") % 6, F.col("doc_id") % 2)).union(of(3, F.when(F.col("source") == "src0", 5).otherwise(0), F.lit(1)))
    return I.best_choice(s, "doc_id")


@query("""with p as (select p_partkey, p_size * 7 as k, case when p_partkey % 5 = 0 then 70000 else p_size * 300 end as aux, case when p_partkey % 3 = 0 then 'rsrc' when p_partkey % 3 = 1 then 'disk' else 'data' end as fork from part)
select p_partkey, case when k < 256 and aux < 65536 then '#' || lpad(lower(to_hex(k)), 2, '0') || lpad(lower(to_hex(aux)), 4, '0') else '#' || lpad(lower(to_hex(k)), 8, '0') || lpad(lower(to_hex(aux)), 8, '0') end || case fork when 'rsrc' then 'r' when 'disk' then 'i' else '' end as tag,
  cast(k as bigint) as file_type, cast(aux as bigint) as aux_type, fork from p""")
def preservation_tags(t):
    n = F.col("p_partkey")
    p = t("part").select("p_partkey", (F.col("p_size") * 7).alias("k"), F.when(n % 5 == 0, 70000).otherwise(F.col("p_size") * 300).alias("aux"), F.when(n % 3 == 0, "rsrc").when(n % 3 == 1, "disk").otherwise("data").alias("f"))
    p = p.select("p_partkey", N.preservation_tag(F.col("k"), F.col("aux"), F.col("f")).alias("tag"))
    back = N.read_tag(F.concat(F.lit("A.FILE"), F.col("tag")))
    return p.withColumn("b", back).select("p_partkey", "tag", "b.file_type", "b.aux_type", "b.fork")


@query(r"""select page_id, regexp_replace(n, '[\\/:*?"<>|\x00-\x1f\x7f]', '_', 'g') as local from (select page_id, url || case when page_id % 9 = 0 then '*' else '' end as n from pages)""")
def local_names(t):
    n = F.concat("url", F.when(F.col("page_id") % 9 == 0, "*").otherwise(""))
    return t("pages").select("page_id", N.local_name(n, False).alias("local"))


_SQL_CUT = lambda n, most, to: f"case when length({n}) > {most} then case when contains({n}, '.') and length(split_part({n}, '.', -1)) <= 3 then left({n}, {to} - 1 - length(split_part({n}, '.', -1))) || '.' || split_part({n}, '.', -1) else left({n}, {to}) end else {n} end"


@query(f"""with n as (select c_custkey, case c_custkey % 4 when 0 then c_name || '.txt' when 1 then '#' || c_custkey || ' ' || c_mktsegment when 2 then lower(c_mktsegment) || ':,' || c_name || '.c' else '?$' end as name from customer),
s as (select c_custkey, name, regexp_replace(name, '^[^A-Za-z0-9]+', '') as start from n), p as (select *, regexp_replace(case when start = '' then 'Z' when regexp_matches(start, '^[0-9]') then 'A' || start else start end, '[^A-Za-z0-9. ]', '', 'g') as plain, replace(name, ':', '_') as mac from s)
select c_custkey, {_SQL_CUT('plain', 15, 15)} as prodos, upper(replace({_SQL_CUT('plain', 15, 15)}, ' ', '.')) as stored, left(upper(replace(name, ',', '_')), 30) as dos,
  case when regexp_replace(name, '[^\x21-\x7E]|[$=?,\\[#:]', '', 'g') = '' then 'BLANK' else left(upper(regexp_replace(name, '[^\x21-\x7E]|[$=?,\\[#:]', '', 'g')), 15) end as pascal, {_SQL_CUT('mac', 31, 15)} as hfs from p""")
def normalized_names(t):
    """Names as each file system takes them."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat("c_name", F.lit(".txt"))).when(k % 4 == 1, F.concat(F.lit("#"), k.cast("string"), F.lit(" "), "c_mktsegment")).when(k % 4 == 2, F.concat(F.lower("c_mktsegment"), F.lit(":,"), "c_name", F.lit(".c"))).otherwise("?$")
    c = t("customer").select("c_custkey", name.alias("name"))
    n = F.col("name")
    return c.select("c_custkey", N.prodos_name(n).alias("prodos"), N.prodos_stored(N.prodos_name(n)).alias("stored"), N.dos_name(n).alias("dos"), N.pascal_name(n).alias("pascal"), N.hfs_name(n).alias("hfs"))


@query("""with a as (select doc_id, text from documents), b as (select doc_id, case when doc_id % 10 = 0 then text || '.' else text end as text from documents)
select 'lost' as side, count(*) as n from (select doc_id, md5(text) from a except all select doc_id, md5(text) from b) union all select 'new', count(*) from (select doc_id, md5(text) from b except all select doc_id, md5(text) from a)""")
def recompress_compare(t):
    """Digests of all documents before and after a rewrite, compared as sets both ways."""
    d = t("documents")
    a = d.select("doc_id", F.md5("text").alias("h"))
    b = d.select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("h"))
    side = lambda x, y, n: x.exceptAll(y).agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("n"))
    return side(a, b, "lost").union(side(b, a, "new"))


@query("""select value, n, cast(row_number() over (order by n desc, value) as int) as rank from (select cast('0x' || h as int) as value, count(*) as n from (select unnest(regexp_extract_all(hex(encode(text)), '..')) as h from documents) group by 1)""")
def byte_histogram(t):
    """How often each byte stands in the documents, most frequent first, as a packer chooses its favourites."""
    return M.byte_histogram(t("documents").select(F.encode("text", "UTF-8").alias("data")), "data")


@query("""select l_orderkey, bit_xor(cast(l_partkey as bigint)) # 255 as checksum from lineitem group by l_orderkey""".replace("bit_xor(cast(l_partkey as bigint)) # 255", "xor(bit_xor(cast(l_partkey as bigint)), cast(255 as bigint))"))
def xor_checksum(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.bit_xor("l_partkey").bitwiseXOR(F.lit(255)).alias("checksum"))


@query("select o_orderkey, o_orderpriority from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 48)")
def delete_records(t):
    doomed = t("lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return X.delete_records(t("orders").select("o_orderkey", "o_orderpriority"), doomed, "o_orderkey")


@query("""with r as (select p_partkey, p_name as name, case when p_partkey % 5 = 0 then upper(p_name) when p_partkey % 7 = 0 then 'SAME' when p_partkey % 11 = 0 then 'P' || p_partkey end as new from part),
n as (select *, coalesce(new, name) as wanted from r), c as (select lower(wanted) as low, count(*) > 1 as clash from n group by 1)
select p_partkey, case when new is null or new = name or clash then name else new end as name, case when new is null or new = name then 'kept' when clash then 'collision' else 'renamed' end as status from n join c on lower(wanted) = low""")
def rename_records(t):
    p = t("part").select("p_partkey", F.col("p_name").alias("name"))
    k = F.col("p_partkey")
    changes = p.select("p_partkey", F.when(k % 5 == 0, F.upper("name")).when(k % 7 == 0, "SAME").when(k % 11 == 0, F.concat(F.lit("P"), k.cast("string"))).alias("new"))
    return X.rename_records(p, changes, "p_partkey", "name", "new")


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'SET' else c_mktsegment end as c_mktsegment, case when c_custkey % 4 = 0 then 1 else c_nationkey end as c_nationkey from customer""")
def set_attributes(t):
    c = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    changes = c.where((k % 3 == 0) | (k % 4 == 0)).select("c_custkey", F.when(k % 3 == 0, "SET").alias("c_mktsegment"), F.when(k % 4 == 0, 1).cast("int").alias("c_nationkey"))
    return X.set_attributes(c, changes, "c_custkey")


@query("""with k as (select conv_id, turn, case role when 'user' then 'data' when 'assistant' then 'rsrc' else 'disk' end as kind from conversations), h as (select * from k where turn < 2), i as (select * from k where turn >= 2),
x as (select i.*, (select count(*) from h where h.conv_id = i.conv_id and (h.kind = i.kind or h.kind = 'disk' or i.kind = 'disk')) as old, (select count(*) from i j where j.conv_id = i.conv_id and (j.kind = i.kind or j.kind = 'disk' or i.kind = 'disk')) as own from i)
select conv_id, turn, kind, old = 0 and own <= 1 as allowed from x""")
def thread_conflicts(t):
    k = F.when(F.col("role") == "user", "data").when(F.col("role") == "assistant", "rsrc").otherwise("disk")
    c = t("conversations").select("conv_id", "turn", k.alias("kind"))
    return X.thread_conflicts(c.where("turn < 2"), c.where("turn >= 2"), "conv_id", "kind")


@query("""select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(round(l_quantity) as bigint)) as bigint) as quantity, round(avg(l_discount), 6) as discount from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def envelope_pricing_summary(t):
    return t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""select n_name, count(*) as orders, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents from customer join orders on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
where r_name = (select min(r_name) from region) and o_orderdate >= timestamp '1996-01-01' group by n_name""")
def envelope_region_orders(t):
    r = t("region").join(t("region").agg(F.min("r_name").alias("r_name")), "r_name", "left_semi")
    n = t("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = t("orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")).select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum("cents").alias("cents"))
