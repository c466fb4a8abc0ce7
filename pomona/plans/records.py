"""Registered queries of the type, selection and summary operators, with their SQL for comparison.

The driver's tables stand for a catalogue: `part` for its entries, `conversations` for the threads of its records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pomona.operators import display as S
from pomona.operators import integrity as I
from pomona.operators import selection as L
from pomona.operators import summary as M
from pomona.operators import symbols as B
from pomona.operators import text as T
from pomona.operators import types as Y

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


#: The parts as entries: forked ones, disks and damaged ones among them.
_ENTRIES = """e as (select p_partkey as ordinal, p_brand as volume_id, p_name as path, case when p_partkey % 7 = 0 then 'disk' when p_partkey % 7 = 1 then 'forked' when p_partkey % 7 = 2 then 'directory' else 'file' end as record_kind,
  cast(p_partkey * 7 % 256 as bigint) as file_type, cast(p_partkey * 2654435 % 4294967296 as bigint) as aux_type, cast(p_size * 5 % 256 as int) as access, cast(p_partkey * 37 % 5000 as bigint) as data_len,
  case when p_partkey % 7 = 1 then cast(p_partkey * 11 % 900 as bigint) end as rsrc_len, cast(p_partkey * 23 % 4000 as bigint) as packed_len, p_type as format, case when p_partkey % 13 = 0 then 'damaged' else 'good' end as quality,
  timestamp '1990-01-01' + interval 1 day * (p_partkey % 3000) as modified_at from part)"""


def _entries(t) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 7 == 0, "disk").when(k % 7 == 1, "forked").when(k % 7 == 2, "directory").otherwise("file")
    return t("part").select(
        k.alias("ordinal"), F.col("p_brand").alias("volume_id"), F.col("p_name").alias("path"), kind.alias("record_kind"), (k * 7 % 256).cast("long").alias("file_type"), (k.cast("long") * 2654435 % 4294967296).alias("aux_type"),
        (F.col("p_size") * 5 % 256).cast("int").alias("access"), (k * 37 % 5000).cast("long").alias("data_len"), F.when(k % 7 == 1, (k * 11 % 900).cast("long")).alias("rsrc_len"), (k * 23 % 4000).cast("long").alias("packed_len"),
        F.col("p_type").alias("format"), F.when(k % 13 == 0, "damaged").otherwise("good").alias("quality"), F.timestamp_add("DAY", (k % 3000).cast("int"), F.lit("1990-01-01").cast("timestamp")).alias("modified_at"),
    )


def _sql_type_name(code: str) -> str:
    table = Y.name_table()
    return "case " + " ".join(f"when {code} = {k} then '{v}'" for k, v in table.items()) + f" when {code} between 0 and 255 then '$' || lpad(upper(to_hex({code})), 2, '0') when {code} is not null then '???' end"


def _sql_description(code: str, aux: str) -> str:
    return "case " + " ".join(f"when {code} = {k} and {aux} between {a} and {z} then '{t}'" for k, a, z, t in reversed(Y.DESCRIPTIONS)) + " end"


@query(f"with x as (select p_partkey, cast(p_partkey % 260 as bigint) as code, cast(p_partkey % 5 as bigint) as aux from part) select p_partkey, {_sql_type_name('code')} as type_name, {_sql_description('code', 'aux')} as type_description from x")
def type_names(t):
    p = t("part").select("p_partkey", (F.col("p_partkey") % 260).cast("long").alias("code"), (F.col("p_partkey") % 5).cast("long").alias("aux"))
    return p.select("p_partkey", Y.type_name(F.col("code")).alias("type_name"), Y.type_description(F.col("code"), F.col("aux")).alias("type_description"))


_EXT = f"""with n as (select page_id, case when page_id % 4 = 0 then 'a.b/name' when page_id % 4 = 1 then 'dir/read.me' when page_id % 4 = 2 then 'x.txt' else 'n.' || page_id end as local, cast(page_id * 5 % 256 as bigint) as code, case when page_id % 9 = 0 then 'disk' else 'data' end as fork from pages),
x as (select *, case when position('.' in split_part(local, '/', -1)) = 0 then '' else split_part(split_part(local, '/', -1), '.', -1) end as own, {_sql_type_name('code')} as name from n),
w as (select *, case when code = 4 then 'TXT' when fork = 'disk' then 'PO' when own <> '' then own when code <> 0 and not regexp_matches(name, '^[$?]') then name end as wanted from x)"""


@query(_EXT + " select page_id, case when wanted is null or (own <> '' and upper(own) = upper(wanted)) or length(wanted) >= 5 or regexp_matches(wanted, '^[0-9]*$') then '' else '.' || wanted end as extension from w")
def type_extensions(t):
    k = F.col("page_id")
    local = F.when(k % 4 == 0, "a.b/name").when(k % 4 == 1, "dir/read.me").when(k % 4 == 2, "x.txt").otherwise(F.concat(F.lit("n."), k.cast("string")))
    p = t("pages").select("page_id", local.alias("local"), (k * 5 % 256).cast("long").alias("code"), F.when(k % 9 == 0, "disk").otherwise("data").alias("fork"))
    return p.select("page_id", Y.extracted_extension(F.col("local"), F.col("code"), F.col("fork")).alias("extension"))


@query("""select p_partkey, replace(p_name, ' ', '/') as path, cast(p_size as bigint) as file_type, cast(p_partkey % 65536 as bigint) as aux_type, 'data' as fork from part""")
def archive_names(t):
    """Names with tags, in a Windows folder, taken back into an archive."""
    tag = F.concat(F.lit("#"), F.lpad(F.hex("p_size"), 2, "0"), F.lpad(F.hex(F.col("p_partkey") % 65536), 4, "0"))
    local = F.concat(F.lit("C:\\"), F.translate("p_name", " ", "\\"), tag)
    return t("part").select("p_partkey", Y.archive_name(local).alias("x")).select("p_partkey", "x.*")


_THREADS = """th as (select conv_id, turn as thread_idx, case role when 'system' then 0 else 2 end as thread_class, case when role = 'system' then 1 when role = 'user' then 0 when turn % 4 = 3 then 1 else 2 end as kind,
  cast(length(text) as bigint) as eof, cast(length(text) // 2 as bigint) as comp_eof, case turn % 3 when 0 then 'stored' when 1 then 'lzw2' else 'squeeze' end as format from conversations)"""


def _threads(t) -> DataFrame:
    role, turn = F.col("role"), F.col("turn")
    n = F.length("text").cast("long")
    return t("conversations").select(
        "conv_id", turn.alias("thread_idx"), F.when(role == "system", 0).otherwise(2).alias("thread_class"), F.when(role == "system", 1).when(role == "user", 0).when(turn % 4 == 3, 1).otherwise(2).alias("kind"),
        n.alias("eof"), F.floor(n / 2).alias("comp_eof"), F.when(turn % 3 == 0, "stored").when(turn % 3 == 1, "lzw2").otherwise("squeeze").alias("format"),
    )


def _sql_first(kind: int, name: str) -> str:
    return f"coalesce(arg_min(eof, thread_idx) filter (where thread_class = 2 and kind = {kind}), -1) as {name}"


@query(f"""with {_THREADS} select conv_id, count(*) as threads,
  case when count(*) filter (where thread_class = 2 and kind in (1, 2)) > 0 then case arg_max(kind, thread_idx) filter (where thread_class = 2 and kind in (1, 2)) when 2 then 'forked' else 'disk' end when count(*) filter (where thread_class = 2) > 0 then 'file' else 'unknown' end as record_kind,
  {_sql_first(0, 'data_len')}, {_sql_first(2, 'rsrc_len')}, {_sql_first(1, 'disk_len')}, cast(coalesce(sum(comp_eof) filter (where thread_class = 2), 0) as bigint) as packed_len,
  coalesce(arg_min(format, thread_idx) filter (where thread_class = 2 and format <> 'stored'), 'stored') as format, bool_or(thread_class = 0) as has_comment, bool_or(thread_class = 0 and eof > 0) as comment_nonempty from th group by conv_id""")
def thread_summary(t):
    return M.record_summary(_threads(t), "conv_id")


@query(f"with {_THREADS}, m as (select conv_id, bit_or(case when thread_class = 0 then {L.COMMENT} when kind = 0 then {L.DATA} when kind = 2 then {L.RSRC} else {L.DISK} end) as mask from th group by conv_id) select conv_id, cast(mask as int) as mask from m where mask & {L.RSRC | L.COMMENT} <> 0 and conv_id % 11 <> 0")
def masked_selection(t):
    """Records that hold a resource fork or a comment, without the damaged ones."""
    records = t("conversations").select("conv_id").distinct().withColumn("record_kind", F.lit("file")).withColumn("quality", F.when(F.col("conv_id") % 11 == 0, "damaged").otherwise("good"))
    e = L.thread_mask(records, _threads(t), ("conv_id",))
    return L.selected(e, L.RSRC | L.COMMENT).select("conv_id", F.col("mask").cast("int").alias("mask"))


@query("""with f as (select c_custkey, c_nationkey, left(c_name, 12 + c_custkey % 6) as name, c_custkey % 2 = 1 as is_rsrc from customer), n as (select *, row_number() over (partition by c_nationkey, lower(name), is_rsrc order by c_custkey) as n from f)
select c_nationkey, lower(name) as name, n, coalesce(max(case when not is_rsrc then c_custkey end), -1) as data, coalesce(max(case when is_rsrc then c_custkey end), -1) as rsrc from n group by c_nationkey, lower(name), n""")
def paired_forks(t):
    c = t("customer").select("c_custkey", "c_nationkey", F.expr("left(c_name, cast(12 + c_custkey % 6 as int))").alias("name"))
    return M.paired_forks(c, "c_nationkey", "name", "c_custkey", F.col("c_custkey") % 2 == 1)


@query(f"""with {_ENTRIES} select volume_id, count(*) as entries, count(*) filter (where record_kind <> 'directory') as files, cast(sum(data_len + coalesce(rsrc_len, 0)) as bigint) as total, cast(sum(packed_len) as bigint) as packed,
  cast(sum(data_len + coalesce(rsrc_len, 0) - packed_len) as bigint) as saved, count(*) filter (where quality = 'damaged') as damaged from e group by volume_id""")
def volume_totals(t):
    return M.archive_totals(_entries(t), "volume_id")


@query(f"""with {_ENTRIES}, v as (select p_brand as volume_id, bool_or(p_size = 50) as bad from part group by 1), d as (select volume_id, count(*) filter (where quality = 'damaged') as n from e group by 1)
select volume_id, bad as volume_damaged, n as damaged_entries, cast(0 as bigint) as suspicious_entries, bad or n > 0 as any_damage from v join d using (volume_id)""")
def damage_summary(t):
    v = t("part").groupBy(F.col("p_brand").alias("volume_id")).agg(F.bool_or(F.col("p_size") == 50).alias("damaged"))
    return M.damage_summary(v, _entries(t))


def _sql_rank(column: str) -> str:
    total, plus = "data_len + coalesce(rsrc_len, 0)", "case when record_kind = 'forked' then '+' else '' end"
    disk = "case when record_kind = 'disk' then 0 else 1 end"
    ratio = f"case when ({total} = 0) <> (packed_len = 0) then -1 when {total} < packed_len then 101 when {total} = 0 then 100 else greatest(packed_len * 100 // ({total}), case when packed_len >= 0 then 1 end) end"
    by = {
        "path": "lower(path)", "type": f"lower(case when record_kind = 'disk' then 'Disk' else {_sql_type_name('file_type')} || {plus} end), {disk}, aux_type", "aux": f"{disk}, aux_type", "date": "modified_at",
        "format": "format", "size": total, "ratio": ratio, "packed": "packed_len", "access": "access",
    }[column]
    return f"select '{column}' as column_name, ordinal, row_number() over (order by {by}, ordinal) as rank from e"


@query(f"with {_ENTRIES} " + " union all ".join(map(_sql_rank, M.COLUMNS)))
def sorted_columns(t):
    """Every entry's place in the list under each of the nine columns."""
    e, out = _entries(t), None
    for c in M.COLUMNS:
        one = M.sorted_catalog(e, c).select(F.lit(c).alias("column_name"), "ordinal", "rank")
        out = one if out is None else out.union(one)
    return out


@query(f"with {_ENTRIES} select ordinal, row_number() over (partition by volume_id order by case when record_kind = 'disk' then 0 else 1 end desc, (aux_type + 2147483648) % 4294967296 desc, ordinal desc) as rank from e".replace(", ordinal desc)", ", ordinal desc)"))
def wrapped_aux_sort(t):
    """By aux type from above, with the 32-bit difference that wraps around."""
    return M.sorted_catalog(_entries(t), "aux", descending=True, quirk=True, group="volume_id").select("ordinal", "rank")


@query("""with e as (select page_id as ordinal, cast(page_id % 20 as int) as volume_id, url as path from pages) select ordinal, len(string_split(path, '/')) as depth, row_number() over (partition by volume_id order by len(string_split(path, '/')) desc, ordinal desc) as step,
  row_number() over (partition by volume_id order by string_split(lower(path), '/'), ordinal) as place from e""")
def delete_and_list_order(t):
    e = t("pages").select(F.col("page_id").alias("ordinal"), (F.col("page_id") % 20).cast("int").alias("volume_id"), F.col("url").alias("path"))
    return M.listing_order(M.delete_order(e)).select("ordinal", F.col("depth").cast("long").alias("depth"), "step", "place")


@query("""with p as (select page_id, cast(page_id % 20 as int) as volume_id, lower(url) as path, string_split(lower(url), '/') as s from pages), d as (select volume_id, array_to_string(s[1:n], '/') as dir, page_id from (select *, unnest(range(0, len(s) + 1)) as n from p where page_id % 3 > 0)),
l as (select volume_id, dir, max(page_id) as after from d group by 1, 2) select page_id, coalesce(after, -1) as after from (select *, array_to_string(s[1:len(s) - 1], '/') as dir from p where page_id % 3 = 0) i left join l on i.volume_id = l.volume_id and i.dir = l.dir""")
def insert_places(t):
    p = t("pages").select("page_id", (F.col("page_id") % 20).cast("int").alias("volume_id"), F.col("url").alias("path"), F.col("page_id").alias("ordinal"))
    new = p.where("page_id % 3 = 0").withColumn("path", F.concat_ws("\t", "path", F.col("page_id").cast("string")))
    # the id rides along in the name, so that rows can be told apart
    out = M.insert_places(p.where("page_id % 3 > 0"), new)
    return out.select(F.element_at(F.split("path", "\t"), -1).cast("long").alias("page_id"), "after")


@query("""select c_custkey, lower(c_mktsegment) in ('building', 'machinery') as listed from customer""")
def semicolon_list(t):
    return t("customer").select("c_custkey", L.in_list(F.col("c_mktsegment"), F.lit("Building; machin ery;;FURN")).alias("listed"))


@query("""select doc_id, cast((length(t) - length(replace(t, 'th', ''))) // 2 as bigint) as hits, position('th' in t) as first, case when position('th' in substr(t, 51)) > 0 then position('th' in substr(t, 51)) + 50 else position('th' in t) end as next from (select doc_id, lower(text) as t from documents)""")
def find_in_documents(t):
    """All hits of a string, the first, and the first beyond the fiftieth character."""
    d = t("documents").select("doc_id", L.find_in_text(F.col("text"), "TH").alias("at"))
    return d.select("doc_id", F.size("at").cast("long").alias("hits"), F.coalesce(F.get("at", F.lit(0)), F.lit(0)).cast("long").alias("first"), F.coalesce(L.next_hit(F.col("at"), F.lit(50)), F.lit(0)).cast("long").alias("next"))


@query("""select c_custkey, regexp_matches(n, '^[A-Za-z][A-Za-z0-9.]{0,14}$') as prodos, regexp_matches(n, '^[^:]{1,31}$') as hfs from (select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 3 = 1 then c_name else left(c_mktsegment, 3) || ':' || c_custkey end as n from customer)""")
def valid_names(t):
    k = F.col("c_custkey")
    c = t("customer").select("c_custkey", F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, F.col("c_name")).otherwise(F.concat(F.substring("c_mktsegment", 1, 3), F.lit(":"), k.cast("string"))).alias("n"))
    return c.select("c_custkey", L.valid_name(F.col("n"), "ProDOS").alias("prodos"), L.valid_name(F.col("n"), "HFS").alias("hfs"))


@query("""with s as (select lower(url) as p from pages where page_id % 50 = 0), u as (select page_id, lower(url) as p, string_split(lower(url), '/') as a from pages), x as (select page_id, array_to_string(a[1:n], '/') as top from (select *, unnest(range(1, greatest(len(a) - 1, 1) + 1)) as n from u))
select page_id, page_id % 50 = 0 or page_id in (select x.page_id from x join s on x.top = s.p) as selected from pages""")
def select_with_children(t):
    p = t("pages").select("page_id", F.col("url").alias("path"), (F.col("page_id") % 50 == 0).alias("selected"))
    return L.with_children(p).select("page_id", "selected")


@query("""select l_orderkey, l_linenumber, selected from (select l_orderkey, l_linenumber, not (l_quantity > 25) as selected from lineitem)""")
def invert_selection(t):
    e = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("selected"))
    return L.marked(e, "invert")


_KINDS = "select * from (values " + ", ".join(f"({i}, '{k}')" for i, k in enumerate([*L.CAPABILITIES, "other"])) + ") as x(i, kind)"


@query("with k as (" + _KINDS + "), c as (select c_custkey, kind from customer join k on c_custkey % " + str(len(L.CAPABILITIES) + 1) + " = i) select c_custkey, kind, " + ", ".join(f"kind in ({', '.join(repr(k) for k, v in L.CAPABILITIES.items() if f in v)})" + (" or kind = 'other'" if f == "read_only" else "") + f" as {f}" for f in ("read_only", "forks", "rename_volume")) + " from c")
def container_features(t):
    """What the container of each row can do."""
    kinds = [*L.CAPABILITIES, "other"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("c_custkey") % len(kinds)).cast("int") + 1)
    c = t("customer").select("c_custkey", kind.alias("kind"))
    return c.select("c_custkey", "kind", *(L.can(F.col("kind"), f).alias(f) for f in ("read_only", "forks", "rename_volume")))


@query("""with a as (select o_custkey % 50 as k, cast(round(o_totalprice) as bigint) as n from orders), b as (select k, cast(sum(n) as bigint) as before, cast(sum(n - n // 3) as bigint) as after from a group by k)
select k, before, after, before - after as saved, cast(case when after < 21474836 then after * 100 // before else after // (before // 100) end as int) as percent_left from b""")
def packing_savings(t):
    o = t("orders").select((F.col("o_custkey") % 50).alias("k"), F.round("o_totalprice").cast("long").alias("n"))
    before, after = o.select("k", F.col("n").alias("packed_len")), o.select("k", (F.col("n") - F.floor(F.col("n") / 3)).alias("packed_len"))
    return M.recompress_savings(before, after, "k")


@query("""with x as (select l_partkey, l_suppkey, l_quantity from lineitem), a as (select l_partkey, l_suppkey from x where l_quantity > 5), b as (select l_partkey, l_suppkey from x where l_quantity <= 45)
select l_partkey, l_suppkey, count(*) as n, 'lost' as side from (select * from a except all select * from b) group by 1, 2 union all select l_partkey, l_suppkey, count(*), 'new' from (select * from b except all select * from a) group by 1, 2""")
def digest_compare(t):
    x = t("lineitem")
    return M.crc_compare(x.where("l_quantity > 5"), x.where("l_quantity <= 45"), "l_partkey", "l_suppkey")


@query("""with c as (select user_id as volume_id, cast(event_id as bigint) as chunk_idx, case when event_type = 'click' then 1 else 0 end as users from events),
m as (select volume_id, max(chunk_idx) as top, coalesce(max(case when users > 0 then chunk_idx end), -1) as last from c group by 1), i as (select m.volume_id, top, count(*) as n, min(chunk_idx) as low from m join c on c.volume_id = m.volume_id and c.chunk_idx > last and users = 0 group by 1, 2)
select m.volume_id, case when i.n is not null and i.n = i.top - i.low + 1 then i.low else m.top + 1 end as first, cast(case when i.n is not null and i.n = i.top - i.low + 1 then i.n else 0 end as bigint) as length from m left join i on m.volume_id = i.volume_id""")
def trailing_runs(t):
    c = t("events").select(F.col("user_id").alias("volume_id"), F.col("event_id").cast("long").alias("chunk_idx"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("users"), F.lit(True).alias("is_marked_used"))
    return M.trailing_run(c)


@query("""with e as (select event_id, user_id, event_id as start, event_id + event_id % 60 as stop from events), w as (select *, max(stop) over (partition by user_id order by start, stop rows between unbounded preceding and 1 preceding) as reach from e)
select event_id, coalesce(reach > start, false) as overlaps, stop <= start or stop > 9990 or start < 0 as outside from w""")
def extent_overlaps(t):
    e = t("events").select("event_id", "user_id", F.col("event_id").alias("start"), (F.col("event_id") + F.col("event_id") % 60).alias("stop"), F.lit(9990).alias("total"))
    return I.extent_overlaps(e, "user_id", "start", "stop", "total").select("event_id", "overlaps", "outside")


@query("""with l as (select s_suppkey as n, case when s_suppkey % 10 = 0 then null else cast(s_suppkey * 7 % 50 as int) end as value, s_name as name, s_suppkey // 10 as section from supplier), t as (select section, value, arg_min(name, n) as name from l where value is not null group by 1, 2)
select p_partkey, t.name, row_number_of.place from part left join t on p_partkey % 7 = t.section and p_size = t.value left join (select section, value, row_number() over (partition by section order by value) as place from t) row_number_of on row_number_of.section = t.section and row_number_of.value = t.value""")
def symbol_names(t):
    """The suppliers as lines of a symbol file, ten to a section, and the parts as numbers to be named."""
    k = F.col("s_suppkey")
    head = F.concat(F.lit("* "), F.floor(k / 10).cast("string"))
    lines = t("supplier").select(k.alias("line_no"), F.when(k % 10 == 0, head).otherwise(F.concat(F.lpad(F.hex((k * 7 % 50).cast("long")), 4, "0"), F.lit(" "), "s_name")).alias("line"))
    table = B.sorted_symbols(B.symbol_table(lines))
    p = t("part").select("p_partkey", (F.col("p_partkey") % 7).cast("string").alias("s"), "p_size")
    named = B.lookup(p, table, F.col("s"), F.col("p_size"))
    places = table.select(F.col("section").alias("s"), F.col("value").alias("p_size"), "place")
    return named.join(places, ["s", "p_size"], "left").select("p_partkey", "name", "place")


@query(f"""with {_ENTRIES} select ordinal, case when p = '' then '<blank filename>' else p end as path, case record_kind when 'disk' then 'Disk' when 'directory' then 'DIR' else case when aux_type > 65535 or file_type > 255 then {" || ".join(f"case when (file_type >> {n}) & 255 between 32 and 126 then chr(cast((file_type >> {n}) & 255 as int)) else '?' end" for n in (24, 16, 8, 0))} else {_sql_type_name('file_type')} end || case when record_kind = 'forked' then '+' else '' end end as type,
  case when record_kind = 'disk' then (total // 1024) || 'k' when aux_type > 65535 or file_type > 255 then {" || ".join(f"case when (aux_type >> {n}) & 255 between 32 and 126 then chr(cast((aux_type >> {n}) & 255 as int)) else '?' end" for n in (24, 16, 8, 0))} else '$' || lpad(upper(to_hex(aux_type)), 4, '0') end as aux, strftime(modified_at, '%d-%b-%y %H:%M') as date, case when quality = 'damaged' then 'BROKEN' else format end as format, cast(total as varchar) as size,
  case when (total = 0) <> (packed_len = 0) then '---' when total < packed_len then '>100%' else (case when total = 0 then 100 else greatest(packed_len * 100 // total, 1) end) || '%' end as ratio, cast(packed_len as varchar) as packed, {" || ".join(f"case when access & {0x80 >> i} <> 0 then '{c}' else '' end" for i, c in enumerate(S.ACCESS_LETTERS))} as access
from (select *, path as p, data_len + coalesce(rsrc_len, 0) as total from (select * replace (case when ordinal % 3 = 0 then aux_type % 65536 else 65536 + aux_type % 10 end as aux_type) from e))""")
def listed_columns(t):
    """All nine columns of the list as they are shown."""
    e = _entries(t).withColumn("aux_type", F.when(F.col("ordinal") % 3 == 0, F.col("aux_type") % 65536).otherwise(65536 + F.col("aux_type") % 10))
    return S.listed(e).drop("volume_id")


@query("""with d as (select doc_id, regexp_replace(text, '[^\x01-\x7F]', '', 'g') as t from documents), k as (select doc_id, case doc_id % 3 when 1 then replace(t, chr(10), chr(13)) when 2 then replace(t, chr(10), chr(13) || chr(10)) else t end as t from d)
select doc_id, md5(replace(t, chr(13), '') ) as lf from (select doc_id, replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(13), chr(10)) as t from k)""")
def high_bit_texts(t):
    """ASCII parts of the texts with all top bits set and three kinds of line ends, made plain again."""
    plain = F.regexp_replace("text", "[^\\x01-\\x7F]", "")
    k = F.col("doc_id") % 3
    ends = F.when(k == 1, F.replace(plain, F.lit("\n"), F.lit("\r"))).when(k == 2, F.replace(plain, F.lit("\n"), F.lit("\r\n"))).otherwise(plain)
    high = F.translate(ends, "".join(map(chr, range(1, 128))), "".join(map(chr, range(129, 256))))
    return t("documents").select("doc_id", F.md5(T.converted(high, "lf", high="auto")).alias("lf"))


@query("""with c as (select l_suppkey, l_orderkey % 200 as chunk, count(*) as users, bool_or(l_quantity > 10) as marked, min(case l_returnflag when 'A' then 'data' when 'N' then 'structure' else 'odd' end) as purpose from lineitem group by 1, 2),
s as (select *, case when not marked then '!' when users > 1 then '#' when purpose = 'data' then 'F' when purpose = 'structure' then 'I' else '?' end as letter from c), k as (select distinct l_suppkey, n from c, range(0, 224) r(n)),
g as (select k.l_suppkey, n // 32 as line, string_agg(coalesce(letter, '-'), '' order by n) as map, count(letter) as held from k left join s on s.l_suppkey = k.l_suppkey and s.chunk = k.n group by 1, 2) select l_suppkey, line, map from g where held > 0""")
def chunk_maps(t):
    """Each supplier as a volume whose chunks its lines use."""
    purpose = F.when(F.col("l_returnflag") == "A", "data").when(F.col("l_returnflag") == "N", "structure").otherwise("odd")
    c = t("lineitem").groupBy("l_suppkey", (F.col("l_orderkey") % 200).alias("chunk")).agg(F.count(F.lit(1)).alias("users"), F.bool_or(F.col("l_quantity") > 10).alias("marked"), F.min(purpose).alias("purpose"))
    return I.chunk_map(c.withColumn("letter", I.chunk_letter(F.col("users"), F.col("marked"), F.col("purpose"))), "l_suppkey", "chunk", "letter")


# --- plain relational operations of the envelope


@query("""select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, cast(grouping(l_returnflag) * 2 + grouping(l_linestatus) as bigint) as level, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)""")
def envelope_cube(t):
    c = t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "level", "n")


@query("""select coalesce(r_name, '*') as region, coalesce(n_name, '*') as nation, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def envelope_rollup(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers")).select(F.coalesce("r_name", F.lit("*")).alias("region"), F.coalesce("n_name", F.lit("*")).alias("nation"), "customers")


@query("""select event_type, date_trunc('hour', ts) as start, count(*) as n from events group by 1, 2""")
def envelope_tumbling(t):
    w = F.window("ts", "1 hour")
    return t("events").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@query("""with s as (select event_id, ts, unnest([0, 1]) as k from events) select date_trunc('hour', ts) + interval 30 minute * (case when minute(ts) >= 30 then 1 else 0 end) - interval 30 minute * k as start, count(*) as n from s group by 1""")
def envelope_sliding(t):
    return t("events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""with a as (select user_id, ts, event_id, case when ts - lag(ts) over w > interval 2 hour or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from a) select user_id, min(ts) as start, count(*) as n from s group by user_id, session""")
def envelope_sessions(t):
    """Sessions that end after two idle hours; a gap of exactly two hours still belongs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    e = t("events").withColumn("new", F.when(before.isNull() | (F.col("ts") - before > F.expr("interval 2 hours")), 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).select("user_id", "start", "n")


@query("""select e.event_id, p.event_id as before_id from events e asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts > p.ts where e.event_type = 'click'""")
def envelope_as_of(t):
    """Each click's last purchase strictly before it: one window over both sides, no join of all with all."""
    e = t("events").where("event_type in ('click', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    # clicks stand before purchases of the same time, so every purchase in front of a click is earlier
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("before_id", last).where("event_type = 'click'").select("event_id", "before_id")
