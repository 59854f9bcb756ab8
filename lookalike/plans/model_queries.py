"""Queries of cleaning (E), semantics (C) and models (D) with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lookalike.functions.rng import normal_sql, uniform, uniform_sql
from lookalike.operators import clean as E
from lookalike.operators import models as M
from lookalike.operators import semantics as C
from lookalike.plans.registry import query
from lookalike.plans.util import COLUMNS, nullified, t, union_all

# --- E


@query("e01_approved_columns", "select o_orderkey, o_totalprice from orders")
def e01(s, d):
    return E.approved_columns(t(s, d, "orders"), ["o_orderkey", "o_totalprice", "gone"])


@query("e01_exclusions", "select column_name, case when column_name = 'o_orderstatus' then 'sensitive' else 'not in contract' end as reason from (describe orders) where column_name not in ('o_orderkey', 'o_totalprice') and (select count(*) from orders) > 0")
def e01x(s, d):
    return E.exclusions(t(s, d, "orders"), ["o_orderkey", "o_totalprice"], {"o_orderstatus": "sensitive"})


@query("e02_strip_text", r"select doc_id, md5(regexp_replace(text, '^[\s]+|[\s]+$', '', 'g')) as digest from (select doc_id, chr(9) || text || chr(10) || ' ' as text from documents)")
def e02(s, d):
    padded = t(s, d, "documents").select("doc_id", F.concat(F.lit("\t"), "text", F.lit("\n ")).alias("text"))
    return E.strip_text(padded, ["text"]).select("doc_id", F.md5("text").alias("digest"))


@query("e03_duplicate_rows", "select count(*) as row_count, count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as duplicate_rows from lineitem")
def e03(s, d):
    return E.duplicate_rows(t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("e04_identifier_report", union_all("select '{c}' as column_name, count({c}) - count(distinct {c}) as duplicate_values from lineitem", ["l_orderkey", "l_partkey"]))
def e04(s, d):
    return E.identifier_report(t(s, d, "lineitem"), ["l_orderkey", "l_partkey"])


def _dirty(s, d):
    u = uniform("dirty", "event_id")
    return t(s, d, "events").select("event_id", F.when(u < 0.02, "N/A").when(u < 0.1, F.lit(None)).otherwise(F.format_string("%.3f", "value")).alias("value"), F.when(u > 0.95, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"))


_U = uniform_sql("dirty", "event_id")
_DIRTY = f"(select event_id, case when {_U} < 0.02 then 'N/A' when {_U} < 0.1 then null else printf('%.3f', value) end as value, case when {_U} > 0.95 then null else event_type end as event_type from events)"


@query("e05_clean_numeric", f"with x as {_DIRTY}, n as (select *, try_cast(value as double) as v from x) select event_id, value is not null and v is null as value_failed, round(coalesce(v, (select quantile_cont(v, 0.5) from n)), 6) as value from n")
def e05(s, d):
    return E.clean_numeric(_dirty(s, d).select("event_id", "value"), "value").withColumn("value", F.round("value", 6))


@query("e06_iqr_outliers", "with q as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem) select l_orderkey, l_linenumber, l_extendedprice < a - 1.0 * (b - a) or l_extendedprice > b + 1.0 * (b - a) as is_outlier from lineitem, q")
def e06(s, d):
    return E.iqr_outliers(t(s, d, "lineitem"), "l_extendedprice", 1.0).select("l_orderkey", "l_linenumber", "is_outlier")


@query("e07_clean_category", f"with x as {_DIRTY} select event_id, coalesce(event_type, (select event_type from x where event_type is not null group by 1 order by count(*) desc, 1 limit 1)) as event_type from x")
def e07(s, d):
    return E.clean_category(_dirty(s, d).select("event_id", "event_type"), "event_type")


def _mixed(s, d):
    k = F.col("o_orderkey") % 3
    day = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("soon")
    return t(s, d, "orders").select("o_orderkey", day.alias("day"))


@query("e08_clean_datetime", "select o_orderkey, o_orderkey % 3 = 2 as day_failed, case when o_orderkey % 3 < 2 then date_trunc('day', o_orderdate)::timestamp end as day from orders")
def e08(s, d):
    return E.clean_datetime(_mixed(s, d), "day").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("e09_cleaning_report", f"with x as {_DIRTY} select 'event_type' as column_name, 'mode' as action, count(*) - count(event_type) as nulls_before, 0::bigint as nulls_after, count(*) - count(event_type) as imputed from x union all select 'value', 'median', count(*) - count(value), 0, count(*) - count(value) from x union all select 'event_id', 'none', 0, 0, 0 from (select 1)")
def e09(s, d):
    df = _dirty(s, d)
    after = E.clean_category(E.clean_numeric(df, "value"), "event_type")
    return E.cleaning_report(df, after, {"event_type": "mode", "value": "median"})


# --- C

def _c01_sql(source: str, keep: str) -> str:
    """Evidence of the names in ``source``, which has column_name."""
    words = r"list_filter(string_split_regex(lower(regexp_replace(column_name, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"
    one = r"regexp_replace({}, '^(.*.[^su])s$', '\1')".format
    among = lambda c, said: f"coalesce({c} in ({', '.join(repr(w) for w in said.split())}), false)"
    more = {t: f" or {among('head', C.CARRIERS)} and {among('before', C.HEADS[t][1])}" for t in C.CARRIED.split()}
    more |= {"person_name": f" or head = 'name' and (before is null or {among('before', C.PEOPLE)})", "boolean": f" or {among('head0', C.ASKS)}", "email": " or contains(column_name, 'email')"}
    more["category"] = f" and not ({among('head', C.CARRIERS)} and {among('before', C.HEADS['postal_code'][1])})"
    hits = ", ".join(f"case when {among('head', said)}{more.get(t, '')} then struct_pack(semantic := '{t}', weight := {w}::double) end" for t, (w, said) in C.HEADS.items())
    return f"select {keep}, r.semantic as semantic, r.weight as weight from (select {keep}, unnest([{hits}]) as r from (select {keep}, w[1] as head0, {one('w[-1]')} as head, {one('w[-2]')} as before from (select {keep}, {words} as w from ({source})))) where r is not null"


_OF = ("customer", "supplier", "part", "orders", "lineitem", "nation", "region", "events", "documents", "conversations", "pages")


_NAMED = " union all ".join(f"select '{n}' as table_name, column_name from (describe {n}) where (select count(*) from {n}) > 0" for n in _OF)


@query("c01_score_names", _c01_sql(_NAMED, "table_name, column_name"))
def c01(s, d):
    """Evidence of the names of the columns that the tables have; tables without rows have none."""
    parts = []
    for n in _OF:
        df = t(s, d, n)
        parts.append(C.score_names(s, df.columns).crossJoin(df.agg(F.count("*").alias("n"))).where("n > 0").select(F.lit(n).alias("table_name"), "column_name", "semantic", "weight"))
    return reduce(type(parts[0]).unionByName, parts)


_ORDER_TYPES = {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_orderdate": "datetime", "o_orderpriority": "string"}
_DT = "(values " + ", ".join(f"('{k}', '{a}', {w}::double)" for k, a, w in C.DTYPE_EVIDENCE) + ") r(kind, semantic, weight)"
_KINDS = "(" + " union all ".join([*(f"select '{c}' as column_name, '{k}' as kind" for c, k in _ORDER_TYPES.items()), "select 'o_totalprice', case when bool_and(o_totalprice = round(o_totalprice)) then 'integer' else 'float' end from orders"]) + ")"
_C02 = f"select column_name, semantic, weight from {_KINDS} k join {_DT} on r.kind = k.kind"


@query("c02_score_dtypes", _C02)
def c02(s, d):
    return C.score_dtypes(t(s, d, "orders"))


_STATS = union_all("select '{c}' as column_name, count(*) as n, count(distinct {c}) as dc, round(count(distinct {c})::double / count(*), 6) as ratio from orders", COLUMNS["orders"])
_C03 = f"select column_name, 'identifier' as semantic, 0.8::double as weight from ({_STATS}) join {_KINDS} using (column_name) where dc > 1 and ratio >= 0.98 and kind <> 'float' union all select column_name, 'category', 2.0 from ({_STATS}) join {_KINDS} using (column_name) where kind = 'string' and dc <= 20 and ratio <= 0.5"


@query("c03_score_cardinality", _C03)
def c03(s, d):
    return C.score_cardinality(t(s, d, "orders"))


def _shaped(s, d):
    return t(s, d, "customer").select(F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("a"), F.format_string("+1 555 %07d", "c_custkey").alias("b"), F.lit("Ada Lovelace").alias("p"), F.format_string("%05d", F.col("c_custkey") % 100000).alias("z"), F.when(F.col("c_nationkey") > 3, "yes").otherwise("No").alias("y"))


_SHAPED = "(select lower(replace(c_name, '#', '.')) || '@example.com' as a, printf('+1 555 %07d', c_custkey) as b, 'Ada Lovelace' as p, printf('%05d', c_custkey % 100000) as z, case when c_nationkey > 3 then 'yes' else 'No' end as y from customer)"


@query("c04_score_patterns", "\nunion all\n".join(f"select * from (select '{c}' as column_name, '{k}' as semantic, {w}::double as weight from {_SHAPED} having count(*) filter (where regexp_matches(trim({c}), '{p.replace(chr(39), chr(39) * 2)}')) >= 0.8 * count({c}))" for c in "abpzy" for k, p, w in C.PATTERN_EVIDENCE))
def c04(s, d):
    return C.score_patterns(_shaped(s, d))


@query("c05_score_quality", "select 'fixed' as column_name, 'category' as semantic, 0.5::double as weight from (select count(*) as n from nation) where n > 0 union all select 'n_nationkey', 'identifier', 3.0 from (select 1)")
def c05(s, d):
    return C.score_quality(t(s, d, "nation").withColumn("fixed", F.lit("x")), ["n_nationkey"])


_EV = _c01_sql("select column_name from (values " + ", ".join(f"('{n}')" for n in COLUMNS["orders"]) + ") c(column_name)", "column_name") + f" union all {_C02} union all {_C03} union all " + "\nunion all\n".join(f"select * from (select '{c}', '{k}', {w}::double from orders having count(*) filter (where regexp_matches(trim({c}), '{p.replace(chr(39), chr(39) * 2)}')) >= 0.8 * count({c}))" for c in ("o_orderstatus", "o_orderpriority") for k, p, w in C.PATTERN_EVIDENCE) + "\nunion all select 'o_orderkey', 'identifier', 3.0 union all " + "\nunion all\n".join(f"select * from (select '{c}', 'category', 0.5 from (select count(*) as n from orders group by {c}) having count(*) <= 50 and (count(*) <= 1 or max(n) >= 0.95 * sum(n)))" for c in COLUMNS["orders"])


SEMANTICS_SQL = f"""with e as ({_EV}), s as (select column_name, semantic, sum(weight) as score from e group by 1, 2),
r as (select *, round(score / sum(score) over (partition by column_name), 6) as share, row_number() over (partition by column_name order by score desc, semantic) as place from s),
n as (select *, coalesce(lead(share) over (partition by column_name order by score desc, semantic), 0.0) as nxt from r)
select column_name, max(semantic) filter (where place = 1) as semantic_type, max(share) filter (where place = 1) as confidence,
case when max(share) filter (where place = 1) < 0.5 or max(share) filter (where place = 1) - max(nxt) filter (where place = 1) < 0.15 then 'REVIEW_REQUIRED' else 'proposed' end as status,
coalesce(string_agg(semantic, ',' order by place) filter (where place between 2 and 4), '') as alternatives from n group by column_name"""


@query("c06_resolve_semantics", SEMANTICS_SQL)
def c06(s, d):
    return C.infer(t(s, d, "orders"), ["o_orderkey"])


@query("c07_infer_from_parts", "select true as same from (select count(*) as n from orders) where n > 0")
def c07(s, d):
    whole = C.infer(t(s, d, "orders"), ["o_orderkey"])
    parts = t(s, d, "orders")
    again = C.infer(parts.where("o_orderkey % 2 = 0").unionByName(parts.where("o_orderkey % 2 = 1")), ["o_orderkey"])
    return whole.exceptAll(again).unionByName(again.exceptAll(whole)).agg((F.count(F.lit(1)) == 0).alias("same"))


@query("c08_merge_contract", "select o_orderpriority as column_name, case when o_orderpriority like '1%' then 'decided' when o_orderpriority like '2%' then 'prior' else 'category' end as semantic_type, case when o_orderpriority < '3' then 'approved' else 'proposed' end as status, case when o_orderpriority < '3' then 4 else 1 end as revision from (select distinct o_orderpriority from orders)")
def c08(s, d):
    names = t(s, d, "orders").select(F.col("o_orderpriority").alias("column_name")).distinct()
    cand = names.select("column_name", F.lit("category").alias("semantic_type"), F.lit("proposed").alias("status"))
    prior = names.where("column_name < '3'").select("column_name", F.lit("prior").alias("semantic_type"), F.lit("approved").alias("status"), F.lit(3).alias("revision"))
    dec = names.where("column_name like '1%'").select("column_name", F.lit("decided").alias("semantic_type"))
    return C.merge_contract(cand, prior, dec)


@query("c10_table_role", "select n_name as table_name, case when regexp_matches(n_name, '(?i)^(region|nation|country|currency|category|status)s?$') then 'reference' when regexp_matches(n_name, '(?i)line_?item|_items?$') then 'line_item' when regexp_matches(n_name, '(?i)event|log|activity|session') then 'activity' when regexp_matches(n_name, '(?i)order|payment|transaction|invoice') then 'transaction' else 'entity' end as role from nation")
def c10(s, d):
    return C.table_role(t(s, d, "nation").select(F.col("n_name").alias("table_name")))


# --- D



def _band(c: str, table: str) -> str:
    e = f"(select list_sort(list_distinct(quantile_cont({c}::double, [0.25, 0.5, 0.75]))) from {table})"
    return f"case when {c} is null then '∅' else 'q' || len(list_filter({e}, lambda e: e < {c}::double)) end"


_DISC = f"(select l_orderkey, {_band('l_quantity', 'lineitem')} as l_quantity, coalesce(l_returnflag, '∅') as l_returnflag, {_band('l_extendedprice', 'lineitem')} as l_extendedprice, coalesce(l_linestatus, '∅') as l_linestatus from lineitem)"
_DCOLS = ["l_quantity", "l_returnflag", "l_extendedprice", "l_linestatus"]


@query("d01_discretize", f"select l_quantity, l_returnflag, count(*) as n from {_DISC} group by all")
def d01(s, d):
    return M.discretize(t(s, d, "lineitem"), ["l_quantity", "l_returnflag"]).groupBy("l_quantity", "l_returnflag").agg(F.count("*").alias("n"))


def _nmi(a: str, b: str, src: str) -> str:
    return f"""select case when least(ha, hb) > 1e-12 then round(greatest(0.0, least(1.0, mi / least(ha, hb))), 6) else 0.0 end as nmi, n as row_count from (
select sum(p * ln(p / (pa * pb))) as mi, -sum(p * ln(pa)) as ha, -sum(p * ln(pb)) as hb, max(t)::bigint as n from (
select c::double / t as p, sum(c) over (partition by a)::double / t as pa, sum(c) over (partition by b)::double / t as pb, t from (
select a, b, c, sum(c) over () as t from (select {a} as a, {b} as b, count(*) as c from {src} group by all))))"""


@query("d02_nmi", _nmi("l_quantity", "l_extendedprice", _DISC))
def d02(s, d):
    return M.nmi(M.discretize(t(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice")


_GRAPH = "\nunion all\n".join(f"select '{a}' as parent, '{b}' as child, x.* from ({_nmi(a, b, _DISC)}) x" for i, a in enumerate(_DCOLS) for b in _DCOLS[i + 1 :])


@query("d03_dependency_graph", f"with g as ({_GRAPH}) select child, arg_max(parent, nmi) as parent, max(nmi) as nmi from g where nmi > 0.01 and row_count >= 30 group by child")
def d03(s, d):
    return M.dependency_graph(t(s, d, "lineitem"), _DCOLS, least=0.01)


_CC = "with o as (select o_orderstatus as context, o_orderpriority as value, count(*) as n from orders group by all), a as (select * from o union all select '*', value, sum(n)::bigint from o group by value), w as (select *, sum(n) over (partition by context) as t from a) select context, value, round(n::double / t, 6) as probability from w where t >= 8"


@query("d04_conditional_categorical", _CC)
def d04(s, d):
    return M.conditional_categorical(t(s, d, "orders"), "o_orderpriority", ["o_orderstatus"])


@query("d05_conditional_numeric", "select l_returnflag || '|' || l_linestatus as context, count(*) as n, list_transform(quantile_cont(l_extendedprice, [i / 20.0::double for i in range(21)]), lambda x: round(x, 6)) as grid from lineitem group by 1 having count(*) >= 8")
def d05(s, d):
    return M.conditional_numeric(t(s, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


_XB = f"(select x.*, c.a, c.c_mktsegment as b from (select o_custkey, {_band('o_totalprice', 'orders')} as x, o_orderstatus as y from orders) x join (select c_custkey, {_band('c_acctbal', 'customer')} as a, c_mktsegment from customer) c on o_custkey = c_custkey)"
_XG = "\nunion all\n".join(f"select '{pn}' as parent, '{cn}' as child, z.* from ({_nmi(p, c, _XB)}) z" for p, pn in (("a", "c_acctbal"), ("b", "c_mktsegment")) for c, cn in (("x", "o_totalprice"), ("y", "o_orderstatus")))


@query("d06_cross_table_conditionals", f"with g as ({_XG}) select child, arg_max(parent, nmi) as parent, max(nmi) as nmi from g where nmi > 0 and row_count >= 8 group by child")
def d06(s, d):
    return M.cross_table_conditionals(t(s, d, "customer"), t(s, d, "orders"), "c_custkey", "o_custkey", ["c_acctbal", "c_mktsegment"], ["o_totalprice", "o_orderstatus"], least=0.0)


_ENC = "e as (select value, round((sum(w) over (order by w desc, value) - w) / sum(w) over (), 9) as lo, round(sum(w) over (order by w desc, value) / sum(w) over (), 9) as hi from (select case when n < {k} then '__RARE__' else p_brand end as value, sum(n)::double as w from (select p_brand, count(*) as n from part group by 1) group by 1))"


@query("d07_fit_encoder", f"with {_ENC.format(k=75)} select * from e")
def d07(s, d):
    return M.fit_encoder(t(s, d, "part"), "p_brand", 75)


@query("d07_encode", f"with {_ENC.format(k=75)} select p_partkey, round(lo + {uniform_sql('encode:p_brand', 'p_partkey')} * (hi - lo), 9) as p_brand_code from part join e on e.value = case when p_brand in (select value from e) then p_brand else '__RARE__' end")
def d07e(s, d):
    p = t(s, d, "part")
    return M.encode(p.select("p_partkey", "p_brand"), "p_brand", M.fit_encoder(p, "p_brand", 75), "p_partkey").select("p_partkey", "p_brand_code")


@query("d07_decode", f"with {_ENC.format(k=75)} select p_partkey, case when p_brand in (select value from e) then p_brand else '__RARE__' end as back from part")
def d07d(s, d):
    p = t(s, d, "part")
    e = M.fit_encoder(p, "p_brand", 75)
    return M.decode(M.encode(p.select("p_partkey", "p_brand"), "p_brand", e, "p_partkey"), "p_brand_code", e, "back").select("p_partkey", "back")


@query("d08_encode_number", "select o_orderkey, floor(epoch(o_orderdate))::double as day, o_totalprice::double as price, (o_orderstatus = 'F')::int::double as done from orders")
def d08(s, d):
    df = t(s, d, "orders").withColumn("f", F.col("o_orderstatus") == "F")
    return df.select("o_orderkey", M.encode_number("o_orderdate", df).alias("day"), M.encode_number("o_totalprice", df).alias("price"), M.encode_number("f", df).alias("done"))


_COPULA = ["l_quantity", "l_extendedprice", "l_discount"]


def _horner(cs, x: str) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _place_sql(c: str) -> str:
    """The place in (0, 1) of a value among 21 quantiles of its column."""
    below, upto = f"len(list_filter(g_{c}, lambda e: e < {c}))", f"len(list_filter(g_{c}, lambda e: e <= {c}))"
    lo, hi = f"g_{c}[greatest({below}, 1)]", f"g_{c}[least({below} + 1, 21)]"
    return f"least(greatest(case when {upto} - {below} > 1 then ({below} + {upto} - 1) / 40.0::double else ({below} - 1 + case when {hi} > {lo} then ({c} - {lo}) / ({hi} - {lo}) else 0 end) / 20.0::double end, 0.0005::double), 0.9995::double)"


def _score_sql(p: str) -> str:
    """The normal score of a place."""
    tail = lambda z: f"({_horner(M._C, z)} / ({_horner((*M._D, 1.0), z)}))"
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    mid = f"({_horner(M._A, f'({q} * {q})')} * {q} / {_horner((*M._B, 1.0), f'({q} * {q})')})"
    return f"case when {p} < 0.02425 then {tail(low)} when {p} > 1 - 0.02425 then -{tail(high)} else {mid} end"


_D09 = (
    f"with g as (select {', '.join(f'{c}::double as {c}, (select quantile_cont({c}::double, {[i / 20 for i in range(21)]}) from lineitem) as g_{c}' for c in _COPULA)} from lineitem),"
    f" p as (select {', '.join(f'{_place_sql(c)} as p{i}' for i, c in enumerate(_COPULA))} from g), z as (select {', '.join(f'{_score_sql(f"p{i}")} as z{i}' for i in range(3))} from p) "
    + " union all ".join(f"select '{a}' as column_a, '{b}' as column_b, {'1.0::double' if a == b else f'round(corr(z{i}, z{j}), 4)'} as correlation from z having count(*) > 0" for i, a in enumerate(_COPULA) for j, b in enumerate(_COPULA))
)


@query("d09_fit_copula", _D09)
def d09(s, d):
    m = M.fit_copula(t(s, d, "lineitem"), _COPULA)
    return s.createDataFrame([(a, b, round(m.correlation[i][j], 4)) for i, a in enumerate(m.columns) for j, b in enumerate(m.columns)], "column_a string, column_b string, correlation double")


@query("d10_rebalance", "with w as (select p_brand as value, 1.0 + length(p_brand) % 3 + ascii(p_brand[-1]) % 4 as w from part group by 1) select value, round((sum(w) over (order by w desc, value) - w) / sum(w) over (), 9)::double as lo, round(sum(w) over (order by w desc, value) / sum(w) over (), 9)::double as hi from w")
def d10(s, d):
    p = t(s, d, "part")
    w = p.select(F.col("p_brand").alias("value")).distinct().withColumn("w", (1.0 + F.char_length("value") % 3 + F.ascii(F.right("value", F.lit(1))) % 4).cast("double"))
    return M.rebalance(w, M.fit_encoder(p, "p_brand", 0))


@query("d11_category_proportions", f"with {_ENC.format(k=0)} select value, round(hi - lo, 6) as proportion from e")
def d11(s, d):
    return M.category_proportions(M.fit_encoder(t(s, d, "part"), "p_brand", 0))


_SEG = "(select c_mktsegment as v, row_number() over (order by count(*) desc, c_mktsegment) as i from customer group by 1)"


@query("d12_features", f"with m as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer) select c_custkey, round((c_acctbal - m) / s, 6) as z, (select i from {_SEG} where v = c_mktsegment)::bigint as hot from customer, m")
def d12(s, d):
    c = t(s, d, "customer")
    f = M.features(c, M.fit_features(c, ["c_acctbal"], ["c_mktsegment"]))
    return f.select("c_custkey", F.round(F.col("features")[0], 6).alias("z"), F.array_position(F.slice("features", 2, 99), 1.0).alias("hot"))


@query("g14_sample_copula")
def g14(s, d):
    m = M.fit_copula(nullified(t(s, d, "lineitem"), ["l_discount"], "l_orderkey"), ["l_quantity", "l_extendedprice", "l_discount"])
    return M.sample_copula(s, m, t(s, d, "lineitem").count())


@query("g14_normal_scores", f"select o_orderkey, round({normal_sql('z', 'o_orderkey')}, 9) as z from orders")
def g14z(s, d):
    from lookalike.functions.rng import normal

    return t(s, d, "orders").select("o_orderkey", F.round(normal("z", "o_orderkey"), 9).alias("z"))


