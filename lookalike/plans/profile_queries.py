"""Queries of the profiling operators (B) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookalike.functions.rng import uniform_sql
from lookalike.operators import profile as P
from lookalike.plans.registry import query
from lookalike.plans.util import COLUMNS, NUMERIC, nullified, nullified_sql, t, union_all

_BASE = "select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count, count(distinct {c}) as distinct_count, round((count(*) - count({c})) * 100.0::double / count(*), 6) as null_percentage, round(count(distinct {c})::double / count(*), 6) as distinct_ratio from {src}"


def _base_sql(table: str, src: str | None = None) -> str:
    return union_all(_BASE, COLUMNS[table], src=src or table)


_NULLED = ["o_orderpriority", "o_totalprice"]


@query("b01_profile_base", _base_sql("lineitem"))
def b01(s, d):
    return P.profile_base(t(s, d, "lineitem"))


@query("b01_profile_base_with_nulls", _base_sql("orders", nullified_sql("orders", _NULLED, "o_orderkey")))
def b01n(s, d):
    return P.profile_base(nullified(t(s, d, "orders"), _NULLED, "o_orderkey"))


_KINDS = {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime", "l_quantity": "f", "l_extendedprice": "f", "l_discount": "f", "l_tax": "f"}
_TYPES_SQL = "\nunion all\n".join(
    f"select '{c}' as column_name, case when count({c}) = 0 then 'unknown' " + (f"when bool_and({c} = round({c})) then 'integer' else 'float'" if _KINDS.get(c) == "f" else f"else '{_KINDS.get(c, 'integer')}'") + " end as inferred_dtype from lineitem"
    for c in COLUMNS["lineitem"]
)


@query("b02_physical_types", _TYPES_SQL)
def b02(s, d):
    return P.physical_types(t(s, d, "lineitem"))


_NUM = "select '{c}' as column_name, min({c})::double as minimum, max({c})::double as maximum, round(avg({c}), 6) as mean, round(quantile_cont({c}::double, 0.01), 6) as lower_bound, round(quantile_cont({c}::double, 0.25), 6) as p25, round(quantile_cont({c}::double, 0.5), 6) as median, round(quantile_cont({c}::double, 0.75), 6) as p75, round(quantile_cont({c}::double, 0.99), 6) as upper_bound from lineitem"


@query("b03_profile_numeric", union_all(_NUM, NUMERIC["lineitem"]))
def b03(s, d):
    return P.profile_numeric(t(s, d, "lineitem"))


@query("b04_generation_bounds", union_all("select '{c}' as column_name, round(quantile_cont({c}::double, 0.01), 6) as lower_bound, round(quantile_cont({c}::double, 0.99), 6) as upper_bound from lineitem", NUMERIC["lineitem"]))
def b04(s, d):
    return P.profile_numeric(t(s, d, "lineitem")).select("column_name", "lower_bound", "upper_bound")


@query("b05_datetime_bounds", "with r as (select o_orderdate as v, row_number() over (order by o_orderdate) - 1 as i, count(*) over () as n from orders) select 'o_orderdate' as column_name, min(v) filter (where i = floor(0.01::double * (n - 1))) as lower_bound, min(v) filter (where i = floor(0.99::double * (n - 1))) as upper_bound from r")
def b05(s, d):
    return P.datetime_bounds(t(s, d, "orders"))


@query("b06_profile_strings", union_all("select '{c}' as column_name, min(length({c}))::int as min_length, max(length({c}))::int as max_length, round(avg(length({c})), 6) as mean_length from part", ["p_name", "p_brand", "p_type"]))
def b06(s, d):
    return P.profile_strings(t(s, d, "part"))


def _as_text(df):
    u = P.uniform("text", "o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return df.select(F.when(u < 0.02, "N/A").when(u < 0.5, F.concat(F.lit("  "), day)).otherwise(day).alias("day"), F.col("o_orderpriority"))


_TEXT = f"(select case when {uniform_sql('text', 'o_orderkey')} < 0.02 then 'N/A' when {uniform_sql('text', 'o_orderkey')} < 0.5 then '  ' || strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y-%m-%d') end as day, o_orderpriority from orders)"


@query("b07_date_parse_rate", f"with x as (select count(try_strptime(trim(day), '%Y-%m-%d'))::double / count(*) as r from {_TEXT}) select 'day' as column_name, round(r, 6) as parse_rate, r < 1 as invalid_dates from x union all select 'o_orderpriority', null, false")
def b07(s, d):
    return P.date_parse_rate(_as_text(t(s, d, "orders")))


@query("b37_datetime_format", f"with x as (select count(try_strptime(trim(day), '%Y-%m-%d'))::double / count(*) as r from {_TEXT}) select 'day' as column_name, 'yyyy-MM-dd' as format, round(r, 6) as rate, true as date_like from x union all select 'o_orderpriority', null, 0.0, false")
def b37(s, d):
    return P.datetime_format(_as_text(t(s, d, "orders")))


_CATS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_quantity", "l_partkey"]
_FREQ = "with f as (" + union_all("select '{c}' as column_name, cast({c} as varchar) as value, count(*) as n from lineitem where {c} is not null group by {c}", _CATS) + "), k as (select column_name from f group by 1 having count(*) <= 50) select f.* from f join k using (column_name)"


@query("b08_category_frequencies", _FREQ)
def b08(s, d):
    return P.category_frequencies(t(s, d, "lineitem"), _CATS)


@query("b09_suppress_rare", "with f as (" + union_all("select '{c}' as column_name, {c} as value, count(*) as n from part group by {c}", ["p_type", "p_brand"]) + "), k as (select column_name from f group by 1 having count(*) <= 50) select column_name, case when n < 90 then '__RARE__' else value end as value, sum(n)::bigint as n from f join k using (column_name) group by all")
def b09(s, d):
    return P.suppress_rare(P.category_frequencies(t(s, d, "part"), ["p_type", "p_brand"]), 90)


_WARN_COLS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]


def _warn_df(s, d):
    return nullified(t(s, d, "orders").select(*_WARN_COLS, F.lit("x").alias("fixed")), ["o_orderpriority"], "o_orderkey", 0.6)


@query(
    "b10_column_warnings",
    f"with o as (select * exclude (o_custkey, o_orderdate), 'x' as fixed from {nullified_sql('orders', ['o_orderpriority'], 'o_orderkey', 0.6)}), b as ({union_all(_BASE, [*_WARN_COLS, 'fixed'], src='o')}), f as ("
    + union_all("select '{c}' as column_name, max(n) as top, count(*) as k from (select count(*) as n from o where {c} is not null group by {c})", ["o_orderstatus", "o_orderpriority", "fixed"])
    + ") select column_name, concat_ws(',', case when null_count < row_count and distinct_count <= 1 then 'constant_column' end, case when distinct_count > 1 and distinct_ratio >= 0.95 then 'near_unique_column' end, case when null_percentage >= 50 then 'extreme_missingness' end, case when distinct_count > 1 and k <= 50 and top / row_count >= 0.95 then 'severe_category_imbalance' end) as warnings from b left join f using (column_name)",
)
def b10(s, d):
    df = _warn_df(s, d)
    return P.column_warnings(P.profile_base(df), P.category_frequencies(df, ["o_orderstatus", "o_orderpriority", "fixed"]))


@query("b11_mask_examples", "with v as (" + union_all("select distinct '{c}' as column_name, {c} as v from customer", ["c_name", "c_mktsegment"]) + ") select column_name, cast(place as int) as place, case when length(v) <= 2 then repeat('*', length(v)) else v[1] || repeat('*', length(v) - 2) || v[-1] end as example from (select *, row_number() over (partition by column_name order by v) as place from v) where place <= 3")
def b11(s, d):
    return P.mask_examples(t(s, d, "customer"), ["c_name", "c_mktsegment"])


_PAIRS = [(a, b) for i, a in enumerate(NUMERIC["lineitem"]) for b in NUMERIC["lineitem"][i + 1 :]]
_CORR = "select * from (" + "\nunion all\n".join(f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}::double, {b}::double), 6) as correlation from lineitem" for a, b in _PAIRS) + ") where correlation is not null and not isnan(correlation)"


@query("b12_correlations", _CORR)
def b12(s, d):
    return P.correlations(t(s, d, "lineitem"))


@query("b15_top_correlations", f"select * from ({_CORR}) order by abs(correlation) desc, column_a, column_b limit 20")
def b15(s, d):
    return P.top_correlations(t(s, d, "lineitem"))


@query("b13_pk_cross_check", "with g as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all) select sum(n)::bigint as row_count, 0::bigint as null_keys, sum(n - 1)::bigint as duplicate_keys from g")
def b13(s, d):
    return P.pk_cross_check(t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_PARTS = ["user_id", "value"]


@query("b14_merge_profiles", union_all("select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count, min({c})::double as minimum, max({c})::double as maximum, round(sum({c})::double / count({c}), 4) as mean from events", _PARTS))
def b14(s, d):
    return P.merge_profiles(P.partial_profiles(t(s, d, "events"), F.to_date("ts"), _PARTS)).drop("distinct_estimate")


@query("b16_missingness", f"with b as ({_base_sql('orders', nullified_sql('orders', _NULLED, 'o_orderkey'))}) select count(*) filter (where null_count > 0) as columns_with_nulls, round(avg(null_percentage), 6) as avg_null_percentage, max(null_percentage) as max_null_percentage from b")
def b16(s, d):
    return P.missingness(P.profile_base(nullified(t(s, d, "orders"), _NULLED, "o_orderkey")))


_FIT = """select '{c}' as column_name, case when mn > 0 and skew > 1 then 'lognormal' when sd < 0.01 then 'uniform' else 'normal' end as distribution, round(mn, 4) as minimum, round(mx, 4) as maximum,
round(case when mn > 0 and skew > 1 then mu else m end, 4) as location, round(case when mn > 0 and skew > 1 then sigma else sd end, 4) as scale
from (select min({c})::double as mn, max({c})::double as mx, avg({c}) as m, stddev_samp({c}) as sd, skewness({c}) as skew, avg(ln({c})) filter (where {c} > 0) as mu, stddev_samp(ln({c})) filter (where {c} > 0) as sigma from lineitem)"""
_FITTED = ["l_quantity", "l_extendedprice", "l_discount"]


@query("b17_fit_numeric", union_all(_FIT, _FITTED))
def b17(s, d):
    return P.fit_numeric(t(s, d, "lineitem"), _FITTED)


@query("b18_infer_decimals", "with s as (select *, md5(concat_ws('|', '42', cast(o_orderkey as varchar))) as h from orders order by h, o_orderkey limit 100) select 'o_totalprice' as column_name, cast(quantile_cont(length(regexp_replace(split_part(printf('%.6f', o_totalprice), '.', 2), '0+$', '')), 0.5) as int) as decimals from s")
def b18(s, d):
    return P.infer_decimals(t(s, d, "orders"), ["o_totalprice"], ["o_orderkey"])


@query("b19_fit_categorical", "with f as (" + union_all("select '{c}' as column_name, {c} as value, count(*) as n from part group by {c}", ["p_type", "p_brand", "p_name"]) + "), r as (select *, row_number() over (partition by column_name order by n desc, value) as place from f) select column_name, value, round(n::double / sum(n) over (partition by column_name), 6) as probability from r where place <= 50")
def b19(s, d):
    return P.fit_categorical(t(s, d, "part"), ["p_type", "p_brand", "p_name"])


@query("b20_fit_date", "select 'o_orderdate' as column_name, floor(epoch(min(o_orderdate)))::double as first, floor(epoch(max(o_orderdate)))::double as last, quantile_cont(floor(epoch(o_orderdate))::double, 0.5) as median from orders")
def b20(s, d):
    return P.fit_date(t(s, d, "orders"))


_KIND_SQL = {
    "o_orderkey": "any_value('id_like')", "o_custkey": "any_value('id_like')", "o_orderdate": "any_value('date')",
    "o_totalprice": "case when bool_and(o_totalprice = round(o_totalprice)) and count(distinct o_totalprice) <= 10 then 'categorical' else 'numeric' end",
    "o_orderstatus": "case when count(distinct o_orderstatus) <= 50 or round(count(distinct o_orderstatus)::double / count(*), 6) <= 0.05 then 'categorical' else 'text' end",
    "o_orderpriority": "case when count(distinct o_orderpriority) <= 50 or round(count(distinct o_orderpriority)::double / count(*), 6) <= 0.05 then 'categorical' else 'text' end",
}


@query("b21_column_kind", "\nunion all\n".join(f"select '{c}' as column_name, {e} as kind from orders" for c, e in _KIND_SQL.items()))
def b21(s, d):
    return P.column_kind(t(s, d, "orders"))


@query("b22_is_identifier", union_all("select '{c}' as column_name, regexp_matches('{c}', '(^|_)(id|uuid|guid)$|key$') or (count(distinct {c})::double / count(*) >= 0.95 and typeof(any_value({c})) in ('INTEGER', 'BIGINT')) as is_identifier from customer", [c for c in COLUMNS["customer"] if c != "c_acctbal"]) + "\nunion all select 'c_acctbal', bool_and(c_acctbal = round(c_acctbal)) and count(distinct c_acctbal)::double / count(*) >= 0.95 from customer")
def b22(s, d):
    return P.is_identifier(t(s, d, "customer"))


@query("b23_text_heavy", union_all("select '{c}' as column_name, regexp_matches('{c}', 'description|comment|note|bio|summary|text') or coalesce(avg(length({c})) >= 40 or (avg(length({c})) >= 20 and count(distinct {c})::double / count(*) >= 0.8), false) as text_heavy from documents", ["text", "lang", "source"]))
def b23(s, d):
    return P.is_text_heavy(t(s, d, "documents"))


_PEOPLE = "(select c_name, lower(replace(c_name, '#', '.')) || '@example.com' as contact, printf('+1 555 %07d', c_custkey) as line from customer)"


def _people(s, d):
    return t(s, d, "customer").select("c_name", F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("contact"), F.format_string("+1 555 %07d", "c_custkey").alias("line"))


def _pii_case(c: str) -> str:
    by = " ".join(f"when count({c}) filter (where regexp_matches({c}, '{p}')) >= 0.8 * count({c}) then '{k}'" for k, p in P.PII_VALUES.items())
    return f"case {by} end"


@query("b24_pii_semantic", "select column_name, by_name, by_value, coalesce(by_name, by_value) as semantic from (" + "\nunion all\n".join(f"select '{c}' as column_name, {n} as by_name, {_pii_case(c)} as by_value from {_PEOPLE}" for c, n in (("c_name", "'name'"), ("contact", "null"), ("line", "null"))) + ")")
def b24(s, d):
    return P.pii_semantic(_people(s, d))


@query("b25_text_semantic", "select 'url' as column_name, 'url' as role union all select 'html', case when count(html) filter (where regexp_matches(html, '^https?://')) >= 0.8 * count(html) then 'url' else 'generic' end from pages")
def b25(s, d):
    return P.text_semantic(t(s, d, "pages"))


@query("b26_quantile_grid", union_all("select '{c}' as column_name, cast(unnest(range(21)) as int) as step, round(unnest(quantile_cont({c}::double, [i / 20.0::double for i in range(21)])), 6) as value from lineitem", ["l_quantity", "l_extendedprice"]) + "\nunion all select 'l_shipdate', cast(unnest(range(21)) as int), round(unnest(quantile_cont(floor(epoch(l_shipdate))::double, [i / 20.0::double for i in range(21)])), 6) from lineitem")
def b26(s, d):
    return P.quantile_grid(t(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_shipdate"])


@query("b27_classify_sensitivity", f"select 'c_name' as column_name, 'name' as semantic, 'direct_identifier' as sensitivity union all select 'contact', {_pii_case('contact')}, case when {_pii_case('contact')} is null then 'public' else 'direct_identifier' end from {_PEOPLE} union all select 'line', {_pii_case('line')}, case when {_pii_case('line')} is null then 'public' else 'direct_identifier' end from {_PEOPLE}")
def b27(s, d):
    return P.classify_sensitivity(_people(s, d))


_CARD = "with n as (select o_custkey as k, count(*) as n from orders group by 1), h as (select c_mktsegment as context, coalesce(n, 0)::bigint as n_children, count(*) as parents from customer left join n on k = c_custkey group by all) select *, round(parents::double / sum(parents) over (partition by context), 6) as probability from h"


@query("b28_cardinality_model", _CARD)
def b28(s, d):
    return P.cardinality_model(t(s, d, "customer"), t(s, d, "orders"), "c_custkey", "o_custkey", "c_mktsegment")


FKS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_orderkey", "customer", "c_custkey")]


@query("b29_parent_child_ratios", "\nunion all\n".join(f"select '{c}' as child, '{p}' as parent, round((select count(*) from {c})::double / (select count(*) from {p}), 6) as ratio" for c, _, p, _ in FKS[:-1]))
def b29(s, d):
    from lookalike.sources.io import row_counts

    names = sorted({x for f in FKS for x in (f[0], f[2])})
    n = row_counts({x: t(s, d, x) for x in names})
    edges = s.createDataFrame([(c, p) for c, _, p, _ in FKS[:-1]], "child string, parent string")
    j = edges.join(n.select(F.col("table_name").alias("child"), F.col("row_count").alias("a")), "child").join(n.select(F.col("table_name").alias("parent"), F.col("row_count").alias("b")), "parent")
    return j.select("child", "parent", F.round(F.col("a") / F.col("b"), 6).alias("ratio"))


_FK_SQL = "select child, child_column, parent, parent_column, round(pr, 6) as parent_ratio, round(ct, 6) as containment, pr >= 0.95 and ct >= 1 as is_fk from (" + "\nunion all\n".join(f"select '{c}' as child, '{cc}' as child_column, '{p}' as parent, '{pc}' as parent_column, (select count(distinct {pc})::double / count(*) from {p}) as pr, (select count(*) filter (where {cc} in (select {pc} from {p}))::double / count(*) from {c} where {cc} is not null) as ct" for c, cc, p, pc in FKS) + ")"


@query("b30_infer_fks", _FK_SQL)
def b30(s, d):
    return P.infer_fks({x: t(s, d, x) for x in {y for f in FKS for y in (f[0], f[2])}}, FKS)


@query("b32_fingerprint", "select count(*) as row_count, cast(sum(('0x' || substr(md5(concat_ws('|', length(o_orderkey::varchar) || ':' || o_orderkey::varchar, length(o_custkey::varchar) || ':' || o_custkey::varchar, length(o_orderstatus::varchar) || ':' || o_orderstatus::varchar, length(o_orderpriority::varchar) || ':' || o_orderpriority::varchar)), 1, 12))::hugeint) as varchar) as fingerprint from orders")
def b32(s, d):
    return P.fingerprint(t(s, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("b33_sanitize_profile", "select 'o_orderstatus' as column_name, null::double as minimum, null::double as maximum, null as value, null::bigint as n from (select distinct o_orderstatus from orders) union all select 'o_orderpriority', null, null, o_orderpriority, count(*) from orders group by o_orderpriority")
def b33(s, d):
    f = P.category_frequencies(t(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]).withColumns({"minimum": F.lit(1.0), "maximum": F.lit(2.0)})
    return P.sanitize_profile(f, ["o_orderstatus"]).select("column_name", "minimum", "maximum", "value", "n")


@query("b34_table_report", f"with b as ({_base_sql('lineitem')}), k as ({_TYPES_SQL}) select column_name, inferred_dtype, null_percentage, concat_ws(',', case when null_percentage > 20 then 'many_nulls' end, case when distinct_count <= 1 then 'constant' end, case when distinct_ratio < 1 and regexp_matches(column_name, 'key$') then 'repeated_key' end) as notes, (case when null_percentage > 20 then 10 else 0 end + case when distinct_count <= 1 then 5 else 0 end + case when distinct_ratio < 1 and regexp_matches(column_name, 'key$') then 8 else 0 end)::int as deduction from b join k using (column_name)")
def b34(s, d):
    return P.table_report(t(s, d, "lineitem"))


@query("b21_sampled_kind", f"select case when count(*) > 0 then 'n_nationkey' end as column_name, 'id_like' as kind from nation where {uniform_sql('kind', 'n_nationkey')} < 0.9 union all select 'n_name', 'categorical' from (select 1) union all select 'n_regionkey', 'id_like'")
def b21s(s, d):
    return P.sampled_kind(t(s, d, "nation"), "n_nationkey", 0.9)
