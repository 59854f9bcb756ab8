"""Queries of masking and disclosure control (F) with their SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from lookalike.functions.noise import geometric_noise_sql
from lookalike.functions.rng import SEED, pick_sql, uniform, uniform_sql
from lookalike.operators import models as M
from lookalike.operators import privacy as V
from lookalike.operators import profile as P
from lookalike.plans.registry import query
from lookalike.plans.util import halves, halves_sql, t, thirds

_OF = ("customer", "supplier", "part", "orders", "nation")


def _case(rules, name: str) -> str:
    return "case " + " ".join(f"when regexp_matches({name}, '{p}') then '{k}'" for k, p in rules) + " else 'none' end"


@query("f01_context_kind", " union all ".join(f"select '{n}' as table_name, column_name, {_case(V.KIND_NAMES, 'column_name')} as kind, (select count(*) from {n}) as values from (describe {n})" for n in _OF))
def f01(s, d):
    """The kinds of the columns that the tables have, with the number of values each masks."""
    parts = []
    for n in _OF:
        df = t(s, d, n)
        kinds = V.context_kind(s.createDataFrame([(c, "x") for c in df.columns], "column_name string, semantic_type string"))
        parts.append(kinds.crossJoin(df.agg(F.count("*").alias("values"))).select(F.lit(n).alias("table_name"), "column_name", "kind", "values"))
    return reduce(type(parts[0]).unionByName, parts)


def _m(lane: str, col: str = "c_name", c: str = "c_name") -> str:
    return uniform_sql(f"mask:customer.{col}:{lane}", c)


_NAME = f"{pick_sql(V.FIRST, _m('first'))} || ' ' || {pick_sql(V.LAST, _m('last'))}"


@query("f02_mask_table", f"select c_custkey, {_NAME} as c_name, {pick_sql(V.CITY, uniform_sql('mask:customer.c_mktsegment:city', 'c_mktsegment'))} as c_mktsegment from customer")
def f02(s, d):
    return V.mask_table(t(s, d, "customer"), "customer", {"c_name": "full_name", "c_mktsegment": "city"}).select("c_custkey", "c_name", "c_mktsegment")


@query("f02_mask_kinds", f"select c_custkey, '+1-555-' || lpad(cast(floor({_m('phone', 'phone')} * 10000000) as bigint)::varchar, 7, '0') as phone, cast(floor({_m('no', 'street')} * 999) + 1 as bigint)::varchar || ' ' || {pick_sql(V.LAST, _m('street', 'street'))} || ' Street' as street, {pick_sql(V.COMPANY, _m('company', 'company'))} as company from customer")
def f02k(s, d):
    c = F.col("c_name")
    return t(s, d, "customer").select("c_custkey", *[V.mask_value(c, "customer", k, k).alias(k) for k in ("phone", "street", "company")])


@query("f03_mask_email", f"select c_custkey, regexp_replace(lower({_NAME}), '[^a-z0-9]+', '.', 'g') || '@example.com' as email from customer")
def f03(s, d):
    df = V.mask_table(t(s, d, "customer").withColumn("email", F.lit("x@y.z")), "customer", {"c_name": "full_name"})
    return V.mask_email(df, "email", "c_name").select("c_custkey", "email")


@query("f04_mask_identifier", f"select o_orderkey, 'CUST-' || lpad(cast(floor({uniform_sql('mask:orders.o_custkey:id', 'o_custkey')} * 10000000000) as bigint)::varchar, 10, '0') as o_custkey from orders")
def f04(s, d):
    return V.mask_table(t(s, d, "orders"), "orders", {"o_custkey": "identifier"}).select("o_orderkey", "o_custkey")


@query("f05_unchanged_share", f"select 'c_name' as column_name, round(avg(({_NAME} = c_name)::int), 6) as unchanged from customer union all select 'c_mktsegment', 1.0 from (select 1)")
def f05(s, d):
    c = t(s, d, "customer")
    return V.unchanged_share(c, V.mask_table(c, "customer", {"c_name": "full_name"}), ["c_custkey"], ["c_name", "c_mktsegment"])


@query("f06_leak_scan", r"with f as (select distinct v from (select split_part(replace(text, chr(10), ' '), '.', 1) as v from benchmark) where length(trim(v)) >= 3), d as (select doc_id, regexp_replace(trim(text), '\s+', ' ', 'g') as body from documents) select doc_id as id, trim(v) as value from d, f where contains(body, regexp_replace(trim(v), '\s+', ' ', 'g'))")
def f06(s, d):
    items = t(s, d, "benchmark").select(F.split_part(F.regexp_replace("text", "\n", " "), F.lit("."), F.lit(1)).alias("v"))
    return V.leak_scan(t(s, d, "documents"), "text", "doc_id", items, "v")


@query("f07_replace_rare", "with n as (select p_brand, count(*) as n from part group by 1) select p_partkey, case when n < 75 then '__RARE__' else p_brand end as p_brand from part join n using (p_brand)")
def f07(s, d):
    return V.replace_rare(t(s, d, "part"), "p_brand", 75).select("p_partkey", "p_brand")


@query("f08_learn_id_format", "select 0 as position, 'literal' as kind, 'Customer' as literal, 8 as width, null::bigint as start_at union all select 1, 'numeric', null, max(length(split_part(c_name, '#', 2)))::int, min(split_part(c_name, '#', 2)::bigint) from customer")
def f08(s, d):
    return V.learn_id_format(t(s, d, "customer"), "c_name")


@query("f09_generate_ids", "select i as id, 'Customer#' || lpad(i::varchar, 9, '0') as identifier from range((select count(*) from customer)) r(i)")
def f09(s, d):
    return V.generate_ids(s, t(s, d, "customer").count(), [("literal", "Customer", 8), ("numeric", None, 9)], "#")


@query("f10_redact_profile", "select 'p_brand' as column_name, 'CATEGORY_' || lpad(row_number() over (order by p_brand)::varchar, 4, '0') as value, count(*) as n from part group by p_brand")
def f10(s, d):
    f = P.category_frequencies(t(s, d, "part"), ["p_brand", "p_type"], 10_000)
    return V.redact_profile(f, s.createDataFrame([("p_brand", "bucket"), ("p_type", "exclude")], "column_name string, action string"))


@query("f11_privacy_policy", "select 'c_mktsegment' as column_name, case when count(distinct c_mktsegment) <= 10 then 'suppress' else 'bucket' end as action from customer union all select 'c_nationkey', case when count(distinct c_nationkey) <= 10 then 'suppress' else 'bucket' end from customer union all select 'c_name', 'transform' from (select 1) union all select 'c_acctbal', 'preserve' from (select 1) union all select 'c_custkey', 'preserve' from (select 1)")
def f11(s, d):
    c = t(s, d, "customer")
    return V.privacy_policy(P.classify_sensitivity(c).join(P.profile_base(c), "column_name"))


@query("f12_verify_source_free", "select 'p_type' as column_name, p_type as value from (select distinct p_type from part)")
def f12(s, d):
    p = t(s, d, "part")
    f = P.category_frequencies(p, ["p_brand", "p_type"], 10_000)
    done = V.redact_profile(f, s.createDataFrame([("p_brand", "bucket"), ("p_type", "preserve")], "column_name string, action string"))
    return V.verify_source_free(done, p, ["p_brand", "p_type"])


_HN = geometric_noise_sql("dp:l_returnflag", "value", 2.0, SEED)


@query("f13_dp_histogram", f"select value, n + {_HN} as noisy from (select l_returnflag as value, count(*) as n from lineitem group by 1 union all select 'Z', 0) where n + {_HN} >= 5")
def f13(s, d):
    return V.dp_histogram(t(s, d, "lineitem"), "l_returnflag", 0.5, 5, domain=["A", "N", "R", "Z"], secret=SEED)


_DM, _DV = (geometric_noise_sql("dp:o_totalprice", f"'{n}'", 2.0 * w, SEED) for n, w in (("mean", V.UNITS), ("var", V.UNITS**2)))


@query("f14_dp_mean_var", f"with c as (select floor((least(greatest(o_totalprice, 0.0::double), 500000.0::double)) / {500000 / V.UNITS!r}::double + 0.5)::hugeint as v from orders), s as (select count(*) as n, sum(v) as s, sum(v * v) as q from c), m as (select (s + {_DM})::double / n as m, (q + {_DV})::double / n as q from s) select round(m * {500000 / V.UNITS!r}::double, 6) as dp_mean, round(greatest(q - m * m, 0.0) * {(500000 / V.UNITS) ** 2!r}::double, 4) as dp_variance from m")
def f14(s, d):
    return V.dp_mean_var(t(s, d, "orders"), "o_totalprice", 0.0, 500000.0, 1.0, secret=SEED)


_BOUNDS = {"l_quantity": (0.0, 50.0), "l_extendedprice": (0.0, 100000.0), "l_discount": (0.0, 0.1)}


_ZS = [f"(({c} - {(lo + hi) / 2!r}::double) / {(hi - lo) / math.sqrt(12)!r}::double)" for c, (lo, hi) in _BOUNDS.items()]
_PAIRS = [(i, j) for i in range(len(_ZS)) for j in range(i + 1)]


@query(
    "f15_second_moments",
    f"""with z as (select {', '.join(f'{z} as z{i}' for i, z in enumerate(_ZS))} from lineitem where {' and '.join(f'{c} is not null' for c in _BOUNDS)}),
s as (select *, least(1.0, {V.CLIP}::double / greatest(sqrt({' + '.join(['0.0::double'] + [f'z{i} * z{i}' for i in range(len(_ZS))])}), 1e-9)) as scale from z),
w as (select {', '.join(f'floor(z{i} * scale * {V.MOMENT_UNITS} + 0.5)::hugeint as w{i}' for i in range(len(_ZS)))} from s)
"""
    + "\nunion all\n".join(f"select '{list(_BOUNDS)[i]}' as column_a, '{list(_BOUNDS)[j]}' as column_b, count(*) as n, sum(w{i} * w{j})::double as moment from w" for i, j in _PAIRS),
)
def f15_moments(s, d):
    sums, names = V.second_moments(t(s, d, "lineitem"), list(_BOUNDS), _BOUNDS), list(_BOUNDS)
    rows = F.array(*[F.struct(F.lit(names[i]).alias("column_a"), F.lit(names[j]).alias("column_b"), F.col("n"), F.col(f"s{i}_{j}").cast("double").alias("moment")) for i, j in _PAIRS])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


@query("f15_dp_correlation")
def f15(s, d):
    m = V.dp_correlation(t(s, d, "lineitem"), list(_BOUNDS), _BOUNDS, 1.0, secret=SEED)
    return s.createDataFrame([(a, b, m[i][j]) for i, a in enumerate(_BOUNDS) for j, b in enumerate(_BOUNDS)], "column_a string, column_b string, correlation double")


@query("f16_ledger", "with l as (select user_id, event_id as step, 0.001::double * (1 + event_id % 3) as epsilon from events), r as (select *, round(sum(epsilon) over (partition by user_id order by step), 9) as spent from l) select user_id, step, spent as spent_epsilon, spent <= 0.05 as allowed from r")
def f16(s, d):
    spends = t(s, d, "events").select("user_id", F.col("event_id").alias("step"), (F.lit(0.001) * (1 + F.col("event_id") % 3)).alias("epsilon"), F.lit(0.0).alias("delta"), F.lit("count").alias("purpose"))
    return V.ledger(spends, 0.05, 1e-6, ["user_id"]).select("user_id", "step", "spent_epsilon", "allowed")


@query("f17_fit_dp_copula")
def f17(s, d):
    df = t(s, d, "lineitem")
    return M.sample_copula(s, V.fit_dp_copula(df, list(_BOUNDS), _BOUNDS, 2.0, secret=SEED), df.count(), "dp")


@query("f18_k_anonymity", "with g as (select c_nationkey, c_mktsegment, count(*) as n from customer group by all) select min(n) as k, round(sum((n = 1)::int)::double / sum(n), 6) as singled_out, count(*) as groups from g")
def f18(s, d):
    return V.k_anonymity(t(s, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("f19_exact_match_rate", f"with {halves_sql('orders', 'o_orderkey')}, k as (select distinct o_orderstatus, o_orderpriority, o_custkey from src) select count(*) as row_count, count(*) filter (where (o_orderstatus, o_orderpriority, o_custkey) in (select (o_orderstatus, o_orderpriority, o_custkey) from k)) as matches, round(count(*) filter (where (o_orderstatus, o_orderpriority, o_custkey) in (select (o_orderstatus, o_orderpriority, o_custkey) from k))::double / count(*), 6) as rate from syn")
def f19(s, d):
    return V.exact_match_rate(*halves(t(s, d, "orders"), "o_orderkey"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("f20_pii_replay", f"with {halves_sql('customer', 'c_custkey')} select 'c_name' as column_name, count(*) filter (where lower(c_name) in (select lower(c_name) from src)) as replays from syn union all select 'c_mktsegment', count(*) filter (where lower(c_mktsegment) in (select lower(c_mktsegment) from src)) from syn")
def f20(s, d):
    return V.pii_replay(*halves(t(s, d, "customer"), "c_custkey"), ["c_name", "c_mktsegment"])


def _fresh(attempt):
    return F.concat(F.lit("Customer#9"), F.lpad(F.floor(uniform(f"fresh{attempt}", "c_custkey") * 1e8).cast("long").cast("string"), 8, "0"))


@query("f21_scrub_replays", f"select c_custkey, case when {uniform_sql('split', 'c_custkey')} < 0.5 then 'Customer#9' || lpad(cast(floor({uniform_sql('fresh1', 'c_custkey')} * 1e8) as bigint)::varchar, 8, '0') else c_name end as c_name from customer")
def f21(s, d):
    c = t(s, d, "customer")
    src, _ = halves(c, "c_custkey")
    return V.scrub_replays(c.select("c_custkey", "c_name"), src.select("c_name"), "c_name", "c_custkey", _fresh)


@query("f22_uniqueness", "select 'o_orderkey' as column_name, count(o_orderkey) - count(distinct o_orderkey) as duplicate_values from orders union all select 'o_custkey', count(o_custkey) - count(distinct o_custkey) from orders")
def f22(s, d):
    return V.uniqueness(t(s, d, "orders"), ["o_orderkey", "o_custkey"])


_THIRD = uniform_sql("three", "vec_id")
_NEAR = f"a as (select vec_id, embedding::double[] as v, {_THIRD} as u from embeddings), tr as (select * from a where u < 1.0::double / 3), ho as (select * from a where u >= 1.0::double / 3 and u < 2.0::double / 3), sy as (select * from a where u >= 2.0::double / 3)"


def _near(q: str, b: str) -> str:
    return f"(select q.vec_id, min(list_distance(q.v, b.v)) as d from {q} q, {b} b group by 1)"


@query("f23_dcr", f"with {_NEAR}, s as {_near('sy', 'tr')}, h as {_near('ho', 'tr')}, f as (select quantile_cont(d, 0.01) as floor, quantile_cont(d, 0.5) as mh from h) select round(avg((d < floor)::int), 6) as near_duplicate_share, round(quantile_cont(d, 0.5) / max(mh), 4) as median_ratio from s, f")
def f23(s, d):
    train, holdout, syn = thirds(t(s, d, "embeddings"), "vec_id")
    return V.dcr(syn, train, holdout, "embedding", "vec_id")


@query("f24_mia_auc", f"with {_NEAR}, m as {_near('tr', 'sy')}, h as {_near('ho', 'sy')} select round(sum(case when round(m.d, 6) < round(h.d, 6) then 1.0 when round(m.d, 6) = round(h.d, 6) then 0.5 else 0 end)::double / count(*), 6) as auc from m, h")
def f24(s, d):
    train, holdout, syn = thirds(t(s, d, "embeddings"), "vec_id")
    return V.mia_auc(syn, train, holdout, "embedding", "vec_id")
