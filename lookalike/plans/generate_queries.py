"""Queries of generation (G-01..G-46) with their SQL.  Row ids are keys of the given tables, so
generated tables grow with them."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import functions as F

from lookalike.functions.checks import valid
from lookalike.functions.rng import big_sql, normal_sql, pick_sql, uniform, uniform_sql, weighted_sql
from lookalike.operators import generate as G
from lookalike.operators import models as M
from lookalike.operators import privacy as V
from lookalike.operators import profile as P
from lookalike.plans.registry import query
from lookalike.plans.util import t


def ids(s, d):
    return t(s, d, "orders").select(F.col("o_orderkey").alias("row_id"))


_IDS = "(select o_orderkey as row_id from orders)"
U = lambda lane, key="row_id": uniform_sql(lane, key)
Z = lambda lane, key="row_id": normal_sql(lane, key)


def _cuts(ps: list[float]) -> str:
    total, said = 0.0, []
    for p in ps:
        total += p
        said.append(repr(total))
    return "[" + ", ".join(said) + "]"


def _poisson(lam: float) -> str:
    out, p = [], math.exp(-lam)
    for k in range(int(lam + 10 * math.sqrt(lam) + 10)):
        out.append(p)
        p *= lam / (k + 1)
    return _cuts(out)


@query("g01_integers", f"select row_id, row_id + 5 as seq, cast(floor(10 + {U('u')} * (21 - 10)) as bigint) as uni, cast(trunc(least(greatest(50.0 + 10.0 * {Z('n')}, 20.0), 80.0)) as bigint) as nor, cast(trunc(1.0 * pow(1 - {U('p')}, -1.0 / 2.0)) as bigint) as par, len(list_filter({_poisson(3.0)}, lambda c: c <= {U('po')}))::bigint as poi, len(list_filter({_cuts([math.comb(5, k) * 0.3**k * 0.7 ** (5 - k) for k in range(5)])}, lambda c: c <= {U('bi')}))::bigint as bin, cast({weighted_sql([1, 5, 9], [1, 2, 1], U('ch'))} as bigint) as cho from {_IDS}")
def g01(s, d):
    g = G.gen_int
    return ids(s, d).select("row_id", g({"distribution": "sequence", "start": 5}, "").alias("seq"), g({"min": 10, "max": 20}, "u").alias("uni"), g({"distribution": "normal", "mean": 50.0, "std": 10.0, "min": 20, "max": 80}, "n").alias("nor"), g({"distribution": "pareto", "alpha": 2.0}, "p").alias("par"), g({"distribution": "poisson", "lam": 3.0}, "po").alias("poi"), g({"distribution": "binomial", "n": 5, "p": 0.3}, "bi").alias("bin"), g({"distribution": "choices", "choices": [1, 5, 9], "weights": [1, 2, 1]}, "ch").alias("cho"))


_SG = math.sqrt(math.log(1 + 0.25))
_MU = math.log(100) - _SG**2 / 2


@query("g02_floats", f"select row_id, round(1 + {U('u')} * (2 - 1), 4) as uni, round(exp({_MU!r} + {_SG!r} * {Z('l')}), 2) as lgn, round(-5.0 * ln(1 - {U('e')}), 4) as expo, round(0 + list_sort([{U('b:0')}, {U('b:1')}, {U('b:2')}])[2] * (10 - 0), 4) as beta from {_IDS}")
def g02(s, d):
    g = G.gen_float
    return ids(s, d).select("row_id", g({"min": 1, "max": 2, "decimals": 4}, "u").alias("uni"), g({"distribution": "lognormal", "mean": 100, "std": 50}, "l").alias("lgn"), g({"distribution": "exponential", "scale": 5.0, "decimals": 4}, "e").alias("expo"), g({"distribution": "beta", "a": 2, "b": 2, "min": 0, "max": 10, "decimals": 4}, "b").alias("beta"))


@query("g03_booleans", f"select row_id, {U('b')} < 0.3 as flag from {_IDS}")
def g03(s, d):
    return ids(s, d).select("row_id", G.gen_bool(0.3, "b").alias("flag"))


@query("g04_categories", f"select row_id, {weighted_sql(['a', 'b', 'c'], [5, 3, 2], U('w'))} as w, {weighted_sql(['a', 'b', 'c'], [1, 1 / 2**1.5, 1 / 3**1.5], U('z'))} as z from {_IDS}")
def g04(s, d):
    return ids(s, d).select("row_id", G.gen_category(["a", "b", "c"], "w", [5, 3, 2]).alias("w"), G.gen_category(["a", "b", "c"], "z", zipf=1.5).alias("z"))


_T0, _T1 = 1704067200, 1735689600


@query("g05_timestamps", f"select row_id, make_timestamp(cast(({_T0} + floor({U('t')} * ({_T1} - {_T0}))) * 1000000 as bigint)) as at, make_timestamp(cast(greatest({_T0}, {_T1} - floor(-30.0 * 86400 * ln(1 - {U('r')}))) * 1000000 as bigint)) as recent from {_IDS}")
def g05(s, d):
    a, b = "2024-01-01 00:00:00", "2025-01-01 00:00:00"
    return ids(s, d).select("row_id", G.gen_timestamp(a, b, "t").cast("timestamp_ntz").alias("at"), G.gen_timestamp(a, b, "r", recent=30.0).cast("timestamp_ntz").alias("recent"))


@query("g06_time_of_day", f"select o_orderkey, date_trunc('day', o_orderdate)::timestamp + to_seconds(cast({weighted_sql(list(range(24)), G.HOURS['ecommerce'], U('hour:o_orderdate', 'o_orderkey'))} * 3600 + floor({U('second:o_orderdate', 'o_orderkey')} * 3600) as bigint)) as o_orderdate from orders")
def g06(s, d):
    return G.time_of_day(t(s, d, "orders"), "o_orderdate", "o_orderkey", "ecommerce").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


_DOMAINS = [*G.HOURS, "anything"]


@query("g06_hours_by_domain", "\nunion all\n".join(f"select '{m}' as domain, hour, count(*) as n from (select {weighted_sql(list(range(24)), G.HOURS.get(m, G._ANY), U('hour:o_orderdate', 'o_orderkey'))}::int as hour from orders) group by 2" for m in _DOMAINS))
def g06d(s, d):
    parts = [G.time_of_day(t(s, d, "orders"), "o_orderdate", "o_orderkey", m).groupBy(F.lit(m).alias("domain"), F.hour("o_orderdate").alias("hour")).agg(F.count("*").alias("n")) for m in _DOMAINS]
    return reduce(type(parts[0]).unionByName, parts)


_PK = "p as (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer), m as (select count(*) as m from customer)"


@query("g07_assign_fk", f"with {_PK} select o_orderkey, c_custkey as o_custkey from orders, m join p on i = least(cast(floor({U('fk:o_custkey', 'o_orderkey')} * m) as bigint), m - 1)")
def g07(s, d):
    return G.assign_fk(t(s, d, "orders").select("o_orderkey"), "o_orderkey", t(s, d, "customer"), "c_custkey", "o_custkey")


@query("g07_assign_fk_skewed", f"with {_PK} select o_orderkey, c_custkey as o_custkey from orders, m join p on i = least(cast(floor(pow({U('fk:o_custkey', 'o_orderkey')}, 3.0) * m) as bigint), m - 1)")
def g07s(s, d):
    return G.assign_fk(t(s, d, "orders").select("o_orderkey"), "o_orderkey", t(s, d, "customer"), "c_custkey", "o_custkey", skew=3.0)


@query("g08_reassign_fks", f"with {_PK} select c_custkey as o_custkey, count(*) as n from orders, m join p on i = least(cast(floor({U('fk:o_custkey', 'o_orderkey')} * m) as bigint), m - 1) group by 1")
def g08(s, d):
    tables = {"orders": t(s, d, "orders"), "customer": t(s, d, "customer")}
    return G.reassign_fks(tables, [("orders", "o_orderkey", "o_custkey", "customer", "c_custkey")])["orders"].groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("g09_cyclic_keys", f"with q as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders), m as (select count(*) as m from orders) select c_custkey, o_orderkey as favourite from customer, m join q on i = least(cast(floor({U('fk:favourite', 'c_custkey')} * m) as bigint), m - 1)")
def g09(s, d):
    tables = {"orders": t(s, d, "orders"), "customer": t(s, d, "customer").withColumn("favourite", F.lit(None).cast("long"))}
    edges = [("orders", "o_orderkey", "o_custkey", "customer", "c_custkey"), ("customer", "c_custkey", "favourite", "orders", "o_orderkey")]
    return G.reassign_fks(tables, edges)["customer"].select("c_custkey", "favourite")


_CARD = "n as (select o_custkey as k, count(*) as n from orders group by 1), h as (select coalesce(n, 0) as c, count(*) as p from customer left join n on k = c_custkey group by 1), f as (select c, sum(p) over (order by c)::double / sum(p) over () as cum from h)"


@query("g10_expand_children", f"with {_CARD}, x as (select c_custkey, least((select min(c) from f where {U('children', 'c_custkey')} < cum), 12) as n from customer) select c_custkey, cast(unnest(range(1, n + 1)) as int) as child_no from x where n > 0")
def g10(s, d):
    c = t(s, d, "customer")
    return G.expand_children(c, "c_custkey", P.cardinality_model(c, t(s, d, "orders"), "c_custkey", "o_custkey"), cap=12)


_GRID = [0.0, 1.0, 2.0, 5.0, 10.0]


@query("g11_sample_numeric", f"with u as (select row_id, {U('g')} as u, ({U('g:jitter')} - 0.5) * 2 * 0.01 * 10.0 as j from {_IDS}), i as (select *, least(cast(floor(u * 4) as int), 3) as i from u) select row_id, round(least(greatest((cast([0.0, 1.0, 2.0, 5.0, 10.0] as double[]))[i + 1] + ((cast([0.0, 1.0, 2.0, 5.0, 10.0] as double[]))[i + 2] - (cast([0.0, 1.0, 2.0, 5.0, 10.0] as double[]))[i + 1]) * (u * 4 - i) + j, 0.0), 10.0), 9) as v from i")
def g11(s, d):
    return ids(s, d).select("row_id", F.round(G.sample_numeric(_GRID, "g"), 9).alias("v"))


_COND = "o as (select o_orderstatus as context, o_orderpriority as value, count(*) as n from orders group by all), w as (select context, value, round(n::double / sum(n) over (partition by context), 6) as p from o), f as (select context, value, round(sum(p) over (partition by context order by value), 9) as cum, row_number() over (partition by context order by value desc) as last from w)"


@query("g12_sample_conditional", f"with {_COND} select o_orderkey, coalesce((select min(value) from f where context = o_orderstatus and {U('cond:v', 'o_orderkey')} < cum), (select value from f where context = o_orderstatus and last = 1)) as v from orders")
def g12(s, d):
    o = t(s, d, "orders")
    return G.sample_conditional(o.select("o_orderkey", "o_orderstatus"), M.conditional_categorical(o, "o_orderpriority", ["o_orderstatus"]), ["o_orderstatus"], "v", "o_orderkey").select("o_orderkey", "v")


@query("g13_sample_cross_table", f"with b as (select o_orderkey, o_orderstatus, c_mktsegment from orders join customer on c_custkey = o_custkey), o as (select c_mktsegment as context, o_orderstatus as value, count(*) as n from b group by all), w as (select context, value, round(n::double / sum(n) over (partition by context), 6) as p from o), f as (select context, value, round(sum(p) over (partition by context order by value), 9) as cum, row_number() over (partition by context order by value desc) as last from w) select o_orderkey, coalesce((select min(value) from f where context = c_mktsegment and {U('cond:v', 'o_orderkey')} < cum), (select value from f where context = c_mktsegment and last = 1)) as v from b")
def g13(s, d):
    j = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "c_mktsegment")
    return G.sample_conditional(j.select("o_orderkey", "c_mktsegment"), M.conditional_categorical(j, "o_orderstatus", ["c_mktsegment"]), ["c_mktsegment"], "v", "o_orderkey").select("o_orderkey", "v")


_F = G.seasonal({1: 0.8, 6: 1.2, 12: 1.5})
_FSQL = "case month(o_orderdate) " + " ".join(f"when {m} then {f!r}" for m, f in _F.items()) + " end"


@query("g15_month_curve", f"select o_orderkey, round((o_totalprice * ({_FSQL})::double), 6) as o_totalprice from orders")
def g15(s, d):
    return G.apply_month_curve(t(s, d, "orders"), "o_totalprice", "o_orderdate", _F, 6).select("o_orderkey", "o_totalprice")


@query("g16_batches", f"select i as row_id, {uniform_sql('b', 'i')} as u from range((select count(*) from nation) * 4) r(i)")
def g16(s, d):
    n = t(s, d, "nation").count()
    parts = [G.rows(s, 2 * n), G.rows(s, n, 2 * n), G.rows(s, n, 3 * n)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("row_id", uniform("b", "row_id").alias("u"))


_FULL = f"{pick_sql(V.FIRST, U('first'))} || ' ' || {pick_sql(V.LAST, U('last'))}"


@query("g17_names_and_contacts", f"select row_id, {_FULL} as full_name, regexp_replace(lower({_FULL}), '[^a-z]+', '.', 'g') || '.' || row_id || '@example.com' as email, '+1-555-' || lpad(cast(floor({U('phone')} * 10000000) as bigint)::varchar, 7, '0') as phone, {pick_sql(V.CITY, U('city'))} as city, {pick_sql(V.COMPANY, U('company'))} as company from {_IDS}")
def g17(s, d):
    return G.names_and_contacts(ids(s, d))


@query("g18_dependent", f"select o_orderkey, case o_orderstatus when 'F' then {weighted_sql(['x', 'y'], [0.7, 0.3], U('dep', 'o_orderkey'))} when 'O' then {pick_sql(['p', 'q'], U('dep', 'o_orderkey'))} else 'other' end as v from orders")
def g18(s, d):
    return t(s, d, "orders").select("o_orderkey", G.gen_dependent(F.col("o_orderstatus"), {"F": {"x": 0.7, "y": 0.3}, "O": ["p", "q"]}, "dep", "o_orderkey", "other").alias("v"))


@query("g19_relative_date", f"select l_orderkey, l_linenumber, cast(o_orderdate as date) + (2 + floor({uniform_sql('days:ship', 'l_orderkey').replace('cast(l_orderkey as varchar)', 'cast(l_orderkey as varchar), cast(l_linenumber as varchar)')} * 29))::int as ship from lineitem join orders on o_orderkey = l_orderkey")
def g19(s, d):
    return G.relative_date(t(s, d, "lineitem"), "l_orderkey", t(s, d, "orders"), "o_orderkey", "o_orderdate", "ship", ["l_orderkey", "l_linenumber"], 2, 30).select("l_orderkey", "l_linenumber", "ship")


_MOD = 10_000_000
_A = next(x for x in range(int(_MOD * 0.618) | 1, 2 * _MOD + 3) if math.gcd(x, _MOD) == 1)


@query("g20_unique_int", f"select row_id, cast((row_id::hugeint * {_A} + 42 * 7919) % {_MOD} + 1 as bigint) as v from {_IDS}")
def g20(s, d):
    return ids(s, d).select("row_id", G.unique_int(1, _MOD).alias("v"))


_KINDS = ["credit_card", "aadhaar", "routing_number", "ssn", "ifsc_code", "swift_bic", "iban", "account_number"]


@query("g21_typed_ids", "\nunion all\n".join(f"select '{k}' as kind, count(*) as n, count(*) as ok from orders" for k in _KINDS))
def g21(s, d):
    # Check digits cost far more than the shuffle of an id, and few files are few tasks.
    spread = ids(s, d).repartition(s.sparkContext.defaultParallelism)
    made = spread.select(*[G.gen_typed_id(k).alias(k) for k in _KINDS])
    wide = made.agg(F.count("*").alias("n"), *[F.count_if(valid(F.col(k), k)).alias(k) for k in _KINDS])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("n"), F.col(k).alias("ok")) for k in _KINDS])).alias("r")).select("r.*")


@query("g21_card_numbers", f"with b as (select row_id, '4' || right(lpad({big_sql('card:0', 'row_id')}, 18, '0'), 12) || right(lpad({big_sql('card:12', 'row_id')}, 18, '0'), 2) as b from {_IDS}), g as (select *, list_sum(list_transform(range(15), lambda i: case when i % 2 = 0 then (case when b[15 - i]::int * 2 > 9 then b[15 - i]::int * 2 - 9 else b[15 - i]::int * 2 end) else b[15 - i]::int end)) as l from b) select row_id, b || cast((10 - l % 10) % 10 as int) as card from g")
def g21c(s, d):
    return ids(s, d).select("row_id", G.gen_typed_id("credit_card").alias("card"))


@query("g22_text", f"select row_id, {pick_sql(G.QUALITY, U('quality'))} || ' ' || {pick_sql(G.PRODUCT, U('product'))} as product, 'A ' || {pick_sql(G.QUALITY, U('quality'))} || ' ' || {pick_sql(G.PRODUCT, U('product'))} || ' from ' || {pick_sql(V.CITY, U('city'))} || '.' as description from {_IDS}")
def g22(s, d):
    return ids(s, d).select("row_id", G.gen_text("product").alias("product"), G.gen_text("description").alias("description"))


@query("g23_plan_rows", "select * from (values ('customer', (select count(*) from customer)), ('orders', 10 * (select count(*) from customer)), ('lineitem', 40 * (select count(*) from customer)), ('nation', 25)) v(table_name, row_count)")
def g23(s, d):
    plan = G.plan_rows(t(s, d, "customer").count(), [("customer", "orders", 10.0), ("orders", "lineitem", 4.0), ("nation", "customer", 1.0)], ["customer"], {"nation": 25})
    return s.createDataFrame(list(plan.items()), "table_name string, row_count long")


@query("g25_inline_table", "select o_orderkey, rank from orders join (values ('F', 1), ('O', 2), ('P', 3)) v(status, rank) on status = o_orderstatus")
def g25(s, d):
    return t(s, d, "orders").join(G.inline_table(s, "status string, rank int", [("F", 1), ("O", 2), ("P", 3)]), F.col("status") == F.col("o_orderstatus")).select("o_orderkey", "rank")


@query("g26_null_if", "select o_orderkey, case when o_orderstatus in ('F') then null else o_orderpriority end as o_orderpriority from orders")
def g26(s, d):
    return G.null_if(t(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F"]).select("o_orderkey", "o_orderpriority")


_G27 = f"""with a as (select o_orderkey, o_totalprice, o_custkey::double as weight, row_number() over (order by o_totalprice, o_orderkey) as ra, count(*) over () as n from orders),
s as (select *, 0.8::double * sqrt(12.0::double) * (ra::double / n - 0.5::double) + {math.sqrt(1 - 0.8 * 0.8)!r}::double * {normal_sql('corr:o_totalprice:weight', 'o_orderkey')} as s from a),
r as (select *, row_number() over (order by s, o_orderkey) as r from s), v as (select weight as w, row_number() over (order by weight, o_orderkey) as r from a)
select o_orderkey, o_totalprice, w as weight from r join v using (r)"""


@query("g27_impose_correlation", _G27)
def g27(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("weight"))
    return G.impose_correlation(o, "o_totalprice", "weight", 0.8, "o_orderkey")


@query("g28_formula", "select l_orderkey, l_linenumber, round((l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) as charge from lineitem")
def g28(s, d):
    return G.formula(t(s, d, "lineitem"), "charge", "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)").select("l_orderkey", "l_linenumber", "charge")


@query("g29_formula_lookup", "select l_orderkey, l_linenumber, round(l_quantity * coalesce(p_retailprice, 0) + coalesce(p_size, 0), 2) as worth from lineitem left join part on p_partkey = l_partkey")
def g29(s, d):
    return G.formula_lookup(t(s, d, "lineitem"), "worth", "round(l_quantity * @part.p_retailprice + @part.p_size, 2)", {"part": (t(s, d, "part"), "p_partkey", "l_partkey")}).select("l_orderkey", "l_linenumber", "worth")


@query("g30_derive", "select l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity - 1, 0) as unit from lineitem")
def g30(s, d):
    return G.derive(t(s, d, "lineitem"), {"unit": "l_extendedprice / (l_quantity - 1)"}).select("l_orderkey", "l_linenumber", "unit")


@query("g31_apply_event", "select o_orderkey, case when o_orderstatus = 'F' and o_totalprice > 1000 then o_totalprice * 1.5::double else o_totalprice end as o_totalprice from orders")
def g31(s, d):
    return G.apply_event(t(s, d, "orders"), "o_orderstatus = 'F' and o_totalprice > 1000", "o_totalprice", "multiply", 1.5).select("o_orderkey", "o_totalprice")


@query("g32_cascade_event", "select o_orderkey, case when o_custkey in (select c_custkey from customer where c_acctbal < 0) then 'H' else o_orderstatus end as o_orderstatus from orders")
def g32(s, d):
    return G.cascade_event(t(s, d, "customer"), t(s, d, "orders"), "c_custkey", "o_custkey", "c_acctbal < 0", "o_orderstatus", "H").select("o_orderkey", "o_orderstatus")


@query("g33_trend_curve", "with b as (select min(floor(epoch(o_orderdate))) as lo, max(floor(epoch(o_orderdate))) as hi from orders) select o_orderkey, round((o_totalprice * (0.5::double + 1.0::double * ((floor(epoch(o_orderdate)) - lo)::double / (hi - lo)))), 6) as o_totalprice from orders, b")
def g33(s, d):
    return G.trend_curve(t(s, d, "orders"), "o_totalprice", "o_orderdate", 0.5, 1.5, 6).select("o_orderkey", "o_totalprice")


_W12 = [1, 1, 2, 2, 3, 3, 4, 4, 3, 2, 2, 5]
_MONTH = weighted_sql(list(range(1, 13)), _W12, U("month:o_orderdate", "o_orderkey"))


@query("g34_time_density", f"with m as (select o_orderkey, make_date(2024, ({_MONTH})::int, 1) as first from orders) select o_orderkey, first + cast(floor({U('day:o_orderdate', 'o_orderkey')} * day(last_day(first))) as int) as o_orderdate from m")
def g34(s, d):
    return G.time_density(t(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", _W12, 2024)


@query("g35_allocate", "with w as (select o_orderpriority as period, count(*)::double as weight from orders group by 1), e as (select *, weight / sum(weight) over () * 1001 as x from w), f as (select *, floor(x + 1e-9)::bigint as f, round(x - floor(x + 1e-9), 9) as r from e) select period, weight, f + (row_number() over (order by r desc, period) <= 1001 - sum(f) over ())::int as units from f")
def g35(s, d):
    w = t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("period")).agg(F.count("*").cast("double").alias("weight"))
    return G.allocate(w, 1001)


@query("g35_fact_rows", "select date_trunc('month', o_orderdate)::date::varchar as period, count(*) as n, sum(cast(round(o_totalprice) as bigint) * 100)::bigint as cents from orders group by 1")
def g35f(s, d):
    plan = t(s, d, "orders").groupBy(F.trunc("o_orderdate", "month").cast("string").alias("period")).agg(F.count("*").alias("units"), F.sum(F.round("o_totalprice").cast("long") * 100).alias("target"))
    return G.fact_rows(plan).groupBy("period").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("g36_rebalance_periods", "select date_trunc('month', o_orderdate)::date as period, count(*) as n, 100000000::bigint as cents from orders group by 1")
def g36(s, d):
    o = t(s, d, "orders")
    period = F.trunc("o_orderdate", "month")
    targets = o.select(period.alias("period")).distinct().withColumn("target", F.lit(100000000).cast("long"))
    out = G.rebalance_periods(o, period, "o_totalprice", targets, "o_orderkey")
    return out.groupBy("period").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


_E = "with s as (select avg(value) as m, stddev_samp(value) as s from events)"


@query("g37_inject_anomalies", f"{_E} select event_id, {U('anomaly:value', 'event_id')} < 0.02 as is_anomaly, round(case when {U('anomaly:value', 'event_id')} < 0.02 then m + case when {U('anomaly:value:sign', 'event_id')} < 0.5 then -1 else 1 end * (3 + 3 * {U('anomaly:value:size', 'event_id')}) * s else value end, 6) as value from events, s")
def g37(s, d):
    return G.inject_anomalies(t(s, d, "events"), "value", "event_id", 0.02).select("event_id", "is_anomaly", F.round("value", 6).alias("value"))


@query("g38_noise_nulls", f"select o_orderkey, case when {U('noise:null:o_orderstatus', 'o_orderkey')} < 0.1 then null else o_orderstatus end as o_orderstatus from orders")
def g38(s, d):
    return G.noise_nulls(t(s, d, "orders"), ["o_orderstatus"], "o_orderkey", 0.1).select("o_orderkey", "o_orderstatus")


@query("g39_noise_outliers", f"{_E} select event_id, round(case when {U('noise:outlier:value', 'event_id')} < 0.05 then m + case when {U('noise:sign:value', 'event_id')} < 0.5 then -1 else 1 end * 5 * s * (1 + {U('noise:size:value', 'event_id')}) else value end, 6) as value from events, s")
def g39(s, d):
    return G.noise_outliers(t(s, d, "events"), "value", "event_id", 0.05).select("event_id", F.round("value", 6).alias("value"))


@query(
    "g40_noise_typos",
    f"with x as (select c_custkey, c_name as c, (floor({U('typo:at:c_name', 'c_custkey')} * length(c_name)) + 1)::int as p, floor({U('typo:kind:c_name', 'c_custkey')} * 4) as k, {U('typo:c_name', 'c_custkey')} < 0.5 as hit from customer), y as (select *, c[1:p - 1] as head, c[p] as one, c[p + 1:] as tail from x) select c_custkey, case when not hit then c when k = 0 then head || c[p + 1:p + 1] || one || c[p + 2:] when k = 1 then head || tail when k = 2 then head || one || one || tail else head || case when one = lower(one) then upper(one) else lower(one) end || tail end as c_name from y",
)
def g40(s, d):
    return G.noise_typos(t(s, d, "customer"), "c_name", "c_custkey", 0.5).select("c_custkey", "c_name")


@query("g41_noise_duplicates", f"select o_orderkey, o_totalprice from orders union all select o_orderkey, round(o_totalprice * (0.99::double + 0.02::double * {U('noise:dup:jitter', 'o_orderkey')}), 2) from orders where {U('noise:dup', 'o_orderkey')} < 0.05")
def g41(s, d):
    return G.noise_duplicates(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.05, "o_totalprice")


@query("g42_temporal_drift", "with b as (select min(floor(epoch(ts))) as lo, max(floor(epoch(ts))) as hi from events) select event_id, round(value * (1 + 0.2::double * (floor(epoch(ts)) - lo) / (hi - lo)), 6) as value from events, b")
def g42(s, d):
    return G.temporal_drift(t(s, d, "events"), "value", "ts", 0.2).select("event_id", F.round("value", 6).alias("value"))


@query("g43_noise_policy", f"select o_orderkey, case when {U('noise:null:o_orderpriority', 'o_orderkey')} < 0.05 then null else o_orderpriority end as o_orderpriority from orders")
def g43(s, d):
    return G.noise(t(s, d, "orders"), "o_orderkey", "analytics_safe", 0.05, {"nulls": ["o_orderkey", "o_orderpriority"], "typos": ["o_orderstatus"]}).select("o_orderkey", "o_orderpriority")


@query("g44_customize", f"select o_orderkey, {pick_sql(['web', 'shop'], U('pool:channel', 'o_orderkey'))} as channel, case when {U('null:big', 'o_orderkey')} < 0.1 then null else o_totalprice > 1000 end as big from orders")
def g44(s, d):
    return G.customize(t(s, d, "orders"), "o_orderkey", {"channel": {"pool": ["web", "shop"]}, "big": {"expression": "o_totalprice > 1000", "null_rate": 0.1}}).select("o_orderkey", "channel", "big")


@query("g45_profiles", f"select row_id, round(least(greatest(38 + 14 * {Z('profile:age')}, 18.0), 90.0), 0) as age, round(least(-12.0 * ln(1 - {U('profile:wait')}), 240.0), 2) as wait, ({weighted_sql([1.0, 2.0, 3.0, 4.0, 5.0], [1, 1, 2, 5, 6], U('profile:rating'))})::double as rating from {_IDS}")
def g45(s, d):
    return ids(s, d).select("row_id", *[G.profile_column(n).alias(n) for n in ("age", "wait", "rating")])


def _profile_sql(name: str) -> str:
    family, said, least, most, decimals = G.NAMED_PROFILES[name]
    lane = f"profile:{name}"
    if family == "mixture":
        at = weighted_sql(list(range(len(said))), [w for *_, w in said], U(f"{lane}:part"))
        value = f"[{', '.join(f'{float(c[0])}::double' for c in said)}][{at} + 1] + [{', '.join(f'{float(c[1])}::double' for c in said)}][{at} + 1] * {Z(lane)}"
    elif family == "lognormal":
        value = f"exp({said[0]}::double + {said[1]}::double * {Z(lane)})"
    elif family == "pareto":
        value = f"{said[1]}::double * pow(1 - {U(lane)}, {-1 / said[0]}::double)"
    elif family == "zipf":
        value = f"{weighted_sql([float(k) for k in range(1, most + 1)], G.zipf_weights(said, most), U(lane))}::double"
    else:
        gamma = lambda shape, lane: " + ".join([f"-ln(1 - {U(f'{lane}:{i}')})" for i in range(int(shape))] + ([f"{Z(lane + ':half')} * {Z(lane + ':half')} / 2"] if shape % 1 else []))
        x, y = gamma(said[0], f"{lane}:a"), gamma(said[1], f"{lane}:b")
        value = f"{said[2]}::double * ({x}) / (({x}) + ({y}))"
    return f"round(least(greatest({value}, {float(least)}::double), {float(most)}::double), {decimals})"


@query("g45_named_profiles", "\nunion all\n".join(f"select '{n}' as profile, count(*) as n, round(avg(v), 4) as mean, min(v) as least, max(v) as most, round(stddev_samp(v), 4) as deviation from (select {_profile_sql(n)} as v from {_IDS})" for n in G.NAMED_PROFILES))
def g45_named(s, d):
    wide = ids(s, d).repartition(s.sparkContext.defaultParallelism).select(*[G.profile_column(n).alias(n) for n in G.NAMED_PROFILES])
    aggs = {n: {"n": F.count(n), "mean": F.round(F.avg(n), 4), "least": F.min(n), "most": F.max(n), "deviation": F.round(F.stddev_samp(n), 4)} for n in G.NAMED_PROFILES}
    return P.to_long(wide, aggs).withColumnRenamed("column_name", "profile")


_SK = "n_nationkey || '-' || step"


@query("g46_series_panel", f"with r as (select n_nationkey, cast(unnest(range(60)) as int) as step from nation), v as (select *, 100.0::double + 0.5::double * step + 10.0::double * sin(2 * pi() * step / 7) + 3.0::double * {normal_sql('series', _SK)} as v, {uniform_sql('series:anomaly', _SK)} < 0.02 as a from r) select n_nationkey, step, round(greatest(case when a then v * 3 else v end, 0.0), 4) as value from v")
def g46(s, d):
    return G.series_panel(t(s, d, "nation"), "n_nationkey", 60, 100.0, 0.5, 10.0, 7, 3.0, anomaly=0.02)


@query("b35_spec_from_profile", "select 'c_custkey' as column_name, 'id_like' as kind, 'sequence' as distribution, null::double as minimum, null::double as maximum union all select 'c_nationkey', 'id_like', 'sequence', null, null union all select 'c_name', case when count(distinct c_name) <= 50 then 'categorical' else 'text' end, case when count(distinct c_name) <= 50 then 'choices' else 'uniform' end, null, null from customer union all select 'c_mktsegment', 'categorical', 'choices', null, null union all select 'c_acctbal', 'numeric', case when min(c_acctbal) > 0 and skewness(c_acctbal) > 1 then 'lognormal' when stddev_samp(c_acctbal) < 0.01 then 'uniform' else 'normal' end, round(min(c_acctbal), 4), round(max(c_acctbal), 4) from customer")
def b35(s, d):
    return G.spec_from_profile(t(s, d, "customer"))


@query("b36_mimic")
def b36(s, d):
    c = t(s, d, "customer")
    return G.mimic(c, c.count(), "c_custkey")


@query("g09_self_reference", "select c_custkey, case when c_custkey > 1 then floor(" + uniform_sql("self:boss", "c_custkey") + " * (c_custkey - 1))::bigint + 1 end as boss from customer")
def g09s(s, d):
    return G.self_fk(t(s, d, "customer").select("c_custkey"), "c_custkey", "boss")
