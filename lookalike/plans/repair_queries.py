"""Queries of constraints, rules, duplicates and linked fields (G-50..G-87) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookalike.functions.rng import pick_sql, uniform, uniform_sql
from lookalike.operators import profile as P
from lookalike.operators import repair as R
from lookalike.plans.registry import query
from lookalike.plans.util import nullified, nullified_sql, t

_L = ["l_orderkey", "l_linenumber"]


def _lines(s, d):
    """Line items with a row number of their own: (l_orderkey, l_linenumber) repeats."""
    return t(s, d, "lineitem")


@query("g50_clip_range", "select l_orderkey, l_linenumber, case when l_quantity < 5 then 5 when l_quantity > 40 then 40 else l_quantity end::double as l_quantity from lineitem")
def g50(s, d):
    return R.clip_range(_lines(s, d), "l_quantity", 5.0, 40.0).select(*_L, "l_quantity")


@query("g50_range_violations", "select count(*) filter (where l_quantity < 5 or l_quantity > 40) as violations from lineitem")
def g50v(s, d):
    return R.range_violations(_lines(s, d), "l_quantity", 5.0, 40.0)


@query("g51_cap_sum", "with s as (select l_orderkey, sum(l_quantity) as s from lineitem group by 1) select l_orderkey, l_linenumber, round(case when s > 100 then l_quantity * 100 / s else l_quantity end, 6) as l_quantity from lineitem join s using (l_orderkey)")
def g51(s, d):
    return R.cap_sum(_lines(s, d), "l_quantity", 100.0, ["l_orderkey"]).select(*_L, F.round("l_quantity", 6).alias("l_quantity"))


@query("g51_drop_past_cap", "select o_orderkey from (select *, sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as s from orders) where s <= 500000")
def g51d(s, d):
    return R.drop_past_cap(t(s, d, "orders"), "o_totalprice", 500000.0, ["o_custkey"], ["o_orderkey"]).select("o_orderkey")


@query("g52_clip_group", "select l_orderkey, l_linenumber, least(l_discount, 0.05::double) as l_discount from lineitem")
def g52(s, d):
    return R.clip_group(_lines(s, d), "l_discount", hi=0.05).select(*_L, "l_discount")


@query("g53_unique_combination", "select o_custkey, o_orderstatus, min(o_orderkey) as o_orderkey from orders group by all")
def g53(s, d):
    return R.unique_combination(t(s, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("g54_not_null", f"select o_orderkey, coalesce(o_orderpriority, 'none') as o_orderpriority from {nullified_sql('orders', ['o_orderpriority'], 'o_orderkey')}")
def g54(s, d):
    return R.not_null(nullified(t(s, d, "orders"), ["o_orderpriority"], "o_orderkey"), "o_orderpriority", "none").select("o_orderkey", "o_orderpriority")


@query("g55_force_ratio", f"with r as (select *, row_number() over (order by {uniform_sql('ratio:o_orderstatus', 'o_orderkey')}, o_orderkey) as r, count(*) over () as n from orders) select * exclude (o_orderstatus, r, n), case when r <= n * 0.5 then 'F' when r <= n * 0.8 then 'O' else 'P' end as o_orderstatus from r")
def g55(s, d):
    return R.force_ratio(t(s, d, "orders"), "o_orderstatus", {"F": 5, "O": 3, "P": 2}, "o_orderkey")


_PAIR = "(select l_orderkey, l_linenumber, cast(o_orderdate as date) + 60 as a, cast(l_shipdate as date) as b from lineitem join orders on o_orderkey = l_orderkey)"


def _pair(s, d):
    return _lines(s, d).join(t(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(*_L, F.date_add(F.to_date("o_orderdate"), 60).alias("a"), F.to_date("l_shipdate").alias("b"))


@query("g56_order_dates", f"select l_orderkey, l_linenumber, least(a, b) as a, greatest(greatest(a, b), least(a, b) + 3) as b from {_PAIR}")
def g56(s, d):
    return R.order_dates(_pair(s, d), "a", "b", 3)


@query("g57_enforce_ineq", "select l_orderkey, l_linenumber, round(case when l_tax > l_discount then l_tax else l_discount + greatest(abs(l_discount) * 0.01, 1e-6) end, 9) as l_tax from lineitem")
def g57(s, d):
    return R.enforce_ineq(_lines(s, d), "l_tax", ">", "l_discount").select(*_L, F.round("l_tax", 9).alias("l_tax"))


@query("g58_clip_between", "select p_partkey, least(greatest(p_retailprice, p_size * 10.0::double), p_size * 20.0::double) as p_retailprice from part")
def g58(s, d):
    p = t(s, d, "part").withColumns({"lo": F.col("p_size") * 10.0, "hi": F.col("p_size") * 20.0})
    return R.clip_between(p, "p_retailprice", "lo", "hi").select("p_partkey", "p_retailprice")


@query("g59_enforce_enum", "select o_orderkey, case when o_orderstatus in ('O', 'P') then o_orderstatus else 'O' end as o_orderstatus from orders")
def g59(s, d):
    return R.enforce_enum(t(s, d, "orders"), "o_orderstatus", ["O", "P"]).select("o_orderkey", "o_orderstatus")


@query("g60_repair_rows", f"with o as (select * from {nullified_sql('orders', ['o_orderpriority'], 'o_orderkey')}), m as (select o_orderpriority as m from o where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1) select o_orderkey, case when o_orderpriority is null and o_orderstatus = 'F' then m else o_orderpriority end as o_orderpriority, o_totalprice * 2 as twice from o, m")
def g60(s, d):
    rules = [{"kind": "required", "column": "o_orderpriority", "where": "o_orderstatus = 'F'"}, {"kind": "assign", "column": "twice", "expression": "o_totalprice * 2"}]
    return R.repair_rows(nullified(t(s, d, "orders"), ["o_orderpriority"], "o_orderkey"), rules).select("o_orderkey", "o_orderpriority", "twice")


@query("g61_compile_constraints", "select 'p_partkey' as column_name, 'unique' as rule, '' as argument union all select 'p_partkey', 'range', min(p_partkey) || '..' || max(p_partkey) from part union all select 'p_size', 'range', min(p_size) || '..' || max(p_size) from part union all select 'p_retailprice', 'range', trunc(min(p_retailprice))::bigint || '..' || ceil(max(p_retailprice))::bigint from part union all select * from (select 'p_brand', 'enum', count(distinct p_brand)::varchar from part having count(distinct p_brand) <= 20) union all select * from (select 'p_type', 'enum', count(distinct p_type)::varchar from part having count(distinct p_type) <= 20) union all select * from (select 'p_name', 'enum', count(distinct p_name)::varchar from part having count(distinct p_name) <= 20)")
def g61(s, d):
    p = t(s, d, "part")
    prof = P.physical_types(p).join(P.profile_base(p), "column_name").join(P.profile_numeric(p), "column_name", "left")
    return R.compile_constraints(prof, ["p_partkey"])


_RULES = {"cheap": "l_extendedprice < 50000", "taxed": "l_tax > 0 and l_discount <= 0.09", "returned": "l_returnflag in ('R', 'N')"}


@query("g62_check_rules", "\nunion all\n".join(f"select '{n}' as rule, count(*) filter (where not ({e})) as violations, round(1 - count(*) filter (where not ({e}))::double / count(*), 6) as compliance from lineitem" for n, e in _RULES.items()))
def g62(s, d):
    return R.check_rules(_lines(s, d), _RULES)


@query("g63_reject_rows", "select l_orderkey, l_linenumber from lineitem where " + " and ".join(f"({e})" for e in _RULES.values()))
def g63(s, d):
    return R.reject_rows(_lines(s, d), _RULES).select(*_L)


_R40 = R.PercentRule("o_orderstatus", "=", "F", 40, ("O", "P"))


def _ruled(want: str, scope: str = "true") -> str:
    alt = pick_sql(["O", "P"], uniform_sql("rule:alt:o_orderstatus", "o_orderkey"))
    return f"with i as (select *, {scope} as ins from orders), r as (select *, case when ins then row_number() over (partition by ins order by o_orderstatus <> 'F', {uniform_sql('rule:o_orderstatus', 'o_orderkey')}, o_orderkey) end as r, count(*) filter (where ins) over () as n, count(*) filter (where ins and o_orderstatus = 'F') over () as h from i) select o_orderkey, case when not ins then o_orderstatus when r <= {want} then 'F' when o_orderstatus = 'F' then {alt} else o_orderstatus end as o_orderstatus from r"


@query("g64_percent_rule", _ruled("floor(40 * n / 100.0 + 0.5)"))
def g64(s, d):
    return R.apply_percent_rule(t(s, d, "orders"), _R40, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("g65_top_up_rule", _ruled("greatest(h, floor(60 * n / 100.0 + 0.5))"))
def g65(s, d):
    return R.apply_percent_rule(t(s, d, "orders"), R.PercentRule("o_orderstatus", "=", "F", 60, ("O", "P")), "o_orderkey", exact=False).select("o_orderkey", "o_orderstatus")


@query("g66_cross_rule", _ruled("floor(40 * n / 100.0 + 0.5)", "o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"))
def g66(s, d):
    return R.apply_cross_rule(t(s, d, "orders"), "o_custkey", t(s, d, "customer"), "c_custkey", "c_mktsegment = 'BUILDING'", _R40, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("g67_lift_rule", f"with q as (select avg((o_orderstatus = 'F')::int) as q from orders where not (o_totalprice > 200000)), i as (select *, o_totalprice > 200000 as ins from orders), r as (select *, case when ins then row_number() over (partition by ins order by o_orderstatus <> 'F', {uniform_sql('rule:o_orderstatus', 'o_orderkey')}, o_orderkey) end as r, count(*) filter (where ins) over () as n, count(*) filter (where ins and o_orderstatus = 'F') over () as h from i) select o_orderkey, case when ins and r <= greatest(h, floor(least(q * 2.0, 0.99) * 100 * n / 100 + 0.5)) then 'F' else o_orderstatus end as o_orderstatus from r, q")
def g67(s, d):
    return R.apply_lift_rule(t(s, d, "orders"), "o_totalprice > 200000", "o_orderstatus", "F", 2.0, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("g68_evaluate_rules", "select 'o_orderstatus = F' as rule, 40.0::double as target, 40.0::double as actual, true as passed union all select 'o_totalprice > 1000', 50.0, round(count(*) filter (where o_totalprice > 1000) * 100.0::double / count(*), 4), abs(round(count(*) filter (where o_totalprice > 1000) * 100.0::double / count(*), 4) - 50) <= 0.25 from orders")
def g68(s, d):
    done = R.apply_percent_rule(t(s, d, "orders"), _R40, "o_orderkey")
    return R.evaluate_rules(done, [_R40, R.PercentRule("o_totalprice", ">", 1000, 50)])


_DUP = uniform_sql("dup", "o_orderkey")


def _dups(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("code"), F.lit(1.0).alias("fee"))
    return o.unionByName(o.where(uniform("dup", "o_orderkey") < 0.03).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


@query("g70_repair_duplicates", f"with o as (select o_orderkey, o_orderkey as code from orders union all select o_orderkey + 10000000, o_orderkey from orders where {_DUP} < 0.03), r as (select *, row_number() over (partition by code order by o_orderkey) as r from o), n as (select o_orderkey, row_number() over (order by o_orderkey) as n from r where r > 1) select o.o_orderkey, case when n is null then code else (select max(code) from o) + n end as code from o left join n using (o_orderkey)")
def g70(s, d):
    return R.repair_duplicates(_dups(s, d), {"code": "number"}, ["o_custkey", "fee"], "fee", "o_orderkey").select("o_orderkey", "code")


@query("g70_fingerprints_differ", "select count(*) as n from (select distinct o_custkey from orders) where false")
def g70f(s, d):
    done = R.repair_duplicates(_dups(s, d), {}, ["o_custkey", "fee"], "fee", "o_orderkey")
    return done.groupBy("o_custkey", F.round("fee", 6).alias("fee")).count().where("count > 1").agg(F.count("*").alias("n"))


@query("g71_duplicate_density", "with n as (select count(*) as n from lineitem) select 'l_returnflag' as subject, round(max(c)::double / max(n), 6) as share, round(max(c)::double / max(n), 6) >= 0.15 and max(n) >= 50 as advisory from (select count(*) as c from lineitem group by l_returnflag), n union all select 'l_quantity', round(max(c)::double / max(n), 6), round(max(c)::double / max(n), 6) >= 0.15 and max(n) >= 50 from (select count(*) as c from lineitem group by l_quantity), n union all select 'fingerprint', round(sum(c - 1)::double / max(n), 6), round(sum(c - 1)::double / max(n), 6) >= 0.10 and max(n) >= 50 from (select count(*) as c from lineitem group by l_orderkey, l_linenumber), n")
def g71(s, d):
    return R.duplicate_density(_lines(s, d), ["l_returnflag", "l_quantity"], _L)


@query("g80_fix_date_order", f"select l_orderkey, l_linenumber, case when b < a then a + (1 + floor({uniform_sql('order:b', 'l_orderkey')} * 30))::int else b end as b from {_PAIR}")
def g80(s, d):
    return R.fix_date_order(_pair(s, d), "a", "b", "l_orderkey").select(*_L, "b")


@query("g81_fix_status_dates", "select o_orderkey, case when o_orderstatus in ('F') then cast(o_orderdate as date) end as done from orders")
def g81(s, d):
    o = t(s, d, "orders").withColumns({"day": F.to_date("o_orderdate"), "done": F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate"))})
    return R.fix_status_dates(o, "o_orderstatus", ["F"], "done", "day").select("o_orderkey", "done")


@query("g82_fix_prices", "select p_partkey, case when p_size * 40.0::double >= p_retailprice then round((p_retailprice * 0.8::double)::decimal(30, 12), 2)::double else p_size * 40.0::double end as cost from part")
def g82(s, d):
    return R.fix_prices(t(s, d, "part").withColumn("cost", F.col("p_size") * 40.0), "cost", "p_retailprice").select("p_partkey", "cost")


@query("g83_line_totals", "select l_orderkey, l_linenumber, round(greatest(0.0::double, l_quantity * l_extendedprice * (1 - l_discount)), 4) as total from lineitem")
def g83(s, d):
    return R.fix_line_totals(_lines(s, d), "total", "l_quantity", "l_extendedprice", "l_discount").select(*_L, F.round("total", 4).alias("total"))


@query("g83_order_totals", "select o_orderkey, round(coalesce((select sum(l_extendedprice) from lineitem where l_orderkey = o_orderkey), o_totalprice), 2) as o_totalprice from orders")
def g83o(s, d):
    return R.fix_order_totals(t(s, d, "orders"), _lines(s, d), "o_orderkey", "l_orderkey", "o_totalprice", "l_extendedprice").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("g84_map_plan_price", "select o_orderkey, case o_orderstatus when 'F' then 9.5::double when 'O' then 19.0 else o_totalprice end as o_totalprice from orders")
def g84(s, d):
    return R.map_plan_price(t(s, d, "orders"), "o_orderstatus", "o_totalprice", {"F": 9.5, "O": 19.0}).select("o_orderkey", "o_totalprice")


_H = r"regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '{x}', 'g'), '^\{x}+|\{x}+$', '', 'g')"


@query("g85_derive_handles", f"select p_partkey, {_H.format(x='.')} as username, {_H.format(x='-')} as slug, {_H.format(x='.')} || '@example.com' as email from part")
def g85(s, d):
    return R.derive_handles(t(s, d, "part"), "p_name").select("p_partkey", "username", "slug", "email")


@query("g86_fix_geography", f"with v as (select lower(r_name) as c, list(distinct n_name order by n_name) as cities from nation join region on r_regionkey = n_regionkey group by 1), x as (select c_custkey, (select r_name from region where r_regionkey = c_custkey % 5) as region, n_name from customer join nation on n_nationkey = c_nationkey) select c_custkey, case when list_contains(cities, n_name) then n_name else cities[cast(floor({uniform_sql('city:n_name', 'c_custkey')} * len(cities)) as int) + 1] end as n_name from x join v on c = lower(region)")
def g86(s, d):
    n, r = t(s, d, "nation"), t(s, d, "region")
    valid = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("country"), F.col("n_name").alias("city"))
    c = t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("r_regionkey") == F.col("c_custkey") % 5)
    return R.fix_geography(c.select("c_custkey", "r_name", "n_name"), "r_name", "n_name", valid, "c_custkey").select("c_custkey", "n_name")


@query("g87_fix_role_age", "select c_custkey, greatest(18 + c_custkey % 20, case when lower(c_mktsegment) like '%machinery%' then 30 else 0 end, case when lower(c_mktsegment) like '%build%' then 25 else 0 end)::bigint as age from customer")
def g87(s, d):
    c = t(s, d, "customer").withColumn("age", 18 + F.col("c_custkey") % 20)
    return R.fix_role_age(c, "c_mktsegment", "age", {"machinery": 30, "build": 25}).select("c_custkey", "age")


_EDGES = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("part", "p_size", "region", "r_regionkey")]
_TABLES = ["lineitem", "orders", "customer", "nation", "region", "part", "supplier"]
_HELD = " union all ".join(f"select '{c}' as child, '{p}' as parent from {c} having count(*) filter (where {cc} not in (select {pc} from {p})) = 0" for c, cc, p, pc in _EDGES)


@query("g24_generation_levels", f"with recursive e as ({_HELD}), l as (select unnest({_TABLES!r}) as table_name, 0 as level union all select e.child, l.level + 1 from l join e on e.parent = l.table_name) select table_name, max(level)::int as level from l group by table_name")
def g24(s, d):
    """Levels by the edges that the data bear out: all of a child's keys are keys of the parent."""
    from lookalike.operators.semantics import generation_levels

    edges = []
    for c, cc, p, pc in _EDGES:
        kids = t(s, d, c).select(F.col(cc).alias("k")).where("k is not null").distinct()
        if not kids.join(t(s, d, p).select(F.col(pc).alias("k")), "k", "left_anti").limit(1).count():
            edges.append((c, p))
    return generation_levels(s, _TABLES, edges)
