"""Queries of validation, fidelity and release (H, A) with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lookalike.functions.rng import uniform, uniform_sql
from lookalike.operators import fidelity as D
from lookalike.operators import gate as K
from lookalike.operators import generate as G
from lookalike.operators import repair as R
from lookalike.operators import validate as V
from lookalike.plans.registry import query
from lookalike.plans.util import COLUMNS, halves, halves_sql, nullified, nullified_sql, t, thirds, union_all
from lookalike.sources import io

EDGES = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]
KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"], "nation": ["n_nationkey"]}
_ORPHAN = uniform_sql("orphan", "o_orderkey")
_BROKEN = f"(select * replace (case when {_ORPHAN} < 0.03 then o_custkey + 1000000 when {_ORPHAN} > 0.98 then null else o_custkey end as o_custkey) from orders)"


def tables(s, d):
    u = uniform("orphan", "o_orderkey")
    o = t(s, d, "orders")
    broken = o.withColumn("o_custkey", F.when(u < 0.03, F.col("o_custkey") + 1000000).when(u > 0.98, F.lit(None)).otherwise(F.col("o_custkey")))
    return {n: t(s, d, n) for n in ("customer", "lineitem", "nation", "region")} | {"orders": broken}


def _shared(s, name):
    return f"{io.shared_dir(s)}/{name}-{uuid.uuid4().hex}"


# --- A


@query("a01_scan", "select * from orders")
def a01(s, d):
    return io.scan(s, f"{d}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


_TYPES = {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int", "r_regionkey": "int", "r_name": "string"}


@query("a02_discover", "\nunion all\n".join(f"select '{tb}' as table_name, {i} as position, '{c}' as column_name, '{_TYPES[c]}' as data_type, count(*) = count(distinct {c}) as candidate_key, {str(i == 0).lower()} as declared_key from {tb}" for tb in ("nation", "region") for i, c in enumerate(COLUMNS[tb])))
def a02(s, d):
    return io.discover({n: t(s, d, n) for n in ("nation", "region")}, {"nation": ["n_nationkey"], "region": ["r_regionkey"]})


@query("a03_row_counts", "\nunion all\n".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in COLUMNS))
def a03(s, d):
    return io.row_counts({n: t(s, d, n) for n in COLUMNS})


_H42 = "md5(concat_ws('|', '42', cast({k} as varchar)))"


@query("a04_seeded_sample", f"select o_orderkey from orders order by {_H42.format(k='o_orderkey')}, o_orderkey limit 500")
def a04(s, d):
    return io.seeded_sample(t(s, d, "orders"), ["o_orderkey"], 500).select("o_orderkey")


@query("a05_fraction_sample", f"select o_orderkey from orders where {uniform_sql('sample', 'o_orderkey')} < 0.1")
def a05(s, d):
    return io.fraction_sample(t(s, d, "orders"), 0.1, ["o_orderkey"]).select("o_orderkey")


@query("a06_cap_rows", f"select o_orderkey from orders order by {_H42.format(k='o_orderkey')}, o_orderkey limit 1000")
def a06(s, d):
    return io.cap_rows(t(s, d, "orders"), 1000, ["o_orderkey"]).select("o_orderkey")


@query("a07_reservoir", f"select event_id, {uniform_sql('reservoir', 'event_id')} as priority from events order by 2, 1 limit 300")
def a07(s, d):
    return io.reservoir(t(s, d, "events"), 300, ["event_id"]).select("event_id", "priority")


@query("a08_holdout_split", f"with r as (select *, row_number() over (order by {uniform_sql('holdout', 'o_orderkey')}, o_orderkey) as r, count(*) over () as n from orders) select * exclude (r, n), r <= n - round_even(n * 0.2, 0) as is_train from r")
def a08(s, d):
    return io.holdout_split(t(s, d, "orders"), 0.2, ["o_orderkey"])


@query("a09_csv_read_back", "select * from nation")
def a09(s, d):
    n, path = t(s, d, "nation"), _shared(s, "csv")
    io.write_csv({"nation": n}, path)
    return io.scan(s, f"{path}/nation.csv", n.schema)


@query("a10_parquet_read_back", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def a10(s, d):
    path = _shared(s, "parquet")
    io.write_parquet({"orders": t(s, d, "orders")}, path, {"orders": ["o_orderstatus"]})
    return io.scan(s, f"{path}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("a11_json_read_back", "select * from region")
def a11(s, d):
    r, path = t(s, d, "region"), _shared(s, "json")
    io.write_jsonl({"region": r}, path)
    return io.scan(s, f"{path}/region.json", r.schema)


@query("a12_staged_publish", "select count(*) as row_count, true as refused from customer")
def a12(s, d):
    path, c = _shared(s, "publish"), t(s, d, "customer")
    io.staged_publish(s, {"customer": c}, path)
    try:
        io.staged_publish(s, {"customer": c}, path)
        refused = False
    except FileExistsError:
        refused = True
    return io.scan(s, f"{path}/customer.parquet").agg(F.count("*").alias("row_count")).withColumn("refused", F.lit(refused))


@query("a13_promote", "select count(*) > 0 as good, false as bad from nation")
def a13(s, d):
    n = t(s, d, "nation")
    good = K.check(n.agg(F.count("*").alias("n")), "rows", "integrity", F.col("n"), F.col("n") > 0, True)
    bad = K.check(n.agg(F.count("*").alias("n")), "rows", "integrity", F.col("n"), F.col("n") < 0, True)
    did = [io.promote(s, {"nation": n}, c, _shared(s, "promote")) for c in (good, bad)]
    return n.limit(1).select(F.lit(did[0]).alias("good"), F.lit(did[1]).alias("bad"))


@query("a15_validate_write", "select 'orders' as table_name, count(*) as expected, count(*) as written, true as ok from orders")
def a15(s, d):
    path, o = _shared(s, "recount"), t(s, d, "orders")
    io.write_parquet({"orders": o}, path)
    return io.validate_write(s, path, io.row_counts({"orders": o}))


@query("a14_schema_compat", "select column_name, count(*) as rows_refused from orders, (values ('note'), ('channel')) v(column_name) group by column_name")
def a14(s, d):
    """Columns of incoming rows that the target lacks, and how many rows they hold back."""
    o = t(s, d, "orders")
    incoming = o.withColumns({"note": F.lit(""), "channel": F.lit("web")})
    lacking = s.createDataFrame([(c,) for c in io.schema_compat(incoming, o)], "column_name string")
    return lacking.crossJoin(incoming.agg(F.count("*").alias("rows_refused")))


# --- H


_HAVE = ("customer", "lineitem", "nation", "region", "orders")


@query("h01_tables_present", " union all ".join(f"select '{n}' as table_name, true as present, count(*) as row_count from {n}" for n in _HAVE) + " union all select 'payments', false, 0")
def h01(s, d):
    """Required tables, whether they are there, and their rows."""
    have = tables(s, d)
    counts = io.row_counts(have)
    return V.tables_present(s, have, [*_HAVE, "payments"]).join(counts, "table_name", "left").select("table_name", "present", F.coalesce("row_count", F.lit(0)).alias("row_count"))


@query("h02_pk_integrity", "\nunion all\n".join(f"select '{n}' as table_name, count(*) as row_count, 0::bigint as null_keys, count(*) - (select count(*) from (select distinct {', '.join(k)} from {n})) as duplicate_keys, count(*) = (select count(*) from (select distinct {', '.join(k)} from {n})) as unique from {n}" for n, k in KEYS.items()))
def h02(s, d):
    return V.pk_integrity(tables(s, d), KEYS)


@query("h03_pk_uniqueness", "select 'lineitem' as table_name, count(*) as checked, count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as duplicate_count from lineitem")
def h03(s, d):
    return V.pk_integrity(tables(s, d), {"lineitem": KEYS["lineitem"]}).select("table_name", F.col("row_count").alias("checked"), F.col("duplicate_keys").alias("duplicate_count"))


def _edge_sql(template: str) -> str:
    return "\nunion all\n".join(template.format(c=c, cc=cc, p=p, pc=pc, src=_BROKEN if c == "orders" else c) for c, cc, p, pc in EDGES)


_HEAD = "select '{c}' as child, '{cc}' as child_column, '{p}' as parent, "


@query("h04_fk_orphans", _edge_sql(_HEAD + "count(*) filter (where {cc} is not null and {cc} not in (select {pc} from {p})) as orphans from {src}"))
def h04(s, d):
    return V.fk_orphans(tables(s, d), EDGES)


@query("h05_fk_validity", _edge_sql(_HEAD + "round(count(*) filter (where {cc} in (select {pc} from {p}))::double / count(*), 6) as validity from {src}"))
def h05(s, d):
    return V.fk_validity(tables(s, d), EDGES)


@query("h06_orphan_severity", "select *, case when share > 0.01 then 'error' when share > 0 then 'warning' else 'ok' end as severity from (" + _edge_sql(_HEAD + "round(avg((v not in (select {pc} from {p}))::int), 6) as share from (select distinct {cc} as v from {src} where {cc} is not null)") + ")")
def h06(s, d):
    return V.orphan_severity(tables(s, d), EDGES)


@query("h07_validate_export", "select * from (values ('orders', 'row_count', true), ('customer', 'row_count', true), ('orders', 'primary_key', true), ('customer', 'primary_key', true), ('orders', 'foreign_key', true), ('orders', 'columns', true), ('customer', 'columns', false)) v(table_name, \"check\", ok)")
def h07(s, d):
    path = _shared(s, "export")
    both = {n: t(s, d, n) for n in ("orders", "customer")}
    io.write_parquet(both, path)
    n = {r.table_name: r.row_count for r in io.row_counts(both).collect()}
    return V.validate_export(s, path, n, {k: KEYS[k] for k in both}, EDGES[:1], {"orders": ["o_orderkey"], "customer": ["c_custkey", "c_email"]})


_CONS = [
    {"name": "qty", "kind": "range", "column": "l_quantity", "min": 2, "max": 45},
    {"name": "flag", "kind": "enum", "column": "l_returnflag", "values": ["N", "R"]},
    {"name": "status", "kind": "conditional", "when": "l_returnflag = 'N'", "then": "l_linestatus = 'O'"},
    {"name": "price", "kind": "arithmetic", "column": "l_extendedprice", "expression": "l_quantity * 1000", "tolerance": 20000.0},
    {"name": "pk", "kind": "unique", "columns": ["l_orderkey", "l_linenumber"]},
    {"name": "kids", "kind": "max_children", "column": "l_orderkey", "max": 6},
]
_CV = {
    "qty": "(select count(*) from lineitem where l_quantity < 2 or l_quantity > 45)", "flag": "(select count(*) from lineitem where l_returnflag not in ('N', 'R'))", "status": "(select count(*) from lineitem where l_returnflag = 'N' and not l_linestatus = 'O')",
    "price": "(select count(*) from lineitem where abs(l_extendedprice - l_quantity * 1000) > 20000)", "pk": "((select count(*) from lineitem) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)))", "kids": "(select sum(greatest(n - 6, 0))::bigint from (select count(*) as n from lineitem group by l_orderkey))",
}


@query("h08_constraint_compliance", "\nunion all\n".join(f"select '{n}' as \"constraint\", {v} as violations, round(1 - {v}::double / (select count(*) from lineitem), 6) as compliance" for n, v in _CV.items()))
def h08(s, d):
    return V.constraint_compliance(t(s, d, "lineitem"), _CONS)


@query("h08_temporal", "select 'late' as \"constraint\", count(*) filter (where l_shipdate < o_orderdate) as violations, round(1 - count(*) filter (where l_shipdate < o_orderdate)::double / count(*), 6) as compliance from lineitem join orders on l_orderkey = o_orderkey")
def h08t(s, d):
    j = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return V.constraint_compliance(j, [{"name": "late", "kind": "temporal", "later": "l_shipdate", "earlier": "o_orderdate"}])


_SPEC = {"o_orderkey": {"nullable": False}, "o_orderstatus": {"values": ["F", "O"]}, "o_orderpriority": {"nullable": False}, "o_gone": {}}


@query("h09_schema_match", f"select 'o_orderkey' as column_name, true as present, true as nulls_ok, true as values_ok union all select 'o_orderstatus', true, true, count(*) filter (where o_orderstatus not in ('F', 'O')) = 0 from orders union all select 'o_orderpriority', true, count(*) = count(o_orderpriority), true from {nullified_sql('orders', ['o_orderpriority'], 'o_orderkey')} union all select 'o_gone', false, false, false")
def h09(s, d):
    return V.schema_match(nullified(t(s, d, "orders"), ["o_orderpriority"], "o_orderkey"), _SPEC)


def _physical_sql(source: str) -> str:
    """(column_name, kind) of a relation, as the engine describes it."""
    kind = "case when column_type in ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'HUGEINT') then 'integer' when column_type in ('DOUBLE', 'FLOAT') or column_type like 'DECIMAL%' then 'float' when column_type = 'BOOLEAN' then 'boolean' when column_type like 'TIMESTAMP%' or column_type = 'DATE' then 'datetime' else 'string' end"
    return f"(select column_name, {kind} as kind from (describe {source}))"


_CHANGED = "(select * exclude (o_orderdate) replace (o_custkey::varchar as o_custkey), 1 as extra from orders)"


@query("h10_column_parity", f"select coalesce(a.column_name, b.column_name) as column_name, a.kind as source_type, b.kind as synthetic_type, coalesce(a.kind = b.kind, false) as same from {_physical_sql('orders')} a full join {_physical_sql('select * from ' + _CHANGED)} b on a.column_name = b.column_name")
def h10(s, d):
    o = t(s, d, "orders")
    return V.column_parity(o, o.drop("o_orderdate").withColumns({"o_custkey": F.col("o_custkey").cast("string"), "extra": F.lit(1)}))


_IDK = ["credit_card", "aadhaar", "routing_number", "iban"]


def _typed(s, d):
    made = t(s, d, "orders").select(F.col("o_orderkey").alias("row_id")).select("row_id", *[G.gen_typed_id(k).alias(k) for k in _IDK])
    bad = uniform("broken", "row_id") < 0.05
    turned = lambda c: F.concat(F.substr(c, F.lit(1), F.char_length(c) - 1), ((F.right(c, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    return made.withColumns({k: F.when(bad, turned(F.col(k))).otherwise(F.col(k)) for k in _IDK})


@query("h11_format_validity", union_all("select '{c}' as column_name, count(*) as checked, count(*) filter (where {u} < 0.05) as invalid from orders", _IDK, u=uniform_sql("broken", "o_orderkey")))
def h11(s, d):
    return V.format_validity(_typed(s, d), {k: k for k in _IDK})


@query("h12_type_adherence", f"select round(1 - count(*) filter (where {uniform_sql('broken', 'o_orderkey')} < 0.05)::double / count(*), 6) as score, false as passed from orders")
def h12(s, d):
    return V.type_adherence(_typed(s, d), {k: k for k in _IDK})


@query("h13_plausibility", "select 'l_quantity' as column_name, case when min(l_quantity) < 0 or max(l_quantity) > 10000 then 'out_of_range' when stddev_pop(l_quantity) = 0 then 'no_variance' else 'ok' end as issue from lineitem union all select 'l_discount', case when min(l_discount) < 0 or max(l_discount) > 1 then 'out_of_range' else 'ok' end from lineitem union all select 'l_linenumber', case when min(l_linenumber) < 1 then 'out_of_range' else 'ok' end from lineitem union all select 'fixed', 'no_variance'")
def h13(s, d):
    return V.plausibility(t(s, d, "lineitem").withColumn("fixed", F.lit(3)), ["l_quantity", "l_discount", "l_linenumber", "fixed"])


@query("h14_validate_columns", "select 'c_acctbal' as column_name, 'negative_amount' as issue, count(*) filter (where c_acctbal < 0) as n from customer union all select 'c_acctbal', 'over_a_million', count(*) filter (where c_acctbal > 1000000) from customer union all select 'mail', 'bad_email', count(*) filter (where c_custkey % 10 = 0) from customer union all select 'c_mktsegment', 'empty_text', count(*) filter (where trim(c_mktsegment) = '') from customer")
def h14(s, d):
    c = t(s, d, "customer").withColumn("mail", F.when(F.col("c_custkey") % 10 == 0, "nobody").otherwise("a@b.c"))
    return V.validate_columns(c, amounts=["c_acctbal"], emails=["mail"], texts=["c_mktsegment"])


@query("h15_temporal_checks", "select 'l_shipdate >= o_orderdate' as rule, count(*) filter (where l_shipdate < o_orderdate) as n from lineitem join orders on l_orderkey = o_orderkey union all select 'o_orderdate in the past', count(*) filter (where o_orderdate > date '1997-01-01') from lineitem join orders on l_orderkey = o_orderkey")
def h15(s, d):
    j = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return V.temporal_checks(j, [("o_orderdate", "l_shipdate")], ["o_orderdate"], "1997-01-01")


@query("h16_duplicate_checks", "select 'l_orderkey' as subject, count(*) - count(distinct l_orderkey) as duplicates from lineitem union all select 'row', count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) from lineitem")
def h16(s, d):
    return V.duplicate_checks(t(s, d, "lineitem"), ["l_orderkey"], ["l_orderkey", "l_linenumber"])


@query("h17_series_properties", "with x as (select cast(ts as date) as d, avg(value) as v from events group by 1), y as (select *, lag(v) over (order by d) as prev, row_number() over (order by d) as i from x) select count(*) as days, round(corr(v, prev), 6) as lag1, round(regr_slope(v, i) / abs(avg(v)), 8) as relative_slope, abs(regr_slope(v, i) / abs(avg(v)) * count(*)) > 0.2 as trending from y")
def h17(s, d):
    return V.series_properties(t(s, d, "events"), F.to_date("ts"), "value")


@query("h18_curve_check", "with x as (select date_trunc('month', o_orderdate)::date as period, round(sum(o_totalprice), 2) as actual from orders group by 1) select period, actual, case when month(period) % 2 = 0 then actual else 1.0::double end as target, month(period) % 2 = 0 or abs(actual - 1) <= 0.01 as ok from x")
def h18(s, d):
    o = t(s, d, "orders")
    period = F.trunc("o_orderdate", "month")
    real = o.groupBy(period.alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("target"))
    return V.curve_check(o, period, "o_totalprice", real.withColumn("target", F.when(F.month("period") % 2 == 0, F.col("target")).otherwise(1.0)))


@query("h19_quality_score", "select greatest(0, 100 - 10 * (select (count(*) > 0)::int from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)) - 3 * (select (count(*) > 0)::int from customer where c_acctbal < 0) - (select (count(*) > 0)::int from orders where o_totalprice > 100000))::bigint as score")
def h19(s, d):
    """One issue for each check that any row of the whole tables fails."""
    twice = t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    checks = {"error": twice, "warning": t(s, d, "customer").where("c_acctbal < 0"), "info": t(s, d, "orders").where("o_totalprice > 100000")}
    issues = [df.agg(F.lit(k).alias("severity"), (F.count("*") > 0).cast("long").alias("n")) for k, df in checks.items()]
    return K.quality_score(issues[0].unionByName(issues[1]).unionByName(issues[2]))


_HL = halves_sql("lineitem", "l_orderkey")
_HO = halves_sql("orders", "o_orderkey")
_HP = halves_sql("part", "p_partkey")


def _ks(c: str) -> str:
    return f"(select max(abs(x - y)) from (select sum(a) over (order by v)::double / sum(a) over () as x, sum(b) over (order by v)::double / sum(b) over () as y from (select v, sum(a) as a, sum(1 - a) as b from (select {c}::double as v, 1 as a from src union all select {c}, 0 from syn) group by v)))"


_N3 = ["l_quantity", "l_extendedprice", "l_discount"]


@query("h20_ks", f"with {_HL} " + "\nunion all\n".join(f"select '{c}' as column_name, round(1 - {_ks(c)}, 6) as similarity" for c in _N3))
def h20(s, d):
    return D.ks(*halves(t(s, d, "lineitem"), "l_orderkey"), _N3)


def _tv(c: str) -> str:
    return f"(select sum(abs(a::double / ta - b::double / tb)) / 2 from (select sum(a) as a, sum(1 - a) as b, sum(sum(a)) over () as ta, sum(sum(1 - a)) over () as tb from (select {c} as v, 1 as a from src union all select {c}, 0 from syn) where v is not null group by v))"


@query("h21_tvd", f"with {_HP} " + "\nunion all\n".join(f"select '{c}' as column_name, round({_tv(c)}, 6) as tvd, round(1 - {_tv(c)}, 6) as similarity, {_tv(c)} <= 0.15 as passed" for c in ("p_brand", "p_type")))
def h21(s, d):
    return D.tvd(*halves(t(s, d, "part"), "p_partkey"), ["p_brand", "p_type"])


_NO = nullified_sql("orders", ["o_orderpriority"], "o_orderkey")


@query("h22_missing_similarity", f"with o as (select * from {_NO}), {halves_sql('o', 'o_orderkey')} select 'o_orderpriority' as column_name, round(1 - abs((select avg((o_orderpriority is null)::int) from src) - (select avg((o_orderpriority is null)::int) from syn)), 6) as similarity union all select 'o_custkey', 1.0")
def h22(s, d):
    return D.missing_similarity(*halves(nullified(t(s, d, "orders"), ["o_orderpriority"], "o_orderkey"), "o_orderkey"), ["o_orderpriority", "o_custkey"])


@query("h22_declared_nulls", f"select 'o_orderpriority' as column_name, 0.1::double as declared, round(avg((o_orderpriority is null)::int), 6) as actual from {_NO}")
def h22d(s, d):
    return D.declared_nulls(nullified(t(s, d, "orders"), ["o_orderpriority"], "o_orderkey"), {"o_orderpriority": 0.1})


def _cr(a: str, b: str) -> str:
    return f"abs((select round(corr({a}, {b}), 6) from src) - (select round(corr({a}, {b}), 6) from syn))"


_CS = "round(1 - (" + " + ".join(_cr(a, b) for i, a in enumerate(_N3) for b in _N3[i + 1 :]) + ") * 2 / 9 / 2, 6)"


@query("h23_corr_similarity", f"with {_HL} select {_CS} as similarity")
def h23(s, d):
    return D.corr_similarity(*halves(t(s, d, "lineitem"), "l_orderkey"), _N3)


@query("h24_compare_distributions", f"with {_HL}, m as (select 'ks' as metric, round((" + " + ".join(f"round(1 - {_ks(c)}, 6)" for c in _N3) + f") / 3, 6) as value, 0.85::double as target union all select 'tvd', round(1 - {_tv('l_returnflag')}, 6), 0.85 union all select 'missing', 1.0, 0.9 union all select 'correlation', {_CS}, 0.8) select *, value >= target as passed from m")
def h24(s, d):
    return D.compare_distributions(*halves(t(s, d, "lineitem"), "l_orderkey"), _N3, ["l_returnflag"])


_G = "(select quantile_cont({c}::double, [i / 20.0::double for i in range(21)]) from {t})"


@query("h25_quantile_rmse", f"with {_HL} " + "\nunion all\n".join(f"select '{c}' as column_name, round(sqrt(list_sum(list_transform(list_zip({_G.format(c=c, t='src')}, {_G.format(c=c, t='syn')}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 21) / (select max({c}) - min({c}) from src), 6) as rmse" for c in _N3))
def h25(s, d):
    return D.quantile_rmse(*halves(t(s, d, "lineitem"), "l_orderkey"), _N3)


def _nmi2(side: str) -> str:
    return f"(select round(greatest(0.0, least(1.0, sum(p * ln(p / (pa * pb))) / least(-sum(p * ln(pa)), -sum(p * ln(pb))))), 6) from (select c::double / t as p, sum(c) over (partition by a)::double / t as pa, sum(c) over (partition by b)::double / t as pb from (select a, b, c, sum(c) over () as t from (select l_returnflag as a, l_linestatus as b, count(*) as c from {side} group by all))))"


@query("h26_correlation_retention", f"with {_HL}, n as (select 'l_returnflag' as parent, 'l_linestatus' as child, {_nmi2('src')} as source, {_nmi2('syn')} as synthetic) select *, round(least(1.0, synthetic / source), 4) as retention from n where source > 0")
def h26(s, d):
    return D.correlation_retention(*halves(t(s, d, "lineitem"), "l_orderkey"), ["l_returnflag", "l_linestatus"])


@query("h27_range_fidelity", f"with {_HL} " + "\nunion all\n".join(f"select '{c}' as column_name, round(avg(({c} between (select quantile_cont({c}, 0.01) from src) and (select quantile_cont({c}, 0.99) from src))::int), 6) as share from syn" for c in _N3))
def h27(s, d):
    return D.range_fidelity(*halves(t(s, d, "lineitem"), "l_orderkey"), _N3)


@query("h28_vocabulary_fidelity", f"with {_HP} " + "\nunion all\n".join(f"select '{c}' as column_name, round(avg(({c} in (select {c} from src))::int), 6) as share from syn" for c in ("p_brand", "p_name")))
def h28(s, d):
    return D.vocabulary_fidelity(*halves(t(s, d, "part"), "p_partkey"), ["p_brand", "p_name"])


@query("h29_fidelity_to_spec", "select 'o_totalprice' as subject, 'outside_bounds' as measure, round(avg((o_totalprice < 1000 or o_totalprice > 400000)::int), 6) as value from orders union all select 'o_orderstatus', 'unknown_choice', round(avg((o_orderstatus not in ('F', 'O'))::int), 6) from orders union all select 'o_custkey', 'children_cv', round(stddev_pop(n) / avg(n), 6) from (select count(*) as n from orders group by o_custkey)")
def h29(s, d):
    return V.fidelity_to_spec(t(s, d, "orders"), {"o_totalprice": (1000, 400000)}, {"o_orderstatus": ["F", "O"]}, "o_custkey")


_TOP = "(select o_orderpriority as v from {t} group by 1 order by count(*) desc, 1 limit 5)"


@query("h30_source_fidelity", f"with {_HO}, m as (select 'o_totalprice' as subject, 'mean_delta_pct' as measure, round(abs((select avg(o_totalprice) from syn) - (select avg(o_totalprice) from src)) / (select avg(o_totalprice) from src) * 100, 4) as value union all select 'o_custkey', 'mean_delta_pct', round(abs((select avg(o_custkey) from syn) - (select avg(o_custkey) from src)) / (select avg(o_custkey) from src) * 100, 4) union all select 'o_orderpriority', 'top5_overlap', round((select count(*) from {_TOP.format(t='src')} where v in (select v from {_TOP.format(t='syn')}))::double / (select count(*) from {_TOP.format(t='src')}), 4) union all select 'table', 'correlation_delta', round(abs((select round(corr(o_totalprice, o_custkey), 6) from src) - (select round(corr(o_totalprice, o_custkey), 6) from syn)), 4)) select *, case measure when 'mean_delta_pct' then value <= 35 when 'top5_overlap' then value >= 0.4 else value <= 0.35 end as passed from m")
def h30(s, d):
    return D.source_fidelity(*halves(t(s, d, "orders"), "o_orderkey"), ["o_totalprice", "o_custkey"], ["o_orderpriority"])


@query("h31_business_fidelity", f"with {_HO}, a as (select o_orderpriority as grp, avg(o_totalprice) as m, avg((o_orderstatus = 'F')::int) as r, count(*) as n from src group by 1), b as (select o_orderpriority as grp, avg(o_totalprice) as m, avg((o_orderstatus = 'F')::int) as r, count(*) as n from syn group by 1) select grp, round(least(1.0, abs(b.m - a.m) / abs(a.m)), 6) as mean_error, round(abs(b.r - a.r), 6) as rate_error from a join b using (grp) where a.n >= 3 and b.n >= 3")
def h31(s, d):
    return D.business_fidelity(*halves(t(s, d, "orders"), "o_orderkey"), "o_orderpriority", "o_totalprice", F.col("o_orderstatus") == "F")


@query("h32_categorical_drift", f"with {halves_sql('events', 'event_id')} select 'event_type' as column_name, 'novel' as value, count(*) as n from syn where event_id % 50 = 0 having count(*) > 0")
def h32(s, d):
    src, syn = halves(t(s, d, "events"), "event_id")
    return D.categorical_drift(src, syn.withColumn("event_type", F.when(F.col("event_id") % 50 == 0, "novel").otherwise(F.col("event_type"))), ["event_type"])


@query("h33_parity_checks", f"with o as (select o_orderkey, o_orderpriority from {_NO}), {halves_sql('o', 'o_orderkey')} select 'o_orderkey' as column_name, 0.0::double as source_null, 0.0::double as synthetic_null, 0.0::double as swing, false as empty union all select 'o_orderpriority', a, b, round(abs(a - b), 6), b = 1 from (select (select round(avg((o_orderpriority is null)::int), 6) from src) as a, (select round(avg((o_orderpriority is null)::int), 6) from syn) as b)")
def h33(s, d):
    return V.parity_checks(*halves(nullified(t(s, d, "orders"), ["o_orderpriority"], "o_orderkey").select("o_orderkey", "o_orderpriority"), "o_orderkey"))


_UNLIKE = f"with {halves_sql('orders', 'o_orderkey')}, new as (select * replace (o_custkey::varchar as o_custkey, case when o_orderkey % 97 = 0 then '?' else o_orderstatus end as o_orderstatus, o_totalprice * 3 as o_totalprice) from syn)"


@query(
    "h34_compare_readiness",
    f"""{_UNLIKE}, x as (select v, sum(a) over (order by v)::double / sum(a) over () as p, sum(b) over (order by v)::double / sum(b) over () as q from (select v, sum(a) as a, sum(b) as b from (select o_totalprice as v, 1 as a, 0 as b from src union all select o_totalprice, 0, 1 from new) group by v))
select 'blocker' as severity, 'schema:' || a.column_name as issue from {_physical_sql('orders')} a join {_physical_sql('select * replace (o_custkey::varchar as o_custkey) from orders')} b using (column_name) where a.kind <> b.kind
union all select distinct 'warning', 'novel:o_orderstatus' from new where o_orderstatus not in (select o_orderstatus from src)
union all select 'warning', 'ks:o_totalprice' from x having 1 - max(abs(p - q)) < 0.85""",
)
def h34(s, d):
    src, syn = halves(t(s, d, "orders"), "o_orderkey")
    new = {"o_custkey": F.col("o_custkey").cast("string"), "o_orderstatus": F.when(F.col("o_orderkey") % 97 == 0, "?").otherwise(F.col("o_orderstatus")), "o_totalprice": F.col("o_totalprice") * 3}
    return D.compare_readiness(src, syn.withColumns(new), ["o_totalprice"], ["o_orderstatus"])


@query("h35_tstr")
def h35(s, d):
    train, holdout, syn = thirds(t(s, d, "lineitem"), "l_orderkey")
    return D.tstr(train, holdout, syn, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@query("h35_tstr_classifier")
def h35c(s, d):
    train, holdout, syn = thirds(t(s, d, "lineitem"), "l_orderkey")
    return D.tstr_classifier(train, holdout, syn, ["l_quantity", "l_extendedprice"], "l_returnflag")


@query("h36_rule_pass_rate", "select 2::bigint as rules, round((1 + (abs(round(count(*) filter (where o_totalprice > 1000) * 100.0::double / count(*), 4) - 50) <= 0.25)::int) / 2.0::double, 6) as pass_rate from orders")
def h36(s, d):
    rule = R.PercentRule("o_orderstatus", "=", "F", 40, ("O", "P"))
    return K.rule_pass_rate(R.evaluate_rules(R.apply_percent_rule(t(s, d, "orders"), rule, "o_orderkey"), [rule, R.PercentRule("o_totalprice", ">", 1000, 50)]))


_TARGETS = {"l_quantity": 0.9, "l_extendedprice": 1.05, "l_discount": 2.0}


@query("h37_readiness", f"with {_HL}, m as (" + "\nunion all\n".join(f"select '{c}' as name, round(1 - {_ks(c)}, 6) as value, {g}::double as target" for c, g in _TARGETS.items()) + ") select *, case when value >= target then 'PASS' when value >= 0.9 * target then 'REVIEW' else 'FAIL' end as status from m")
def h37(s, d):
    k = D.ks(*halves(t(s, d, "lineitem"), "l_orderkey"), _N3)
    return K.readiness(k.select(F.col("column_name").alias("name"), F.col("similarity").alias("value")), _TARGETS)


def _qa(s, d):
    tb = tables(s, d)
    return D.qa_report(tb, {"lineitem": t(s, d, "lineitem")}, {k: KEYS[k] for k in ("customer", "lineitem")}, EDGES[:1], {"lineitem": ["l_quantity"]}, {"lineitem": {"cheap": "l_extendedprice < 50000"}})


_DUPK = "(select count(*) from lineitem) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem))"
_FKV = f"(select round(count(*) filter (where o_custkey in (select c_custkey from customer))::double / count(*), 6) from {_BROKEN})"
_QA = f"""select 'pk_unique' as name, 'integrity' as dimension, 'customer' as table_name, 'c_custkey' as column_name, true as critical, true as ran, 'PASS' as status, 0.0::double as metric, 0.0::double as threshold
union all select 'pk_unique', 'integrity', 'lineitem', 'l_orderkey,l_linenumber', true, true, case when {_DUPK} = 0 then 'PASS' else 'FAIL' end, ({_DUPK})::double, 0.0
union all select 'fk_valid', 'integrity', 'orders', 'o_custkey', true, true, case when {_FKV} = 1 then 'PASS' else 'FAIL' end, {_FKV}, 1.0
union all select 'range', 'fidelity', 'lineitem', 'l_quantity', false, true, case when x >= 0.9 then 'PASS' else 'WARN' end, x, 0.9 from (select round(avg((l_quantity between (select quantile_cont(l_quantity, 0.01) from lineitem) and (select quantile_cont(l_quantity, 0.99) from lineitem))::int), 6) as x from lineitem)
union all select 'rule', 'business', 'lineitem', 'cheap', false, true, case when x >= 0.95 then 'PASS' else 'WARN' end, x, 0.95 from (select round(1 - count(*) filter (where not l_extendedprice < 50000)::double / count(*), 6) as x from lineitem)"""


@query("h38_qa_report", _QA)
def h38(s, d):
    return _qa(s, d)


@query("h39_applicability", f"select name, table_name, case when name = 'range' then 'NOT_APPLICABLE' else status end as status from ({_QA})")
def h39(s, d):
    return K.applicability(_qa(s, d), {"range": ["numeric_profile"], "rule": ["rules"]}, ["rules"]).select("name", "table_name", "status")


@query("h40_verdict", f"with q as ({_QA}) select case when count(*) filter (where status = 'FAIL') > 0 then 'FAIL' when count(*) filter (where status = 'WARN') > 0 then 'WARN' else 'PASS' end as verdict, coalesce((select string_agg(name, ',' order by name) from (select distinct name from q where status = 'FAIL')), '') as blocking from q")
def h40(s, d):
    return K.verdict(_qa(s, d))


@query("h41_release_decision", f"with q as ({_QA}), v as (select case when count(*) filter (where status = 'FAIL') > 0 then 'FAIL' when count(*) filter (where status = 'WARN') > 0 then 'WARN' else 'PASS' end as verdict from q) select verdict, 'LEARNED_RESTRICTED' as mode, verdict <> 'FAIL' as released, case when verdict <> 'FAIL' then 'internal' else 'none' end as audience from v")
def h41(s, d):
    return K.release_decision(K.verdict(_qa(s, d)), "LEARNED_RESTRICTED")


@query("h43_data_card", "select 'orders' as table_name, 20000::bigint as planned, count(*) as actual, round(count(*)::double / 20000, 6) as fulfilled, 6 as columns from orders")
def h43(s, d):
    return V.data_card({"orders": t(s, d, "orders")}, {"orders": 20000})


@query("h45_integrity_report", _edge_sql(_HEAD + "count(*) filter (where {cc} is not null and {cc} not in (select {pc} from {p})) as orphans, coalesce((select list(v order by v) from (select distinct {cc}::bigint as v from {src} where {cc} is not null and {cc} not in (select {pc} from {p}) order by 1 limit 5)), []) as sample from {src}"))
def h45(s, d):
    return V.integrity_report(tables(s, d), EDGES)


@query("h46_locale_fit", "select round(avg((r_name = 'ASIA')::int), 6) as country_share, round(avg((n_name in ('INDIA', 'CHINA'))::int), 6) as city_share, 1.0::double as phone_share, avg((r_name = 'ASIA')::int) >= 0.8 and avg((n_name in ('INDIA', 'CHINA'))::int) >= 0.8 as fits from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def h46(s, d):
    j = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("phone", F.lit("+91-1"))
    return V.locale_fit(j, ("r_name", "ASIA"), ("n_name", ["INDIA", "CHINA"]), ("phone", "+91"))


@query("h47_validation_contract", f"with q as ({_QA}), l as (select *, case when dimension = 'integrity' then 'artifact' else 'fidelity' end as lane from q) select lane, case when count(*) filter (where status = 'FAIL') > 0 then 'FAIL' when count(*) filter (where status = 'WARN') > 0 then 'REVIEW' else 'PASS' end as status, coalesce(string_agg(distinct name, ',' order by name) filter (where status = 'FAIL'), '') as fail_reasons, coalesce(string_agg(distinct name, ',' order by name) filter (where status = 'WARN'), '') as review_reasons from l group by lane")
def h47(s, d):
    return K.validation_contract(_qa(s, d))




@query("h42_thresholds", f"with {halves_sql('orders', 'o_orderkey')}, f as (select o_orderstatus as v, sum(a)::double / (select count(*) from src) as x, sum(1 - a)::double / (select count(*) from syn) as y from (select o_orderstatus, 1 as a from src union all select o_orderstatus, 0 from syn) group by v) select round(sum(abs(x - y)) / 2, 6) as tvd, sum(abs(x - y)) / 2 <= 0.15 as passed from f")
def h42(s, d):
    """A figure of two tables held against the default threshold."""
    found = D.tvd(*halves(t(s, d, "orders"), "o_orderkey"), ["o_orderstatus"])
    return found.select("tvd", (F.col("tvd") <= K.Thresholds().tvd).alias("passed"))


@query("h44_validate_spec", "select 'orders.o_gone' as subject, 'unknown relation' as issue, count(*) as row_count from orders union all select 'orders.o_orderstatus', 'probabilities', count(*) from orders union all select 'lineitem.l_orderkey', 'no relationship', count(*) from lineitem")
def h44(s, d):
    """Issues of a spec whose tables and columns are the real ones, with the rows that they concern."""
    have = {n: t(s, d, n) for n in ("orders", "customer", "lineitem")}
    spec: dict = {n: {c: {} for c in df.columns} for n, df in have.items()}
    spec["orders"]["o_orderstatus"] = {"choices": ["F", "O"], "probabilities": [0.5, 0.4]}
    spec["lineitem"]["l_orderkey"] = {"type": "foreign_key"}
    issues = V.validate_spec(spec, [("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_gone", "customer", "c_custkey")])
    found = s.createDataFrame(issues, "subject string, issue string").withColumn("table_name", F.split("subject", "[.]")[0])
    return found.join(io.row_counts(have), "table_name").select("subject", "issue", "row_count")
