"""Queries of the catalog helpers (B-31, C-09 to C-13, G-47 to G-49, G-69, J-07) with their SQL.
Each joins what the catalog says with figures of the whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StringType

from lookalike.functions.rng import uniform_sql
from lookalike.operators import catalog as C
from lookalike.operators import profile as P
from lookalike.operators.repair import PercentRule
from lookalike.operators.semantics import table_role
from lookalike.plans.profile_queries import _FK_SQL, FKS
from lookalike.plans.registry import query
from lookalike.plans.util import COLUMNS, NUMERIC, t
from lookalike.sources.io import row_counts
from lookalike.streaming import incremental as J

_OWN = {"c_custkey", "o_orderkey", "n_nationkey", "r_regionkey", "p_partkey", "s_suppkey"}
_KIND = "case when column_type = 'VARCHAR' then 'text' when column_type in ('BIGINT', 'INTEGER') then 'int' when column_type = 'DOUBLE' then 'float' else 'date' end"


def _q(v) -> str:
    return "null" if v is None else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in rows) + ")"


def _catalog(s, d, names: list[str]) -> DataFrame:
    """(table_name, column_name, type) of the tables' real columns."""
    rows = []
    for n in names:
        for f in t(s, d, n).schema:
            k = f.dataType
            rows.append((n, f.name, "text" if isinstance(k, StringType) else "int" if isinstance(k, IntegralType) else "float" if isinstance(k, NumericType) else "date"))
    return s.createDataFrame(rows, "table_name string, column_name string, type string")


def _catalog_sql(names: list[str]) -> str:
    return "(" + " union all ".join(f"select '{n}' as table_name, column_name, {_KIND} as type from (describe {n})" for n in names) + ")"


# --- B-31

#: Tables by other names: name, table, {new column: column}, own key.
_NAMED = [
    ("customers", "customer", {"customer_id": "c_custkey"}, "customer_id"),
    ("orders", "orders", {"order_id": "o_orderkey", "customer_id": "o_custkey"}, "order_id"),
    ("parts", "part", {"part_id": "p_partkey"}, "part_id"),
    ("supplier", "supplier", {"id": "s_suppkey"}, "id"),
    ("lines", "lineitem", {"order_id": "l_orderkey", "part_id": "l_partkey", "supplier_id": "l_suppkey", "warehouse_id": "l_linenumber"}, None),
]
_NAMED_FKS = [("orders", "customer_id", "customers", "customer_id", "orders", "o_custkey", "customer", "c_custkey"), ("lines", "order_id", "orders", "order_id", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lines", "part_id", "parts", "part_id", "lineitem", "l_partkey", "part", "p_partkey"), ("lines", "supplier_id", "supplier", "id", "lineitem", "l_suppkey", "supplier", "s_suppkey")]


@query("b31_infer_fks_by_name", "\nunion all\n".join(f"select '{c}' as child, '{cc}' as child_column, '{p}' as parent, '{pc}' as parent_column, round((select count(distinct {k})::double / count(*) from {pt}), 6) as parent_ratio, round((select count(*) filter (where {fk} in (select {k} from {pt}))::double / count(*) from {ct} where {fk} is not null), 6) as containment, true as is_fk from (select 1)" for c, cc, p, pc, ct, fk, pt, k in _NAMED_FKS))
def b31(s, d):
    """Keys found by their names, then held against the rows."""
    have = {n: t(s, d, of).select(*[F.col(c).alias(new) for new, c in cols.items()]) for n, of, cols, _ in _NAMED}
    columns = s.createDataFrame([(n, c, c == key) for n, _, cols, key in _NAMED for c in cols], "table_name string, column_name string, is_key boolean")
    return P.infer_fks(have, [tuple(r) for r in C.infer_fks_by_name(columns).collect()])


# --- C

_MODEL = [("CUSTOMER", "Party"), ("Orders", "Order"), ("lineitem", "OrderLine"), ("part", "Product"), ("invoice", "Invoice")]
_ALL = list(COLUMNS)


@query("c09_map_domain", f"select table_name, row_count, entity_type from ({' union all '.join(f'select {_q(n)} as table_name, count(*) as row_count from {n}' for n in _ALL)}) join {_values(_MODEL)} m(name, entity_type) on lower(name) = table_name")
def c09(s, d):
    return C.map_domain(row_counts({n: t(s, d, n) for n in _ALL}), s.createDataFrame(_MODEL, "table_name string, entity_type string")).select("table_name", "row_count", "entity_type")


_SPEC_TABLES = ["lineitem", "orders", "part", "customer"]
_RULED = f"(select table_name, column_name, type, first(struct_pack(k := kind, says := says, lo := lo, hi := hi) order by i) as r from {_catalog_sql(_SPEC_TABLES)} left join {_values([(i, *r) for i, r in enumerate(C.SPEC_RULES)])} v(i, p, kind, says, lo, hi) on regexp_matches(column_name, p) group by all)"
_HELD = "(" + " union all ".join(f"select '{n}' as table_name, unnest({NUMERIC[n]}) as column_name, unnest([{', '.join(f'{c}::double' for c in NUMERIC[n])}]) as v from {n}" for n in _SPEC_TABLES) + ")"


@query("c11_fix_spec", f"""with r as {_RULED}, f as (select table_name, column_name, type, case when type = 'text' and r.k = 'text' then r.says end as text_type,
 case when type in ('int', 'float') and r.k in ('int', 'float') then r.lo end::double as minimum, case when type in ('int', 'float') and r.k in ('int', 'float') then r.hi end::double as maximum from r)
select table_name, column_name, type, text_type, minimum, maximum, (select count(*) from {_HELD} h where h.table_name = f.table_name and h.column_name = f.column_name and (h.v < f.minimum or h.v > f.maximum)) as rows_outside from f""")
def c11(s, d):
    """Specs mended by name, and how many values of each column lie outside the bounds."""
    bare = {"text_type": F.when(F.col("type") == "text", "sentence"), "minimum": F.lit(None).cast("double"), "maximum": F.lit(None).cast("double")}
    spec = C.fix_spec(_catalog(s, d, _SPEC_TABLES).withColumns(bare)).withColumn("text_type", F.nullif("text_type", F.lit("sentence")))
    bounds = spec.where("minimum is not null or maximum is not null").collect()
    parts = []
    for n in _SPEC_TABLES:
        of = {r.column_name: {"rows_outside": F.count_if(F.coalesce(F.col(r.column_name) < r.minimum, F.lit(False)) | F.coalesce(F.col(r.column_name) > F.lit(r.maximum), F.lit(False)))} for r in bounds if r.table_name == n}
        if of:
            parts.append(P.to_long(t(s, d, n), of).withColumn("table_name", F.lit(n)))
    counts = reduce(DataFrame.unionByName, parts)
    return spec.join(counts, ["table_name", "column_name"], "left").select("table_name", "column_name", "type", "text_type", "minimum", "maximum", F.coalesce("rows_outside", F.lit(0)).alias("rows_outside"))


@query("c12_promote_fks", f"select c.table_name, c.column_name, case when k.child is null then c.type else 'foreign_key' end as type, c.column_name in {tuple(sorted(_OWN))} and k.child is null as unique, k.parent || '.' || k.parent_column as \"references\" from {_catalog_sql(_ALL)} c left join (select * from ({_FK_SQL}) where is_fk) k on k.child = c.table_name and k.child_column = c.column_name")
def c12(s, d):
    """Keys that the rows bear out become foreign keys of the catalog."""
    catalog = _catalog(s, d, _ALL).withColumn("unique", F.col("column_name").isin(*_OWN))
    fks = P.infer_fks({x: t(s, d, x) for x in {y for f in FKS for y in (f[0], f[2])}}, FKS).where("is_fk")
    return C.promote_fks(catalog, fks).select("table_name", "column_name", "type", "unique", "references")


_CHOICE = [("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("part", "p_brand"), ("part", "p_type"), ("part", "p_name"), ("customer", "c_name"), ("customer", "c_mktsegment")]


@query("c13_categorical_review", "\nunion all\n".join(f"select '{n}' as table_name, '{c}' as column_name, 'missing_categorical_choices' as issue, 'REVIEW' as severity, 'Unknown' as fallback_value from {n} having count(distinct {c}) > 50" for n, c in _CHOICE))
def c13(s, d):
    """Choices are the values of columns that have 50 at most; the others are for review."""
    parts = []
    for n in dict.fromkeys(n for n, _ in _CHOICE):
        cols = [c for m, c in _CHOICE if m == n]
        held = P.category_frequencies(t(s, d, n), cols).groupBy("column_name").agg(F.collect_list("value").alias("choices"))
        parts.append(s.createDataFrame([(n, c, "categorical") for c in cols], "table_name string, column_name string, type string").join(held, "column_name", "left"))
    return C.categorical_review(reduce(DataFrame.unionByName, parts))


# --- G

_PRIOR = [(i, p, d, a, b, lo) for i, (of, p, d, a, b, lo) in enumerate(C.PRIORS) if of in ("ecommerce", "any")]
_LEAST = " union all ".join(f"select '{c}' as column_name, min({c})::double as seen, {'avg(l_tax)' if c == 'l_tax' else 'null::double'} as first from lineitem" for c in NUMERIC["lineitem"])


@query("g47_apply_priors", f"with c as ({_LEAST}), s as (select column_name, round(first, 6) as first, case when column_name = 'l_quantity' then seen end as minimum from c), r as (select column_name, first(struct_pack(d := d, a := a, b := b, lo := lo) order by i) as r from s join {_values(_PRIOR)} v(i, p, d, a, b, lo) on regexp_matches(column_name, p) where s.first is null group by 1) select column_name, coalesce(r.r.d, 'normal') as distribution, coalesce(s.first, r.r.a::double) as first, r.r.b::double as second, coalesce(minimum, r.r.lo::double) as minimum, r.r is not null as prior from s left join r using (column_name)")
def g47(s, d):
    """A spec with the mean of one column and the least value of another declared from the rows."""
    seen = P.to_long(t(s, d, "lineitem"), {c: {"seen": F.min(c).cast("double"), "first": F.round(F.avg("l_tax"), 6) if c == "l_tax" else F.max(F.lit(None).cast("double"))} for c in NUMERIC["lineitem"]})
    spec = seen.select("column_name", F.lit("normal").alias("distribution"), "first", F.lit(None).cast("double").alias("second"), F.when(F.col("column_name") == "l_quantity", F.col("seen")).alias("minimum"))
    return C.apply_priors(spec, C.detect_domain(["orders", "lineitem", "part"]))


_COUNTS = " union all ".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in _ALL)


@query("g48_scale_rows", f"with c as ({_COUNTS}) select table_name, row_count, greatest(1, round_even(row_count * (100000.0::double / (select sum(row_count) from c)), 0)::bigint) as planned_rows from c where row_count > 0")
def g48(s, d):
    return C.scale_rows(row_counts({n: t(s, d, n) for n in _ALL}), 100_000).where("row_count > 0")


_ROLE = [("region", 0.15), ("nation", 0.15), ("customer", 1.0), ("supplier", 1.0), ("part", 1.0), ("orders", 2.5), ("lineitem", 5.0), ("events", 1.5)]


@query("g48_tiered_rows", f"select table_name, greatest(5, floor(f * (select count(*) from customer)))::bigint as planned_rows from {_values(_ROLE)} v(table_name, f)")
def g48t(s, d):
    roles = table_role(s.createDataFrame([(n,) for n in _ALL], "table_name string"))
    return C.tiered_rows(roles, t(s, d, "customer").count()).select("table_name", "planned_rows")


@query("g49_reference_table", f"select code, label, final, count(*) as n from orders join {_values(C.REFERENCE_ROWS['ecommerce', 'order_status']).replace('True', 'true').replace('False', 'false')} v(code, label, final) on code = o_orderstatus group by all")
def g49(s, d):
    """The reference table of the domain that the table names speak for, with the rows that use it."""
    ref = C.reference_table(s, C.detect_domain(_ALL), "order_statuses")
    used = t(s, d, "orders").groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    return used.join(ref, "code").select("code", "label", "final", "n")


_RULES = [("orders", PercentRule("o_totalprice", ">", 1000, 40.0)), ("orders", PercentRule("o_orderstatus", "=", "F", 140.0)), ("orders", PercentRule("o_gone", "=", "F", 10.0)), ("orders", PercentRule("o_orderkey", "=", 1, 10.0)), ("events", PercentRule("user_id", "=", 1, 10.0)), ("part", PercentRule("p_size", "~", 1, 10.0)), ("customer", PercentRule("c_mktsegment", "=", "BUILDING", 30.0)), ("documents", PercentRule("text", "=", "", 1.0))]
_RULE_TABLES = ["orders", "events", "part", "customer", "documents"]


@query("g69_check_rule", f"select r.table_name, r.column_name, case when pct < 0 or pct > 100 then 'percent' when op not in ('=', '<>', '>', '>=', '<', '<=') then 'operator' when c.column_name is null then 'unknown column' when r.column_name in {tuple(sorted(_OWN))} or (lower(r.column_name) like '%id' and length(r.column_name) <= 12) or list_bool_or([contains(lower(r.column_name), x) for x in {C.PROTECTED_NAMES}]) then 'protected column' end as issue, n.row_count from {_values([(n, r.column, r.op, r.percent) for n, r in _RULES])} r(table_name, column_name, op, pct) left join {_catalog_sql(_RULE_TABLES)} c on c.table_name = r.table_name and c.column_name = r.column_name join ({' union all '.join(f'select {_q(n)} as table_name, count(*) as row_count from {n}' for n in _RULE_TABLES)}) n on n.table_name = r.table_name")
def g69(s, d):
    """What stands against each rule, and the rows that it would be for."""
    catalog = _catalog(s, d, _RULE_TABLES).withColumn("unique", F.col("column_name").isin(*_OWN))
    return C.check_rule(_RULES, catalog).join(row_counts({n: t(s, d, n) for n in _RULE_TABLES}), "table_name").select("table_name", "column_name", "issue", "row_count")


# --- J-07


@query("j07_assign_fk_stream", f"with p as (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer), m as (select count(*) as m from customer) select o_orderkey, c_custkey as o_custkey from orders, m join p on i = least(cast(floor({uniform_sql('fk:o_custkey', 'o_orderkey')} * m) as bigint), m - 1)")
def j07(s, d):
    sdf = J.stream(s, f"{d}/orders.parquet").select("o_orderkey")
    return J.assign_fk_stream(sdf, "o_orderkey", t(s, d, "customer"), "c_custkey", "o_custkey")
