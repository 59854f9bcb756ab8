"""Helpers over catalogs: DataFrames with a row per table or column, joined with rule tables.

A catalog of columns has table_name, column_name, type, and what else an operator names.  The
rule tables are small constants; figures of the data come from aggregates of the operators that
the catalog is joined with, so nothing here meets a data row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lookalike.operators.repair import PercentRule


def name_candidates(stem: Column) -> Column:
    """Table names that a key stem may stand for: as it is, plural, singular."""
    return F.array_compact(F.array(stem, F.concat(stem, F.lit("s")), F.concat(stem, F.lit("es")), F.when(stem.endswith("y"), F.regexp_replace(stem, "y$", "ies")), F.when(stem.endswith("s"), F.regexp_replace(stem, "s$", ""))))


def infer_fks_by_name(columns: DataFrame) -> DataFrame:
    """(child, child_column, parent, parent_column) from names alone (B-31).

    columns: (table_name, column_name, is_key).  A column X_id, unless it is its table's own key,
    points to the first table that X, its plural or singular names and that has a column of the
    same name, else <table>_id, else id."""
    kids = columns.where(F.col("column_name").endswith("_id") & ~F.col("is_key")).select(F.col("table_name").alias("child"), F.col("column_name").alias("child_column"), F.regexp_replace(F.lower("column_name"), "_id$", "").alias("stem"))
    named = kids.select("child", "child_column", F.posexplode(name_candidates(F.col("stem"))).alias("place", "parent"))
    held = columns.select(F.col("table_name").alias("parent"), F.col("column_name").alias("parent_column"))
    order = F.when(F.col("parent_column") == F.col("child_column"), 0).when(F.col("parent_column") == F.concat("parent", F.lit("_id")), 1).when(F.col("parent_column") == "id", 2)
    found = named.join(held, "parent").where("parent <> child").withColumn("rank", order).where("rank is not null")
    first = F.row_number().over(Window.partitionBy("child", "child_column").orderBy("place", "rank"))
    return found.withColumn("first", first).where("first = 1").select("child", "child_column", "parent", "parent_column")


def map_domain(contract: DataFrame, model: DataFrame) -> DataFrame:
    """The contract's tables that the model (table_name, entity_type) knows, by name without case (C-09)."""
    known = model.select(F.lower("table_name").alias("_name"), "entity_type")
    return contract.withColumn("_name", F.lower("table_name")).join(known, "_name").drop("_name")


#: Roles of column names that say what a column holds: pattern, type, text type, bounds.
SPEC_RULES = [
    ("(?i)e_?mail", "text", "email", None, None),
    ("(?i)phone|mobile", "text", "phone", None, None),
    ("(?i)url|website|link", "text", "url", None, None),
    ("(?i)address|street", "text", "address", None, None),
    ("(?i)city|town", "text", "city", None, None),
    ("(?i)country|nation_?name", "text", "country", None, None),
    ("(?i)company|supplier_?name", "text", "company", None, None),
    ("(?i)(^|_)name$", "text", "name", None, None),
    ("(?i)(^|_)age$", "int", None, 18.0, 80.0),
    ("(?i)rating|stars", "float", None, 1.0, 5.0),
    ("(?i)discount|percent", "float", None, 0.0, 100.0),
    ("(?i)price|cost|amount|total", "float", None, 0.01, None),
    ("(?i)quantity|qty|count|stock", "int", None, 1.0, None),
    ("(?i)duration|minutes|hours", "int", None, 1.0, None),
]


def fix_spec(catalog: DataFrame) -> DataFrame:
    """Column specs mended by their names (C-11): catalog has type, text_type, minimum, maximum.

    Foreign keys stay.  Text ids become uuid text; other text that is still plain sentences takes
    the text type of the first rule that fits; numbers without bounds take the rule's."""
    rules = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("kind"), F.lit(x).cast("string").alias("says"), F.lit(a).cast("double").alias("lo"), F.lit(b).cast("double").alias("hi")) for p, k, x, a, b in SPEC_RULES])
    rule = F.try_element_at(F.filter(rules, lambda r: F.regexp_like("column_name", r.p)), F.lit(1))
    plain = (F.col("type") == "text") & F.coalesce(F.col("text_type").isin("sentence", "word"), F.lit(True))
    number = F.col("type").isin("int", "float") & F.col("_r.kind").isin("int", "float") & F.col("minimum").isNull() & F.col("maximum").isNull()
    own = F.regexp_like("column_name", F.lit("(?i)^(id|uuid|guid)$|_(id|uuid)$"))
    text = F.when(plain & own, "uuid").when(plain & (F.col("_r.kind") == "text"), F.col("_r.says")).otherwise(F.col("text_type"))
    new = {"text_type": text, "minimum": F.when(number, F.col("_r.lo")).otherwise(F.col("minimum")), "maximum": F.when(number, F.col("_r.hi")).otherwise(F.col("maximum"))}
    return catalog.withColumn("_r", rule).withColumns(new).drop("_r")


def promote_fks(catalog: DataFrame, fks: DataFrame) -> DataFrame:
    """Columns that fks (child, child_column, parent, parent_column) name become foreign keys, not
    unique, with what they reference (C-12)."""
    said = fks.select(F.col("child").alias("table_name"), F.col("child_column").alias("column_name"), F.concat_ws(".", "parent", "parent_column").alias("_to")).dropDuplicates(["table_name", "column_name"])
    j = catalog.join(said, ["table_name", "column_name"], "left")
    new = F.col("_to").isNotNull() & (F.col("type") != "foreign_key")
    return j.withColumns({"type": F.when(new, "foreign_key").otherwise(F.col("type")), "unique": F.col("unique") & ~new, "references": F.when(new, F.col("_to"))}).drop("_to")


def categorical_review(catalog: DataFrame, fallback: str = "Unknown") -> DataFrame:
    """REVIEW rows of categorical columns without choices (C-13); catalog has choices (array)."""
    lacking = catalog.where((F.col("type") == "categorical") & (F.coalesce(F.size("choices"), F.lit(0)) <= 0))
    return lacking.select("table_name", "column_name", F.lit("missing_categorical_choices").alias("issue"), F.lit("REVIEW").alias("severity"), F.lit(fallback).alias("fallback_value"))


#: Priors by domain and name: domain, pattern, distribution, its two parameters, least value.
PRIORS = [
    ("ecommerce", "(?i)price|cost", "lognormal", 3.5, 0.8, 0.99),
    ("ecommerce", "(?i)quantity|qty", "poisson", 2.0, None, 1.0),
    ("ecommerce", "(?i)total|amount", "lognormal", 4.2, 0.9, 1.0),
    ("ecommerce", "(?i)discount", "beta", 1.5, 6.0, 0.0),
    ("finance", "(?i)bal", "lognormal", 8.0, 1.2, 0.0),
    ("finance", "(?i)amount|price", "lognormal", 4.5, 1.3, 0.01),
    ("any", "(?i)(^|_)age$", "normal", 38.0, 12.0, 18.0),
    ("any", "(?i)rating|score", "normal", 3.9, 0.9, 1.0),
]


def apply_priors(spec: DataFrame, domain: str) -> DataFrame:
    """Missing parameters of a spec filled from the domain's priors (G-47).

    spec: (column_name, distribution, first, second, minimum).  What is declared wins; an absent
    distribution or the default, normal without parameters, is taken from the prior."""
    rules = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b"), F.lit(lo).cast("double").alias("lo")) for of, p, d, a, b, lo in PRIORS if of in (domain, "any")])
    j = spec.withColumn("_r", F.try_element_at(F.filter(rules, lambda r: F.regexp_like("column_name", r.p)), F.lit(1)))
    bare = (F.coalesce("distribution", F.lit("normal")) == "normal") & F.col("first").isNull() & F.col("second").isNull()
    taken = bare & F.col("_r").isNotNull()
    new = {"distribution": F.when(taken, F.col("_r.d")).otherwise(F.col("distribution")), "first": F.when(taken, F.col("_r.a")).otherwise(F.col("first")), "second": F.when(taken, F.col("_r.b")).otherwise(F.col("second"))}
    return j.withColumns({**new, "minimum": F.when(taken, F.coalesce("minimum", "_r.lo")).otherwise(F.col("minimum")), "prior": taken}).drop("_r")


def scale_rows(counts: DataFrame, target: int) -> DataFrame:
    """Row counts (table_name, row_count) scaled to a total, one row at least, halves to even (G-48)."""
    total = counts.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("_all"))
    ratio = F.lit(float(target)) / F.when(F.col("_all") > 0, F.col("_all")).otherwise(max(target, 1))
    scaled = F.greatest(F.lit(1), F.bround(F.col("row_count") * ratio).cast("long"))
    return counts.crossJoin(F.broadcast(total)).select("table_name", "row_count", F.when(F.col("row_count") > 0, scaled).otherwise(F.col("row_count")).alias("planned_rows"))


# Rows of each role of a table for one row of the base.
TIERS = {"reference": 0.15, "entity": 1.0, "transaction": 2.5, "line_item": 5.0, "activity": 1.5}


def tiered_rows(roles: DataFrame, base: int, least: int = 5) -> DataFrame:
    """Row counts by the role of each table (G-48); roles has table_name and role (C-10)."""
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.col("role"))
    return roles.withColumn("planned_rows", F.greatest(F.lit(least), F.floor(factor * base)).cast("long"))


#: Words of table names that speak for a domain, and each domain's reference rows.
DOMAIN_WORDS = {
    "ecommerce": ["order", "part", "product", "supplier", "lineitem", "cart"],
    "finance": ["account", "transaction", "balance", "loan"],
    "education": ["course", "student", "lesson"],
}
REFERENCE_ROWS = {
    ("ecommerce", "order_status"): [("F", "fulfilled", True), ("O", "open", False), ("P", "pending", False)],
    ("finance", "account_type"): [("CHK", "checking", False), ("SAV", "savings", False), ("CLS", "closed", True)],
    ("education", "level"): [("B", "beginner", False), ("I", "intermediate", False), ("A", "advanced", True)],
}


def detect_domain(names: list[str]) -> str:
    """The domain that most words in the table names speak for; the first of equals, else generic."""
    said = " ".join(names).lower()
    score = {d: sum(w in said for w in words) for d, words in DOMAIN_WORDS.items()}
    best = max(score, key=lambda d: score[d])
    return best if score[best] else "generic"


def reference_table(spark: SparkSession, domain: str, name: str) -> DataFrame:
    """(code, label, final) of a domain's reference table, plural or singular; else of any domain's (G-49)."""
    one = name.lower().removesuffix("es") if name.lower().endswith("ses") else name.lower().removesuffix("s")
    fits = [v for (d, n), v in REFERENCE_ROWS.items() if d == domain and n in (name.lower(), one)]
    fits += [v for (_, n), v in REFERENCE_ROWS.items() if n in (name.lower(), one)]
    return spark.createDataFrame(fits[0] if fits else [], "code string, label string, final boolean")


# Types and parts of names that no distribution rule may change.
PROTECTED_TYPES = ["foreign_key", "uuid", "email", "phone", "url", "address", "bank_account", "account_number", "routing_number", "ssn", "aadhaar", "iban", "swift_bic", "ifsc_code", "credit_card"]
PROTECTED_NAMES = ["id", "uuid", "guid", "ssn", "aadhaar", "routing", "account_number", "accountnumber", "bank_account", "iban", "swift", "ifsc", "credit_card", "card_number", "email", "phone", "mobile", "address", "case_note", "note", "memo", "comment", "description", "narrative", "text"]


def check_rule(rules: list[tuple[str, PercentRule]], catalog: DataFrame) -> DataFrame:
    """(table_name, column_name, issue): what stands against each (table, rule); null if nothing (G-69).

    catalog: (table_name, column_name, type, unique).  In this order: a percentage outside
    0..100, an unknown operator, an unknown column, a protected one."""
    spark = catalog.sparkSession
    said = spark.createDataFrame([(i, n, r.column, r.op, float(r.percent)) for i, (n, r) in enumerate(rules)], "_i int, table_name string, column_name string, op string, percent double")
    j = said.join(catalog.withColumn("_known", F.lit(True)), ["table_name", "column_name"], "left")
    name = F.lower("column_name")
    guarded = F.coalesce("unique", F.lit(False)) | F.col("type").isin(PROTECTED_TYPES) | name.endswith("id") & (F.length(name) <= 12) | F.regexp_like(name, F.lit("|".join(PROTECTED_NAMES)))
    issue = F.when(~F.col("percent").between(0, 100), "percent").when(~F.col("op").isin("=", "<>", ">", ">=", "<", "<="), "operator").when(F.col("_known").isNull(), "unknown column").when(F.coalesce(guarded, F.lit(False)), "protected column")
    return j.select("_i", "table_name", "column_name", issue.alias("issue")).orderBy("_i").drop("_i")
