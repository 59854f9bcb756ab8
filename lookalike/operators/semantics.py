"""Semantic types of columns: evidence as rows (column, type, weight), then a ranking (C)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.operators.profile import category_frequencies, column_warnings, physical_type, physical_types, profile_base, profile_strings, string_columns, to_long


#: What the last word of a column name says: semantic type, weight, words in the singular.
HEADS = {
    "identifier": (3.0, "id uuid guid key"),
    "email": (3.0, "email mail"),
    "person_name": (4.0, "surname forename nickname firstname lastname fullname"),
    "phone_number": (3.0, "phone telephone tel mobile cell fax"),
    "postal_code": (3.5, "zip zipcode postal postcode pincode"),
    "address": (4.0, "address addr street"),
    "city": (4.0, "city town village municipality"),
    "state": (3.5, "state province county"),
    "country": (3.5, "country nation nationality"),
    "company": (4.0, "company firm employer organisation organization vendor supplier"),
    "datetime": (2.5, "date datetime time timestamp ts dt at"),
    "boolean": (2.5, "flag indicator"),
    "category": (1.5, "code status type kind category class segment priority branch office department"),
    "free_text": (2.0, "text description summary comment remark note bio"),
}
#: Last words that leave the meaning to the word before them, and the types whose words may stand there.
CARRIERS = "name number no code line"
CARRIED = "phone_number postal_code address city state country company"
#: Words that make a person's name of ``name``: parts of one, and people that have one.
PEOPLE = "first middle last given family maiden full person customer client contact patient employee manager"
#: First words of questions.
ASKS = "is has can should was"
#: Columns with one of these words name things or organisations: values that look like people's names are none.
THINGS = "branch office location department product item company firm organisation organization business vendor supplier provider facility hospital clinic"


def name_words(c: Column) -> Column:
    """Lower-cased words of a name, cut at case changes and at all but letters and digits."""
    apart = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda w: w != "")


def singular(c: Column) -> Column:
    return F.regexp_replace(c, "^(.*.[^su])s$", "$1")


#: Evidence of physical types: physical type, semantic type, weight.
DTYPE_EVIDENCE = [("boolean", "boolean", 4.0), ("datetime", "datetime", 4.0), ("integer", "numerical", 2.0), ("float", "numerical", 2.0), ("string", "free_text", 0.5), ("string", "category", 0.5)]
#: Evidence of value shapes: semantic type, pattern, weight.
PATTERN_EVIDENCE = [
    ("email", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$", 4.0),
    ("person_name", r"^[A-Z][A-Za-z'-]+( [A-Z][.])?( [A-Z][A-Za-z'-]+){1,3}$", 3.5),
    ("postal_code", r"^[0-9]{5}(-[0-9]{4})?$", 2.0),
    ("postal_code", r"^[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}$", 2.0),
    # 9 to 15 digits, and a plus or something between them: no date and no bare number
    ("phone_number", r"^([+][(]?[0-9]([ ().-]{0,2}[0-9]){8,14}|[(]?[0-9]{3,5}[) .-]{1,2}[0-9]{3,5}[ .-]?[0-9]{3,5}|[0-9]{5}[ .-][0-9]{5}|[0-9]{2}([ .-][0-9]{2}){4})$", 4.0),
    ("datetime", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]+)?$", 3.0),
    ("boolean", r"(?i)^(true|false|yes|no|0|1|t|f|y|n)$", 3.0),
]
NEAR_UNIQUE, MAX_DISTINCT, MAX_RATIO, MAX_LENGTH, MATCH = 0.98, 20, 0.5, 30.0, 0.8
MIN_CONFIDENCE, MARGIN = 0.5, 0.15
#: Weights of near-unique values, few values, one-sided or constant columns, declared keys; distinct values and share that make a column one-sided.
W_UNIQUE, W_FEW, W_QUALITY, W_KEY = 0.8, 2.0, 0.5, 3.0
FREQUENT, ONE_SIDED = 50, 0.95


def score_names(spark, columns: list[str]) -> DataFrame:
    """Evidence of column names (C-01): the type of the last word, or of the one before a carrier."""
    words = name_words(F.col("column_name"))
    named = spark.createDataFrame([(c,) for c in columns], "column_name string").select("column_name", words.alias("w"))
    named = named.select("column_name", F.element_at("w", 1).alias("first"), singular(F.try_element_at("w", F.lit(-1))).alias("head"), singular(F.try_element_at("w", F.lit(-2))).alias("before"))
    of = lambda said: F.array(*[F.lit(w) for w in said.split()])
    among = lambda c, said: F.coalesce(F.array_contains(of(said), F.col(c)), F.lit(False))
    carried = among("head", CARRIERS)
    hits = []
    for semantic, (weight, said) in HEADS.items():
        hit = among("head", said)
        if semantic in CARRIED.split():
            hit = hit | carried & among("before", said)
        elif semantic == "person_name":
            hit = hit | (F.col("head") == "name") & (F.col("before").isNull() | among("before", PEOPLE))
        elif semantic == "boolean":
            hit = hit | among("first", ASKS)
        elif semantic == "category":
            hit = hit & ~(carried & among("before", HEADS["postal_code"][1]))
        elif semantic == "email":
            hit = hit | F.contains("column_name", F.lit("email"))
        hits.append(F.when(hit, F.struct(F.lit(semantic).alias("semantic"), F.lit(weight).alias("weight"))))
    return named.select("column_name", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("r")).select("column_name", "r.*")


def names_things(column: str) -> bool:
    """Whether a column's name speaks of things, organisations or identifiers (C-04's guard)."""
    import re

    words = re.split("[^a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1_\2", column).lower())
    return bool({re.sub("^(.*.[^su])s$", r"\1", w) for w in words} & {*THINGS.split()}) or words[-1] in HEADS["identifier"][1].split()


def score_dtypes(df: DataFrame) -> DataFrame:
    """Evidence of physical types (C-02)."""
    rules = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("semantic"), F.lit(w).alias("weight")) for k, t, w in DTYPE_EVIDENCE])
    j = physical_types(df).select("column_name", "inferred_dtype", F.explode(rules).alias("r"))
    return j.where("inferred_dtype = r.kind").select("column_name", "r.semantic", "r.weight")


def score_cardinality(df: DataFrame) -> DataFrame:
    """Nearly unique values speak for an identifier, few ones for a category (C-03)."""
    j = profile_base(df).join(physical_types(df), "column_name")
    j = j.join(profile_strings(df), "column_name", "left") if string_columns(df) else j.withColumn("mean_length", F.lit(None).cast("double"))
    long = F.coalesce((F.col("inferred_dtype") == "string") & (F.col("mean_length") > MAX_LENGTH), F.lit(False))
    unique = (F.col("distinct_count") > 1) & (F.col("distinct_ratio") >= NEAR_UNIQUE) & (F.col("inferred_dtype") != "float") & ~long
    few = F.col("inferred_dtype").isin("string", "boolean") & (F.col("distinct_count") <= MAX_DISTINCT) & (F.col("distinct_ratio") <= MAX_RATIO)
    said = F.array(F.when(unique, F.struct(F.lit("identifier").alias("semantic"), F.lit(W_UNIQUE).alias("weight"))), F.when(few, F.struct(F.lit("category").alias("semantic"), F.lit(W_FEW).alias("weight"))))
    return j.where("row_count > 0").select("column_name", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("r")).select("column_name", "r.semantic", "r.weight")


def score_patterns(df: DataFrame) -> DataFrame:
    """Value shapes that most values have, measured over all rows in one pass (C-04).

    People's names are not looked for in columns whose names speak of things."""
    cols = string_columns(df)
    aggs = {c: {"n": F.count(c), **{f"p{i}": F.count_if(F.trim(c).rlike(p)) for i, (_, p, _) in enumerate(PATTERN_EVIDENCE)}} for c in cols}
    rules = F.array(*[F.struct(F.lit(t).alias("semantic"), F.lit(w).alias("weight"), F.col(f"p{i}").alias("hits")) for i, (t, _, w) in enumerate(PATTERN_EVIDENCE)])
    long = to_long(df, aggs).select("column_name", "n", F.explode(rules).alias("r"))
    guarded = (F.col("r.semantic") == "person_name") & F.col("column_name").isin([c for c in cols if names_things(c)])
    return long.where(f"n > 0 and r.hits >= {MATCH} * n").where(~guarded).select("column_name", "r.semantic", "r.weight")


def score_quality(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Imbalanced or constant columns lean to category; declared keys are identifiers (C-05)."""
    w = column_warnings(profile_base(df), category_frequencies(df, df.columns)).where("warnings like '%severe_category_imbalance%' or warnings like '%constant_column%'")
    out = w.select("column_name", F.lit("category").alias("semantic"), F.lit(W_QUALITY).alias("weight"))
    if key:
        keys = df.sparkSession.createDataFrame([(k, "identifier", W_KEY) for k in key], "column_name string, semantic string, weight double")
        out = out.unionByName(keys)
    return out


def evidence(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    parts = [score_names(df.sparkSession, df.columns), score_dtypes(df), score_cardinality(df), score_quality(df, key)]
    if string_columns(df):
        parts.append(score_patterns(df))
    return reduce(DataFrame.unionByName, parts)


def resolve_semantics(scores: DataFrame) -> DataFrame:
    """Best type per column, its confidence, status and up to three alternatives (C-06)."""
    total = scores.groupBy("column_name", "semantic").agg(F.sum("weight").alias("score"))
    per = Window.partitionBy("column_name")
    by = per.orderBy(F.desc("score"), "semantic")
    r = total.withColumns({"share": F.round(F.col("score") / F.sum("score").over(per), 6), "place": F.row_number().over(by)})
    r = r.withColumn("next", F.lead("share", 1, 0.0).over(by))
    others = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when((F.col("place") > 1) & (F.col("place") <= 4), F.struct("place", "semantic")))), lambda x: x.semantic))
    best = r.groupBy("column_name").agg(*[F.max(F.when(F.col("place") == 1, F.col(c))).alias(n) for c, n in (("semantic", "semantic_type"), ("share", "confidence"), ("next", "runner_up"))], others.alias("alternatives"))
    unsure = (F.col("confidence") < MIN_CONFIDENCE) | (F.col("confidence") - F.col("runner_up") < MARGIN)
    return best.select("column_name", "semantic_type", "confidence", F.when(unsure, "REVIEW_REQUIRED").otherwise("proposed").alias("status"), "alternatives")


def infer(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Semantic types of a table.  All evidence is aggregates, so parts of a table give the same (C-07)."""
    return resolve_semantics(evidence(df, key))


def counters(df: DataFrame) -> DataFrame:
    """What a part of a table says about each column but for its values: rows, values, whether all
    fractions are 0, letters, and hits of each value shape.  Counters of parts add up (J-02)."""
    aggs, shaped = {}, string_columns(df)
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), physical_type(f)
        hits = [F.count_if(F.trim(c).rlike(p)) for _, p, _ in PATTERN_EVIDENCE] if f.name in shaped else [F.lit(0).cast("long")] * len(PATTERN_EVIDENCE)
        fraction = F.count_if(c != F.round(c)) if kind == "float" else F.lit(0).cast("long")
        letters = F.sum(F.char_length(c)) if f.name in shaped else F.lit(None).cast("long")
        aggs[f.name] = {"physical": F.first(F.lit(kind)), "rows": F.count(F.lit(1)), "values": F.count(c), "fractions": fraction, "letters": letters, "hits": F.array(*hits)}
    return to_long(df, aggs)


def merged_counters(parts: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("rows", "values", "fractions", "letters")]
    return parts.groupBy("column_name").agg(F.max("physical").alias("physical"), *sums, F.array(*[F.sum(F.col("hits")[i]) for i in range(len(PATTERN_EVIDENCE))]).alias("hits"))


def evidence_of(counted: DataFrame, values: DataFrame, columns: list[str], key: list[str] | None = None) -> DataFrame:
    """The evidence of C-01 to C-05 from merged counters and merged counts of hashed values."""
    v = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("top"))
    j = counted.join(v, "column_name", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    kind = F.when(F.col("values") == 0, "unknown").when((F.col("physical") == "float") & (F.col("fractions") == 0), "integer").otherwise(F.col("physical"))
    ratio = F.round(F.try_divide(F.col("distinct").cast("double"), "rows"), 6)
    long = F.coalesce((kind == "string") & (F.round(F.try_divide("letters", "values"), 6) > MAX_LENGTH), F.lit(False))
    some = F.col("rows") > 0
    unique = some & (F.col("distinct") > 1) & (ratio >= NEAR_UNIQUE) & (kind != "float") & ~long
    few = some & kind.isin("string", "boolean") & (F.col("distinct") <= MAX_DISTINCT) & (ratio <= MAX_RATIO)
    constant = (F.col("values") > 0) & (F.col("distinct") <= 1)
    one_sided = (F.col("distinct") > 1) & (F.col("distinct") <= FREQUENT) & (F.col("top") / F.col("rows") >= ONE_SIDED)
    said = [(kind == k, t, w) for k, t, w in DTYPE_EVIDENCE]
    said += [(unique, "identifier", W_UNIQUE), (few, "category", W_FEW), (constant | one_sided, "category", W_QUALITY)]
    thing = F.col("column_name").isin([c for c in columns if names_things(c)])
    said += [((F.col("values") > 0) & (F.col("hits")[i] >= MATCH * F.col("values")) & (~thing if t == "person_name" else F.lit(True)), t, w) for i, (t, _, w) in enumerate(PATTERN_EVIDENCE)]
    rows = F.filter(F.array(*[F.when(c, F.struct(F.lit(t).alias("semantic"), F.lit(w).alias("weight"))) for c, t, w in said]), lambda x: x.isNotNull())
    spark = counted.sparkSession
    out = score_names(spark, columns).unionByName(j.select("column_name", F.explode(rows).alias("r")).select("column_name", "r.*"))
    return out.unionByName(spark.createDataFrame([(k, "identifier", W_KEY) for k in key], "column_name string, semantic string, weight double")) if key else out


def merge_contract(candidates: DataFrame, prior: DataFrame, decisions: DataFrame) -> DataFrame:
    """decision, else approved prior, else candidate, else prior, else review (C-08)."""
    c = candidates.select("column_name", F.col("semantic_type").alias("c"), F.col("status").alias("cs"))
    p = prior.select("column_name", F.col("semantic_type").alias("p"), F.col("status").alias("ps"), "revision")
    d = decisions.select("column_name", F.col("semantic_type").alias("d"))
    j = c.join(p, "column_name", "full").join(d, "column_name", "full")
    approved = F.when(F.col("ps") == "approved", F.col("p"))
    status = F.when(F.col("d").isNotNull(), "approved").when(approved.isNotNull(), "approved").otherwise(F.coalesce("cs", "ps", F.lit("REVIEW_REQUIRED")))
    return j.select("column_name", F.coalesce("d", approved, "c", "p").alias("semantic_type"), status.alias("status"), (F.coalesce("revision", F.lit(0)) + 1).alias("revision"))


#: Table roles by name (C-10).
ROLES = [("reference", r"(?i)^(region|nation|country|currency|category|status)s?$"), ("line_item", r"(?i)line_?item|_items?$"), ("activity", r"(?i)event|log|activity|session"), ("transaction", r"(?i)order|payment|transaction|invoice")]


def table_role(names: DataFrame) -> DataFrame:
    """Role of each table by its name."""
    return names.select("table_name", F.coalesce(*[F.when(F.col("table_name").rlike(p), F.lit(r)) for r, p in ROLES], F.lit("entity")).alias("role"))


def generation_levels(spark, tables: list[str], fks: list[tuple[str, str]]) -> DataFrame:
    """(table_name, level) such that parents come first; tables in a cycle get level -1 (G-24).
    Runs over table names only."""
    parents = {t: {p for c, p in fks if c == t and p != t} for t in tables}
    level: dict[str, int] = {}
    while ready := [t for t in tables if t not in level and parents[t] <= level.keys()]:
        level |= {t: max((level[p] + 1 for p in parents[t]), default=0) for t in ready}
    return spark.createDataFrame([(t, level.get(t, -1)) for t in tables], "table_name string, level int")
