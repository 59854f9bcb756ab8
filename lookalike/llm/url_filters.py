"""Operator 11: URL rules by a sort-merge range join of reversed-host keys.

A rule is a host and the beginning of a path; it fits the host and all its subdomains.  Its
canonical key is the host with its labels reversed, ``/``, and the path: the texts that begin with a
key are one interval of the sorted keys.  A url has such a key for each of its host's endings that
has as many labels as some rule, so that whatever fits it is an interval which holds one of its keys.

Keys of urls and both ends of the intervals are sorted together and swept.  Intervals of prefixes
are nested or apart, so those that are open at a place form a stack: its height is the number of
beginnings less the number of ends so far, and the slot at height h holds the last rule that began
at that height.  The rule on top is the longest that fits the key; of a url's keys the longest rule
wins.  The sweep runs in ranges of the sorted keys: the stacks at the beginnings of the ranges
come from the rules alone, and equal keys are spread by a hash of the row, so that neither a host
nor a url that many rows share fills a task.

All of it is DataFrame functions.  Null urls and those without ``://`` have neither host nor path
and fit no rule; repeated rows and null ids are rows of their own; rules of an empty or null host fit
nothing, a null path is empty; of rules with one host and path ``block`` wins; equally long rules
(host and path together) go by the longer host; no rules: every url gets the method's verdict; an
empty table gives no rows; other columns are only looked at if ``keep`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lookalike.llm.common import table
from lookalike.sources.ranges import Ranges

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict of urls that no rule fits.
DEFAULT = "allow"
#: Repeated rows that are told apart at once.
COPIES = 1 << 20
#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(labels: Column, path: Column) -> Column:
    """Hex digits of the reversed labels, ``/`` and the path: they sort as the bytes do, and leave
    ``G`` as an end that is above all continuations."""
    return F.hex(F.encode(F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path), "UTF-8"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


_AT = ["key", "kind", "salt"]


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", keep: list[str] | None = None, default: str = DEFAULT) -> DataFrame:
    """Columns ``keep``, host, path, rule, verdict: one row per row of ``urls``.

    rules has host, path and verdict (allow or block)."""
    keep = ["page_id"] if keep is None else keep
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    named = rules.select(host.alias("host"), path.alias("path"), "verdict").where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    rule = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("of_host"), F.concat("host", "path").alias("rule"), "verdict")
    named = named.select(canonical(labels, F.col("path")).alias("key"), F.size(labels).alias("n"), rule.alias("entry"))
    counts = sorted(r.n for r in named.select("n").distinct().collect())  # numbers of labels of a host, not rules

    # rows that agree in all columns are one row with a number
    kept = urls.select(F.struct(*keep).alias("kept"), F.col(url_col).cast("string").alias("url")).groupBy("kept", "url").agg(F.count(F.lit(1)).alias("copies"))
    h, p = url_parts(F.col("url"))
    parted = kept.select("kept", "url", "copies", h.alias("host"), p.alias("path"))
    ends = F.filter(F.array(*[F.lit(n) for n in counts]).cast("array<int>"), lambda n: n <= F.size(labels))
    keys = F.transform(ends, lambda n: canonical(F.slice(labels, -n, n), F.col("path")))
    salt = F.xxhash64("kept", "url")
    asked = parted.select("kept", "url", "copies", F.explode_outer(keys).alias("key"), F.lit(2).alias("kind"), salt.alias("salt"))

    step = F.lit(0).cast("bigint")
    edges = F.array(
        F.struct(F.col("key").alias("key"), F.lit(1).alias("kind"), F.lit(1).alias("step"), F.col("entry").alias("entry")),
        F.struct(F.concat("key", F.lit("G")).alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("step"), F.lit(None).cast(named.schema["entry"].dataType).alias("entry")),
    )
    marks = named.select(F.inline(edges)).select("key", "kind", F.lit(0).cast("bigint").alias("salt"), F.col("step").cast("bigint").alias("step"), "entry")
    ranges = Ranges(asked.select(*_AT), _AT)
    marks = marks.withColumn("part", ranges.of())

    # stacks at the beginnings of the ranges, from the rules alone: heights, and the last rule of each height
    sums = marks.groupBy("part").agg(F.sum("step").alias("step"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(ranges.size))).alias("part")
    spark = urls.sparkSession
    every = spark.range(1).select(grid)
    heights = every.join(sums, "part", "left").select("part", F.coalesce(F.sum("step").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    begun = marks.join(F.broadcast(heights), "part")  # a row for each range
    height = F.col("below") + F.sum("step").over(Window.partitionBy("part").orderBy(*_AT).rowsBetween(Window.unboundedPreceding, 0))
    last = begun.withColumn("height", height).where("step > 0").groupBy("part", "height").agg(F.max_by("entry", "key").alias("entry"))
    slots = last.select("height").distinct().select("height", grid).join(last, ["part", "height"], "left")
    under = Window.partitionBy("height").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(F.col("part").alias("_part"), F.col("height").alias("_height"), F.last("entry", ignorenulls=True).over(under).alias("_entry")).where("_entry is not null")

    swept = asked.select("kept", "url", "copies", *_AT, step.alias("step"), F.lit(None).cast(named.schema["entry"].dataType).alias("entry")).withColumn("part", ranges.of())
    both = swept.unionByName(marks, allowMissingColumns=True).join(F.broadcast(heights), "part")
    both = both.withColumn("height", height)
    slot = Window.partitionBy("part", "height").orderBy(*_AT).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("top", F.last("entry", ignorenulls=True).over(slot)).where("kind = 2")
    # rows: ranges by the depth of the rules' nesting
    held = both.join(F.broadcast(slots), (F.col("part") == F.col("_part")) & (F.col("height") == F.col("_height")), "left")
    top = F.when((F.col("height") > 0) & F.col("key").isNotNull(), F.coalesce("top", "_entry"))
    best = held.groupBy("kept", "url", "copies").agg(F.max(top).alias("best"))
    first = F.expr(f"explode(transform(sequence(0, (copies - 1) div {COPIES}), i -> least({COPIES}, copies - i * {COPIES})))")
    told = best.select("kept", "url", "best", first.alias("some")).select("kept", "url", "best", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("some").cast("bigint"))))
    return told.select("kept.*", h.alias("host"), p.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END"
SQL = f"""
WITH rules(h, p, v) AS (VALUES {', '.join(str(r) for r in RULES)}),
u AS (SELECT row_number() OVER () AS i, page_id, coalesce(translate(regexp_extract({_REST}, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT i, arg_max(h || p, (length(h || p), length(h))) AS rule, arg_max(v, (length(h || p), length(h))) AS verdict
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM u LEFT JOIN f USING (i)"""
