"""Masking, disclosure control and disclosure measures (F)."""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.functions.noise import Bits, discrete_gaussian, geometric_noise
from lookalike.functions.rng import SEED, pick, uniform
from lookalike.operators.neighbours import Tree, nearest
from lookalike.operators.profile import RARE, exact_quantiles, unpivoted
from lookalike.sources.ranges import running_sums

#: Bits of a place in a leak scan's table; rows of forbidden strings that may be broadcast once they were counted.
START_BITS, FORBIDDEN_ROWS = 22, 20_000
#: Masking kind by column name, the first match wins (F-01).
KIND_NAMES = [("email", "(?i)e_?mail"), ("phone", "(?i)phone|mobile|fax"), ("first_name", "(?i)first_?name|given_?name"), ("last_name", "(?i)last_?name|surname|family_?name"), ("company", "(?i)company|employer|supplier|s_name"), ("city", "(?i)city|town"), ("street", "(?i)street|address"), ("full_name", "(?i)(^|_)(full_?|customer_?|c_)?name$"), ("identifier", "(?i)(^|_)(id|key|uuid)$|key$")]
KIND_TYPES = {"email": "email", "person_name": "full_name", "phone_number": "phone", "identifier": "identifier"}
FIRST = ["Ada", "Ben", "Cleo", "Dana", "Eli", "Fay", "Gil", "Hana", "Ivo", "Jana", "Kai", "Lena", "Milo", "Nora", "Otis", "Pia"]
LAST = ["Adler", "Brook", "Castel", "Drum", "Eden", "Frost", "Grove", "Hale", "Ingram", "Jarvis", "Keller", "Lund", "Marsh", "North", "Oakley", "Pryor"]
COMPANY = ["Alder Works", "Birch & Sons", "Cobalt Trading", "Dune Logistics", "Ember Foods", "Fjord Textiles", "Garnet Tools", "Harbor Supply"]
CITY = ["Aldport", "Brimstad", "Corvale", "Dunmere", "Eastwick", "Farholm", "Glenrock", "Highmoor"]
ID_PREFIXES = [("(?i)account", "ACC-"), ("(?i)cust", "CUST-"), ("(?i)trans|txn", "TXN-"), ("(?i)order", "ORD-"), ("(?i)part|product", "PRD-")]


def context_kind(names: DataFrame) -> DataFrame:
    """names: (column_name, semantic_type).  Kind by name, else by type, else none (F-01)."""
    by_name = F.coalesce(*[F.when(F.col("column_name").rlike(p), F.lit(k)) for k, p in KIND_NAMES])
    by_type = F.coalesce(*[F.when(F.col("semantic_type") == t, F.lit(k)) for t, k in KIND_TYPES.items()])
    return names.select("column_name", F.coalesce(by_name, by_type, F.lit("none")).alias("kind"))


def mask_value(c: Column, table: str, column: str, kind: str, seed: int = SEED) -> Column:
    """Stand-in of a value: a pure function of (seed, table, column, value) (F-02, F-04)."""
    u = lambda lane: uniform(f"mask:{table}.{column}:{lane}", c, seed=seed)
    if kind == "full_name":
        out = F.concat_ws(" ", pick(FIRST, u("first")), pick(LAST, u("last")))
    elif kind in ("first_name", "last_name", "company", "city"):
        out = pick({"first_name": FIRST, "last_name": LAST, "company": COMPANY, "city": CITY}[kind], u(kind))
    elif kind == "street":
        out = F.concat_ws(" ", (F.floor(u("no") * 999) + 1).cast("string"), pick(LAST, u("street")), F.lit("Street"))
    elif kind == "phone":
        out = F.concat(F.lit("+1-555-"), F.lpad(F.floor(u("phone") * 10_000_000).cast("string"), 7, "0"))
    elif kind == "email":
        out = F.concat(F.lower(pick(FIRST, u("first"))), F.lit("."), F.lpad(F.floor(u("no") * 1_000_000).cast("string"), 6, "0"), F.lit("@example.com"))
    else:
        prefix = next((x for p, x in ID_PREFIXES if re.search(p, column)), "ID-")
        out = F.concat(F.lit(prefix), F.lpad(F.floor(u("id") * 10_000_000_000).cast("long").cast("string"), 10, "0"))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def mask_table(df: DataFrame, table: str, kinds: dict[str, str], seed: int = SEED) -> DataFrame:
    """Columns replaced by stand-ins; nulls stay, equal values stay equal (F-02)."""
    return df.withColumns({c: mask_value(F.col(c).cast("string"), table, c, k, seed) for c, k in kinds.items()})


def mask_email(df: DataFrame, email: str, name: str) -> DataFrame:
    """Email made of the row's masked name (F-03)."""
    local = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", ".")
    return df.withColumn(email, F.when(F.col(email).isNull(), F.lit(None)).otherwise(F.concat(local, F.lit("@example.com"))))


def unchanged_share(src: DataFrame, masked: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(column_name, unchanged): share of non-null values that masking left as they were (F-05)."""
    j = src.select(*key, *[F.trim(F.col(c).cast("string")).alias(f"a.{c}") for c in columns]).join(masked.select(*key, *[F.trim(F.col(c).cast("string")).alias(f"b.{c}") for c in columns]), key)
    wide = j.agg(*[F.coalesce(F.avg((F.col(f"`a.{c}`") == F.col(f"`b.{c}`")).cast("double")), F.lit(0.0)).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(c, 6).alias("unchanged")) for c in columns])).alias("r")).select("r.*")


def assert_masked(src: DataFrame, masked: DataFrame, key: list[str], columns: list[str], most: float = 0.25) -> None:
    """Raises if too much of a column is unchanged (F-05)."""
    bad = [r.column_name for r in unchanged_share(src, masked, key, columns).collect() if r.unchanged > most]
    if bad:
        raise ValueError(f"columns are not masked: {', '.join(bad)}")


def leak_scan(texts: DataFrame, text_col: str, id_col: str, forbidden: DataFrame, value_col: str, least: int = 3, head: int = 8) -> DataFrame:
    """(id, value) of forbidden strings of ``least`` characters or more that occur anywhere in texts,
    white space squeezed (F-06).

    A text meets only the strings whose first ``head`` characters (or all, if it has fewer) occur
    in it, so nothing is compared all with all.  Tasks have a table of bits of these beginnings, of
    fixed size, and send on what it has only: texts with a hit carry their beginnings, no others move."""
    import numpy as np
    import pyarrow as pa

    squeeze = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    f = forbidden.select(F.trim(F.col(value_col).cast("string")).alias("value")).where(F.char_length("value") >= least).distinct()
    f = f.withColumns({"want": squeeze(F.col("value")), "start": F.substring(squeeze(F.col("value")), 1, head)}).withColumn("size", F.char_length("start"))
    said = texts.select(F.col(id_col).alias("id"), squeeze(F.col(text_col)).alias("body"))
    kind = said.schema["id"].dataType.simpleString()

    def hashed(codes: np.ndarray, n: int) -> np.ndarray:
        """Places in the table of bits of all n characters in a row."""
        h = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)] + np.uint64(1)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - START_BITS)

    codes_of = lambda x: np.frombuffer(x.encode("utf-32-le"), "<u4").astype(np.uint64)

    def marks(batches):
        for batch in batches:
            starts = batch.column(0).to_pylist()
            at = [int(hashed(codes_of(x), len(x))[0]) for x in starts]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in starts], pa.int32()), pa.array(at, pa.int64())], ["size", "at"])

    table: dict = {}
    for r in f.select("start").distinct().mapInArrow(marks, "size int, at long").distinct().toLocalIterator():  # at most the table's bits for each size
        table.setdefault(r["size"], np.zeros(1 << START_BITS - 3, np.uint8))[r["at"] >> 3] |= 1 << (r["at"] & 7)
    if not table:
        return said.select("id", F.lit(None).cast("string").alias("value")).limit(0)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            who, found = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                codes, starts = codes_of(body or ""), set()
                for n, bits in shared.value.items():
                    h = hashed(codes, n)
                    hit = np.nonzero((bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1)[0]
                    starts.update(body[k : k + n] for k in hit.tolist())
                if starts:
                    who.append(i)
                    found.append(list(starts))
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found, pa.list_(pa.string()))], ["id", "body", "starts"])

    pieces = said.mapInArrow(run, f"id {kind}, body string, starts array<string>").select("id", "body", F.explode("starts").alias("start"))
    wanted = f.select("start", "want", "value")
    hits = pieces.join(F.broadcast(wanted) if f.count() <= FORBIDDEN_ROWS else wanted, "start").where(F.contains("body", "want"))
    return hits.select("id", "value").distinct()


def replace_rare(df: DataFrame, column: str, support: int = 20) -> DataFrame:
    """Values with too few rows become one (F-07); counts are joined, not windowed."""
    n = df.groupBy(column).agg(F.count("*").alias("_n"))
    return df.join(n, column, "left").withColumn(column, F.when(F.col("_n") < support, RARE).otherwise(F.col(column))).drop("_n").select(*df.columns)


def learn_id_format(df: DataFrame, column: str, separator: str = "[^A-Za-z0-9]", agreement: float = 0.8) -> DataFrame:
    """(position, kind, literal, width, start_at) of the parts of an identifier (F-08)."""
    parts = df.where(F.col(column).isNotNull()).select(F.posexplode(F.split(column, separator)).alias("position", "part"))
    agg = parts.groupBy("position").agg(F.count("*").alias("n"), F.count_distinct("part").alias("d"), F.max("part").alias("literal"), F.avg(F.col("part").rlike("^[0-9]+$").cast("double")).alias("numeric"), F.max(F.char_length("part")).alias("width"), F.min(F.expr("try_cast(part as bigint)")).alias("start_at"))
    kind = F.when(F.col("d") == 1, "literal").when(F.col("numeric") >= agreement, "numeric").otherwise("text")
    return agg.select("position", kind.alias("kind"), F.when(kind == "literal", F.col("literal")).alias("literal"), "width", F.when(kind == "numeric", F.col("start_at")).alias("start_at"))


def generate_ids(spark, n: int, parts: list[tuple[str, str | None, int]], separator: str, start_at: int = 0) -> DataFrame:
    """Sequential identifiers of a learned format: unique by construction (F-09)."""
    number = F.col("id").cast("string")
    cols = [F.lit(text) if kind == "literal" else F.lpad(number, width, "0") for kind, text, width in parts]
    return spark.range(start_at, start_at + n).select("id", F.concat_ws(separator, *cols).alias("identifier"))


def privacy_policy(profile: DataFrame) -> DataFrame:
    """Action per column from (column_name, sensitivity, distinct_count) (F-11)."""
    s = F.col("sensitivity")
    action = F.when(s == "direct_identifier", "transform").when(s == "free_text", "exclude").when(s == "quasi_identifier", F.when(F.col("distinct_count") <= 10, "suppress").otherwise("bucket")).otherwise("preserve")
    return profile.select("column_name", action.alias("action"))


def redact_profile(frequencies: DataFrame, policy: DataFrame) -> DataFrame:
    """Labels of bucketed and suppressed columns become CATEGORY_nnnn, others go (F-10)."""
    j = frequencies.join(policy, "column_name").where(~F.col("action").isin("transform", "exclude"))
    place = F.dense_rank().over(Window.partitionBy("column_name").orderBy("value"))
    label = F.concat(F.lit("CATEGORY_"), F.lpad(place.cast("string"), 4, "0"))
    return j.select("column_name", F.when(F.col("action").isin("bucket", "suppress"), label).otherwise(F.col("value")).alias("value"), "n")


def verify_source_free(profile: DataFrame, raw: DataFrame, columns: list[str]) -> DataFrame:
    """Labels of the profile that are raw values of sensitive columns; empty is a pass (F-12)."""
    return profile.where(F.col("column_name").isin(columns)).join(unpivoted(raw, columns).distinct(), ["column_name", "value"], "left_semi").select("column_name", "value")


def dp_histogram(df: DataFrame, column: str, epsilon: float, threshold: int = 0, domain: list[str] | None = None, *, secret: int) -> DataFrame:
    """Counts per value of a public domain with discrete Laplace noise; small ones are left out (F-13).

    secret: the seed of the noise, new for each release and told to nobody; who knows it can take
    the noise off again.  A fixed one is for tests.  ``functions.noise.release`` books the spend."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    if domain is not None:
        public = df.sparkSession.createDataFrame([(v,) for v in domain], "value string")
        counts = public.join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    noisy = F.col("n") + geometric_noise(f"dp:{column}", "value", scale=1 / epsilon, secret=secret)
    return counts.select("value", noisy.alias("noisy")).where(F.col("noisy") >= threshold)


#: Units that the width of a column's public bounds is cut in.
UNITS = 1 << 20


def dp_mean_var(df: DataFrame, column: str, lower: float, upper: float, epsilon: float, *, secret: int) -> DataFrame:
    """Mean and variance with values clipped to public bounds, half the budget each (F-14).

    Values become whole units of the bounds' width; the sums of units and of their squares are
    integers and get integer noise.  The number of rows counts as public; secret as in dp_histogram."""
    unit = (upper - lower) / UNITS
    c = F.least(F.greatest(F.col(column), F.lit(lower)), F.lit(upper))
    whole = F.floor((c - F.lit(lower)) / F.lit(unit) + 0.5).cast("decimal(20,0)")
    s = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.sum(whole).alias("s"), F.sum(whole * whole).alias("q"))
    noise = lambda name, width: geometric_noise(f"dp:{column}", F.lit(name), scale=2 * width / epsilon, secret=secret)
    mean = (F.col("s") + noise("mean", UNITS)).cast("double") / F.col("n")
    square = (F.col("q") + noise("var", UNITS * UNITS)).cast("double") / F.col("n")
    return s.select(F.round(F.lit(lower) + mean * unit, 6).alias("dp_mean"), F.round(F.greatest(square - mean * mean, F.lit(0.0)) * (unit * unit), 4).alias("dp_variance"))


#: Units of a standard deviation, and the norm that rows are clipped to.
MOMENT_UNITS, CLIP = 1 << 24, 3.0


def second_moments(df: DataFrame, columns: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row (n, s0_0, s1_0, s1_1, ...): sums of products of whole units of rows clipped to norm 3.

    Standardised by public bounds, not by the data; rows with a null are left out."""
    k = len(columns)
    z = [(F.col(c) - (bounds[c][0] + bounds[c][1]) / 2) / ((bounds[c][1] - bounds[c][0]) / math.sqrt(12)) for c in columns]
    norm = F.sqrt(sum((x * x for x in z), F.lit(0.0)))
    scale = F.least(F.lit(1.0), CLIP / F.greatest(norm, F.lit(1e-9)))
    whole = df.dropna(subset=columns).select(*[F.floor(x * scale * MOMENT_UNITS + 0.5).cast("decimal(10,0)").alias(f"z{i}") for i, x in enumerate(z)])
    return whole.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(f"z{i}") * F.col(f"z{j}")), F.lit(0)).alias(f"s{i}_{j}") for i in range(k) for j in range(i + 1)])


def dp_correlation(df: DataFrame, columns: list[str], bounds: dict[str, tuple[float, float]], epsilon: float, delta: float = 1e-6, *, secret: int) -> list[list[float]]:
    """Noised second moment of rows clipped to norm 3, made a correlation matrix (F-15).

    Rows are rounded to whole units, so moments are integers; the driver holds k x k of them and adds
    exact discrete Gaussian draws; secret as in dp_histogram."""
    import numpy as np

    k, one = len(columns), MOMENT_UNITS
    sums = second_moments(df, columns, bounds).first()
    reach = CLIP + math.sqrt(k) / one  # rounding may carry a row's norm so far
    variance = Fraction(reach**2 * one * one * math.sqrt(2 * math.log(1.25 / delta)) / epsilon) ** 2
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            noisy = int(sums[f"s{i}_{j}"]) + discrete_gaussian(Bits(secret, f"dp:moment:{i}:{j}"), variance)
            m[i, j] = m[j, i] = noisy / (one * one) / max(1, sums["n"])
    w, v = np.linalg.eigh(m)
    m = v @ np.diag(np.maximum(w, 1e-6)) @ v.T
    d = np.sqrt(np.diag(m))
    return np.clip(m / np.outer(d, d), -1, 1).tolist()


def fit_dp_copula(df: DataFrame, columns: list[str], bounds: dict[str, tuple[float, float]], epsilon: float, delta: float = 1e-6, *, secret: int):
    """Copula with half the budget on noisy marginal histograms, half on the correlation (F-17)."""
    import numpy as np

    from lookalike.operators.models import Copula

    bins, grids, nulls = 20, {}, {}
    for c in columns:
        lo, hi = bounds[c]
        slot = F.least(F.greatest(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("string")
        h = {r.value: max(r.noisy, 0.0) for r in dp_histogram(df.withColumn("_s", F.coalesce(slot, F.lit("null"))), "_s", epsilon / 2 / len(columns), domain=[*map(str, range(bins)), "null"], threshold=-(1 << 62), secret=f"{secret}:{c}").collect()}
        w = np.array([h[str(i)] for i in range(bins)]) + 1e-9
        nulls[c] = h["null"] / (h["null"] + w.sum())
        grids[c] = np.interp(np.linspace(0, 1, 21), np.concatenate([[0], np.cumsum(w) / w.sum()]), np.linspace(lo, hi, bins + 1)).tolist()
    return Copula(columns, grids, nulls, dp_correlation(df, columns, bounds, epsilon / 2, delta, secret=secret))


def ledger(spends: DataFrame, epsilon: float, delta: float, by: list[str] = ()) -> DataFrame:
    """spends: (step, epsilon, delta, purpose), and ``by``, whose budget it is.  Adds running sums and
    whether each was allowed (F-16)."""
    upto = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    e, d = F.sum("epsilon").over(upto), F.sum("delta").over(upto)
    return spends.withColumns({"spent_epsilon": F.round(e, 9), "spent_delta": F.round(d, 12), "allowed": (F.round(e, 9) <= epsilon) & (F.round(d, 12) <= delta)})


def k_anonymity(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least group size, share of singled-out rows, number of groups (F-18)."""
    g = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return g.agg(F.min("n").alias("k"), F.round(F.try_divide(F.count_if(F.col("n") == 1).cast("double"), F.sum("n")), 6).alias("singled_out"), F.count("*").alias("groups"))


def row_digest(columns: list[str]) -> Column:
    """Digest of a row trimmed and lower-cased, null as ''; lengths keep fields apart."""
    tidy = [F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns]
    return F.md5(F.concat_ws("|", *[x for t in tidy for x in (F.char_length(t).cast("string"), t)]))


def exact_match_rate(src: DataFrame, syn: DataFrame, columns: list[str]) -> DataFrame:
    """Share of synthetic rows that are source rows (F-19)."""
    known = src.select(row_digest(columns).alias("h")).distinct().withColumn("hit", F.lit(1))
    j = syn.select(row_digest(columns).alias("h")).join(known, "h", "left")
    return j.agg(F.count("*").alias("row_count"), F.count("hit").alias("matches")).withColumn("rate", F.coalesce(F.round(F.try_divide(F.col("matches").cast("double"), "row_count"), 6), F.lit(0.0)))


def pii_replay(src: DataFrame, syn: DataFrame, columns: list[str]) -> DataFrame:
    """Synthetic values of protected columns that occur in the source (F-20)."""
    tidy = F.lower(F.trim("value"))
    a = unpivoted(src, columns).where("value is not null").select("column_name", tidy.alias("v")).distinct()
    b = unpivoted(syn, columns).where("value is not null").select("column_name", tidy.alias("v"))
    hits = b.join(a, ["column_name", "v"], "left_semi").groupBy("column_name").agg(F.count("*").alias("replays"))
    names = b.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(hits, "column_name", "left").select("column_name", F.coalesce("replays", F.lit(0)).alias("replays"))


def scrub_replays(syn: DataFrame, protected: DataFrame, column: str, key: str, fresh, rounds: int = 3) -> DataFrame:
    """Values that the source has are drawn anew, a bounded number of times (F-21).

    protected: one column of raw values.  fresh(attempt) gives a column of new values."""
    known = protected.select(F.lower(F.trim(F.col(protected.columns[0]).cast("string"))).alias("_v")).where("_v is not null").distinct().withColumn("_hit", F.lit(True))
    out = syn
    for attempt in range(1, rounds + 1):
        j = out.withColumn("_v", F.lower(F.trim(F.col(column).cast("string")))).join(known, "_v", "left")
        out = j.withColumn(column, F.when(F.col("_hit"), fresh(attempt)).otherwise(F.col(column))).drop("_v", "_hit")
    return out.select(*syn.columns)


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Repeated non-null values per column (F-22)."""
    from lookalike.operators.clean import identifier_report

    return identifier_report(df, columns)


def dcr(syn: DataFrame, train: DataFrame, holdout: DataFrame, vector: str, key: str) -> DataFrame:
    """Share of synthetic rows closer to training rows than 1 % of holdout rows are, and the ratio
    of median distances (F-23)."""
    tree = Tree(train, vector)
    s, h = nearest(syn, tree, vector, key), nearest(holdout, tree, vector, key)
    at = lambda d, p: exact_quantiles(d, {"d": F.col("distance")}, p).select(*[F.col("q")[i].alias(f"q{i}") for i in range(len(p))])
    held = at(h, [0.01, 0.5]).select(F.col("q0").alias("floor"), F.col("q1").alias("mh"))
    share = s.crossJoin(F.broadcast(held)).agg(F.round(F.avg((F.col("distance") < F.col("floor")).cast("double")), 6).alias("near_duplicate_share"), F.max("mh").alias("mh"))  # one row of two numbers
    return share.crossJoin(F.broadcast(at(s, [0.5]))).select("near_duplicate_share", F.round(F.col("q0") / F.col("mh"), 4).alias("median_ratio"))


def mia_auc(syn: DataFrame, train: DataFrame, holdout: DataFrame, vector: str, key: str) -> DataFrame:
    """AUC of telling members by their distance to synthetic rows, ties averaged (F-24).

    Ranks come from counts per distance, added up over ranges of distances."""
    tree = Tree(syn, vector)
    a = nearest(train, tree, vector, key).select(F.round("distance", 6).alias("d"), F.lit(1).alias("m"))
    b = nearest(holdout, tree, vector, key).select(F.round("distance", 6).alias("d"), F.lit(0).alias("m"))
    g = a.unionByName(b).groupBy("d").agg(F.sum("m").alias("members"), F.sum(1 - F.col("m")).alias("others"))
    r = running_sums(g, [], "d", ["others"]).withColumn("above", F.col("all_others") - F.col("upto_others"))
    pairs = F.sum(F.col("members") * (F.col("above") + F.col("others") / 2))
    return r.agg(F.round(pairs / (F.sum("members") * F.sum("others")), 6).alias("auc"))


