"""Operator 11."""

import random
from collections import Counter

from pyspark.sql import types as T

RULE = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "verdict", "key")])
PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), *(T.StructField(n, T.StringType()) for n in ("host", "key", "part", "kept"))])
AZ = {i: i + 32 for i in range(65, 91)}


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = rest[:cut].translate(AZ), rest[cut:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in ((h.translate(AZ) if h else "", p or "", v) for h, p, v in rules) if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["odd"] * 4) for r in rows], PAGE)


def test_against_brute_force(spark):
    from lookalike.llm.url_filters import judge

    r = random.Random(11)
    part = lambda: r.choice(["a", "b", "ab", "é", "\U0010ffff", "a b", "-", ""])
    host = lambda: ".".join([part() for _ in range(r.randrange(4))] + [r.choice(["org", "com", "ORG", "o"])])
    path = lambda: r.choice(["", "/", "//", "x"]) + "/".join(part() for _ in range(r.randrange(4)))
    rules = [(host(), path(), r.choice(["allow", "block"])) for _ in range(150)] + [(None, "/", "block"), ("", "", "block"), ("org", None, "block"), ("org", "", "allow")]
    rows = [(r.choice([i, None]), "x" * r.randrange(3) + "://" + host() + path() + r.choice(["", "?q=://a.org/a", "#/", "/"])) for i in range(1500)]
    rows += [(7, None), (7, None), (8, "no scheme.org/a"), (9, "://"), (10, ""), (11, "http://org"), (12, "http://.org/"), (13, "http://a.org./a"), (14, "a://b://c.org/a"), (15, "http://" + "a." * 3000 + "org/" + "x" * 100_000), (16, "http://org/a\nb")]
    rows += [(99, "http://hot.a.org/a/b")] * 400 + [(i, "http://hot.a.org/a/b") for i in range(100, 500)]
    got = judge(pages(spark, rows), spark.createDataFrame([(*x, "odd") for x in rules], RULE))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter((i, *plain(u, rules)) for i, u in rows)


def test_no_rules_no_pages(spark):
    from lookalike.llm.url_filters import RULES, judge, rule_table

    some = pages(spark, [(1, "http://a.org/x"), (None, None)])
    assert sorted(map(tuple, judge(some, spark.createDataFrame([], RULE)).collect()), key=str) == [(1, "a.org", "/x", None, "allow"), (None, "", "", None, "allow")]
    assert judge(some.limit(0), rule_table(spark, RULES)).count() == 0
    kept = judge(some, rule_table(spark, RULES), keep=["page_id", "url", "part"], default="block").collect()
    assert Counter(map(tuple, kept)) == Counter([(1, "http://a.org/x", "odd", "a.org", "/x", "org/", "allow"), (None, None, "odd", "", "", None, "block")])


def test_query_against_sql(spark, sf):
    import duckdb

    from lookalike.llm.url_filters import SQL, op11_url_filters

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    df = op11_url_filters(spark, sf)
    assert Counter(map(tuple, df.collect())) == Counter(con.execute(SQL).fetchall())
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
