"""Text statistics against their SQL on odd texts."""

import duckdb
import pytest

from lookalike.plans import registry

#: Shares that are halves of the last digit: 41/640 by decimal digits is one, as a double below it.
HALVES = [" ".join(f"w{i % n}" for i in range(640)) for n in (41, 323, 333, 7, 639)]
ODD = [None, "", " ", "\n", " \t\n ", ".", "a.\u2028", "a.\u0085", "a.\n", "a.\r\n", "One. Two!? Three...", "a\u00a0b A\u00a0B", "\u0130x ix i\u0307x", "\u039f\u03a3 \u03bf\u03c2 \u03bf\u03c3", "\u1e9e \u00df ss", "e\u0301 \u00e9 \U0001f600", "x\x0by\x0cz\x1cw"]


@pytest.mark.parametrize("texts", [HALVES, ODD], ids=["halves", "odd"])
def test_text_stats_equal_sql(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["i06_text_stats"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(registry.oracle_sql()["i06_text_stats"])
    assert df.columns == [d[0] for d in cur.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, cur.fetchall()))
