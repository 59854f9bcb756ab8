"""The corpus pipeline against a brute-force version of its stages."""

from collections import Counter

from pyspark.sql import functions as F

from tests.llm.test_inverted_packing import check_bins, words
from tests.llm.test_near_copies import kept
from tests.llm.test_repeats import brute10


def test_pipeline(spark, sf):
    import corpus_pipeline
    from lookalike.llm.common import written
    from lookalike.llm.quality import quality_scores

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        after.append(written(stage(spark, after[-1], sf)))
    assert all(d.columns == docs.columns for d in after[:-1])
    rows = [{r.doc_id: r for r in d.collect()} for d in after[:-1]]
    # quality: what the classifier keeps; labelled good documents mostly stay
    scores = quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert set(rows[1]) == {r.doc_id for r in scores if r.score >= 0.5}
    # near copies: five-word sets of a Jaccard similarity of 0.8 or more
    assert sorted(rows[2], key=str) == kept([(i, r.text) for i, r in rows[1].items()])
    assert all(rows[2][i] == rows[1][i] for i in rows[2])
    # repeated spans
    spans = {r[0]: r for r in brute10([(i, r.text) for i, r in rows[2].items()])}
    assert set(rows[3]) == {i for i, r in spans.items() if r[1] > r[2] or r[2] == 0}
    for i, r in rows[3].items():
        assert abs(len(r.text.encode()) - (spans[i][1] - spans[i][2])) <= 6 * spans[i][3] and r.n_chars == len(r.text)
    # benchmark windows
    grams = set()
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(item.text)
        n = min(10, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    dirty = lambda t: any(tuple(w[k : k + n]) in grams for w in [words(t)] for n in {len(g) for g in grams} for k in range(len(w) - n + 1))
    assert set(rows[4]) == {i for i, r in rows[3].items() if not dirty(r.text)}
    # packing
    check_bins(after[-1].collect(), [(i, r.text, r.source) for i, r in rows[4].items()], 2048, 2)
    assert corpus_pipeline.run(spark, sf).count() == after[-1].count()


def test_stages_judge_rows(spark):
    """Null and repeated ids, null and empty texts, more columns with clashing names: rows are judged one by one."""
    from lookalike.llm.inverted import stage_decontaminate
    from lookalike.llm.packing import stage_packing
    from lookalike.llm.quality import stage_quality
    from lookalike.llm.simhash import stage_simhash
    from lookalike.llm.suffix_dedup import stage_suffix_dedup

    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first().text
    text, other = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    rows = [(None, "a clean one", "en", "s", 11, 1, "x"), (None, item, "en", "s", 5, 1, "x"), (1, text, "en", None, 3, 2, None), (1, text, "en", None, 3, 2, None), (1, item, "en", "s", 5, 2, "y"), (2, None, "en", "s", None, 3, None), (3, "", None, "s", 0, 4, None), (None, other, "en", "s", 1, 5, None), (None, other, "en", "s", 1, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _uid long, _key string")
    # benchmark: only the two rows that hold the item go
    clean = stage_decontaminate(spark, docs, sf)
    assert sorted(clean.collect(), key=str) == sorted((r for r in docs.collect() if r.text != item), key=str)
    # near copies: one row of each text
    apart = stage_simhash(spark, docs, sf)
    assert apart.columns == docs.columns and sorted(str(r.text or "") for r in apart.collect()) == sorted({str(r[1] or "") for r in rows})
    # repeated spans
    once = stage_suffix_dedup(spark, docs, sf).collect()
    assert sorted(str(r.text) for r in once if r.text) == sorted(["a clean one", text, other, item])
    # quality: a row's own score decides, not its id
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    stay = stage_quality(spark, given, sf)
    bad = given.join(stay, "doc_id", "left_anti").first()
    free = stay.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left_anti").first()  # no label: not learned from
    more = spark.createDataFrame([(free.doc_id, bad.text), (None, bad.text), (None, free.text)], given.schema)
    got = stage_quality(spark, given.unionByName(more), sf)
    assert Counter(map(tuple, got.collect())) == Counter([*map(tuple, stay.collect()), (None, free.text)])
    packed = stage_packing(spark, docs, sf)
    assert packed.where(F.col("doc_id").isNull()).count() == 4
    for stage in (stage_quality, stage_simhash, stage_suffix_dedup, stage_decontaminate, stage_packing):
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_tables_on_the_way_are_deleted(spark):
    from lookalike.llm import common

    made = []

    def make():
        made.append(common.written(spark.range(5).toDF("x")))
        return made[0].where("x > 1")

    assert common.settled(spark, make).count() == 3
    folder = made[0].inputFiles()[0].rsplit("/", 1)[0]
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
