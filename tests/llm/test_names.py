"""Columns of any name pass through the operators and the pipeline as they are."""

import pytest
from pyspark.sql import functions as F
from sheaf.llm.line_dedup import dedup_lines
from sheaf.llm.quality_classifier import classify
from sheaf.llm.source_mixing import mix

NAMES = ["_x", "_doc", "_site", "_path", "_good", "_n", "_rs", "_rp", "_id", "_th", "_found", "_fid", "_cid", "_cut", "_left", "_source", "_topic", "_p", "_all", "_rank", "h", "s", "n", "c", "w", "x_0", "x_5", "extra_1", "tokens", "body", "a.b", "first", "row", "k0", "th", "cls"]
TEXT = "one line of words that stands here\nanother line of words that stands there\n"


def docs(spark, more=()):
    rows = [(i, TEXT + f"only in text {i} " * (i % 5 + 6), ("en", "de")[i % 2], f"s{i % 3}") for i in range(40)] + [(None, None, None, None), (3, TEXT, "en", "s1"), (3, TEXT, "en", "s1"), (41, "", "en", "s0")]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return base.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in (*NAMES, *more)})


def labels(spark):
    return spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")


def check(out, names):
    for r in out.collect():
        assert all(r[n] == f"{n}:{'none' if r.doc_id is None else r.doc_id}" for n in names)


@pytest.mark.parametrize("name", ["dedup", "classify", "mix"])
def test_operators(spark, name):
    d = docs(spark)
    out = {"dedup": dedup_lines, "mix": mix, "classify": lambda x: classify(x, labels(spark), F.col("source"), F.col("lang"))}[name](d)
    assert out.columns[: len(d.columns)] == d.columns and out.count() == d.count()
    check(out, NAMES)


def test_pipeline_stages_and_odd_rows(spark):

    import corpus_pipeline
    from tests.conftest import SF

    more = ["kept", "evidence", "posterior", "topic", "p_keep", "n_tokens", "n_lines_removed", "component"]
    d = docs(spark, more).unionByName(docs(spark, more).where("doc_id = 5").withColumn("text", F.repeat(F.lit("a very long line of words "), 15_000)).withColumn("doc_id", F.lit(99).cast("long")).withColumns({n: F.lit(f"{n}:99") for n in (*NAMES, *more)}))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        check(out, [*NAMES, *more])
        assert stage(spark, d.limit(0), SF).count() == 0
