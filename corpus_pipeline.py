"""The corpus pipeline: documents that pass the quality classifier, without repeated lines and
near copies, mixed to target weights and encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all
but the last return the columns of documents. ``run`` writes each stage's rows as Parquet in
the shared folder and reads them again for the next.

Nulls: rows without a doc_id or a text are documents like others (see the operators): a null text passes as empty through
classifier and line dedup, and has no tokens, so that the mixing stage does not keep it. Repeated rows are one after the join.
Texts of any length are taken whole. Empty tables give an empty result. Columns besides those of documents pass through,
whatever their names; only the last stage replaces columns named ids, n_tokens, parity and round_trip.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import SPACE_CHARS, materialize, table
from sheaf.llm.line_dedup import dedup_lines
from sheaf.llm.parity_join import near_duplicates
from sheaf.llm.quality_classifier import classify
from sheaf.llm.queries import tokenizer_file
from sheaf.llm.sentencepiece_codec import encode_documents
from sheaf.llm.source_mixing import mix


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage):
    """Columns besides those of documents go by number through a stage, so that they come out as they went in, whatever their names."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in COLUMNS else f"extra_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()]), sf_dir)
        return out.select(*[F.col(x).alias(c) for c, x in names.items()])

    return run_stage


@_apart
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return scored.where("kept").select(*docs.columns)


@_apart
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, and documents of which nothing else was left; n_chars follows the text."""
    left = dedup_lines(docs)
    full = (F.col("n_lines_removed") == 0) | (F.length(F.translate("text", SPACE_CHARS, "")) > 0)
    changed = F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.where(full).withColumn("n_chars", changed).select(*docs.columns)


@_apart
def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays: that with the smallest doc_id, and of rows that share it the one
    whose text has the smallest hash. Rows that repeat doc_id and text count once, those without words, too."""
    found = near_duplicates(docs, detail=True)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    firsts = found.where("component is not null").groupBy("component").agg(F.min(order).alias("f")).select("f.doc_id", "f.text_hash")
    keep = firsts.unionByName(found.where("component is null").select("doc_id", "text_hash").distinct())
    # The same keys for the join and for what repeats: one exchange of texts.
    key = lambda d, h: [F.coalesce(d, F.lit(0)), d.isNull(), h]
    own = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(f"k{i}") for i, c in enumerate(key(F.col("doc_id").cast("long"), F.xxhash64("text")))])
    wanted = keep.select(*[c.alias(f"k{i}") for i, c in enumerate(key(F.col("doc_id"), F.col("text_hash")))])
    return own.join(wanted, ["k0", "k1", "k2"], "left_semi").dropDuplicates(["k0", "k1", "k2"]).select("row.*")


@_apart
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target weights."""
    return mix(docs).where("kept").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids, their number, and whether they decode to the text."""
    return encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicate_join),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The first, third and last stages are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
