"""Which texts lie inside which documents, both normalised for matching, at any length and without comparing all with all.

Long texts (seven words or more) are found by key: their second to sixth word are whole words of any document that holds
them, so an equi-join by five words gives the candidates, which are checked. The join grows with the
documents and the texts, not with their product.

Shorter texts have no such key: a document may hold them inside a word. They are the patterns of Aho-Corasick automata, which find all of them in
one pass over a document. The distinct patterns are cut into blocks of about ``block_chars`` characters by a hash, so an automaton's size
is bounded whatever the number of patterns; one block is sent to the executors at a time and all documents
stream past it. Nothing of the documents is exchanged.

A text without any ASCII letter or digit normalises to the empty text, which is in every document: these pairs are asked for by
``empty=True`` and are as many as documents times such texts. Nulls on either side match nothing. Texts that
normalise alike are searched once and share their hits. Repeated rows repeat in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import normalize_for_match
from sheaf.sources.staging import stage_folder, stage_table

LONG, KEY = 7, 5


def _words(norm: str) -> Column:
    return F.split(norm, " ")


def long_hits(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """row, norm: patterns of LONG words or more in documents (row, text), by the five words after the first."""
    key = lambda c, i: F.array_join(F.slice(c, i, KEY), " ")
    keyed = patterns.withColumn("k", key(_words("norm"), F.lit(2)))
    w = docs.where(F.size(_words("text")) >= LONG).select("row", _words("text").alias("w"))
    places = w.select("row", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - KEY + 1), lambda i: key(F.col("w"), i)))).alias("k"))
    near = places.join(keyed, "k").select("row", "norm").distinct()
    return near.join(docs, "row").where(F.contains("text", "norm")).select("row", "norm")


def short_hits(docs: DataFrame, patterns: DataFrame, block_chars: int) -> DataFrame:
    """row, norm: the other patterns, by one automaton for each block of them."""
    spark = docs.sparkSession
    total = patterns.agg(F.coalesce(F.sum(F.length("norm")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    placed = stage_table(patterns.withColumn("block", F.pmod(F.xxhash64("norm"), F.lit(blocks))), "patterns")
    folder = stage_folder(spark, "short-hits")
    for b in range(blocks):
        # About block_chars characters, by the number of blocks.
        block = spark.sparkContext.broadcast([r["norm"] for r in placed.where(F.col("block") == b).select("norm").toLocalIterator()])

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for norm in block.value:
                automaton.add_word(norm, norm)
            automaton.make_automaton()
            for batch in batches:
                rows, norms = [], []
                for row, text in zip(batch["row"], batch["text"], strict=True):
                    own = {norm for _, norm in automaton.iter(text)} if len(automaton) else ()
                    rows += [row] * len(own)
                    norms += own
                yield pd.DataFrame({"row": pd.Series(rows, dtype="int64"), "norm": pd.Series(norms, dtype="object")})

        docs.mapInPandas(run, "row long, norm string").write.parquet(f"{folder}/block={b}")
        block.unpersist()
    return spark.read.schema("row long, norm string").parquet(*[f"{folder}/block={b}" for b in range(blocks)])


def _found(docs: DataFrame, needles: DataFrame, doc_key: str, needle_key: str, text: str, block_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """hits (row, norm), documents (row, d, text) and needles (n, norm): each different text once for each document that holds it."""
    # Rows are told apart by a number of their own: keys may repeat or be null.
    d = stage_table(docs.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(doc_key).alias("d"), normalize_for_match(F.col(text)).alias("text")), "documents")
    n = stage_table(needles.where(F.col(text).isNotNull()).select(F.col(needle_key).alias("n"), normalize_for_match(F.col(text)).alias("norm")), "needles")
    patterns = n.where("norm <> ''").select("norm").distinct()
    own = d.select("row", "text")
    is_long = F.size(_words("norm")) >= LONG
    return long_hits(own, patterns.where(is_long)).unionByName(short_hits(own, patterns.where(~is_long), block_chars)), d, n


def contained(docs: DataFrame, needles: DataFrame, doc_key: str, needle_key: str, text: str = "text", block_chars: int = 4_000_000, empty: bool = False) -> DataFrame:
    """doc_key, needle_key: documents (doc_key, text) that hold a needle (needle_key, text)."""
    hits, d, n = _found(docs, needles, doc_key, needle_key, text, block_chars)
    found = hits.join(n, "norm").join(d.select("row", "d"), "row").select(F.col("d").alias(doc_key), F.col("n").alias(needle_key))
    if empty:
        blank = n.where("norm = ''").select(F.lit(0).alias("z"), F.col("n").alias(needle_key))
        found = found.unionByName(d.select(F.lit(0).alias("z"), F.col("d").alias(doc_key)).join(blank, "z").select(doc_key, needle_key))
    return found


def contained_sums(docs: DataFrame, needles: DataFrame, doc_key: str, needle_key: str, text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """doc_key, n, total: how many needles (needle_key a number) a document holds and the sum of their keys, of documents that hold any.

    The same as grouping ``contained``, but needles that normalise alike are summed before they meet the documents: the work grows
    with the different texts that each document holds, not with the rows that share them."""
    hits, d, n = _found(docs, needles, doc_key, needle_key, text, block_chars)
    alike = stage_table(n.where("norm <> ''").groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total")), "alike")
    both = [F.sum("n").alias("n"), F.sum("total").alias("total")]
    rows = hits.join(alike, "norm").groupBy("row").agg(*both)
    return d.select("row", "d").join(rows, "row").groupBy(F.col("d").alias(doc_key)).agg(*both)
