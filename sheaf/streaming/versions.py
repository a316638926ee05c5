"""Documents that arrive again and again: of each the latest version is kept, whatever the order of arrival.

State holds, for each document, the time and hash of the newest version that was passed on. A version that
is the same or older is dropped, one that arrives later than the watermark, too; a newer one is passed on. State of a document ends when
the watermark has passed its newest version by ``keep``, so state is bounded by the documents of that
time. What was passed on is appended; ``current`` takes the latest of each document, so the table is
the same for files replayed in any order, and the same as ``latest`` of all rows at once.

Nulls: rows without a time never count as late and lose against any time; a null doc_id is one document; a null text is an empty one.
Of versions with one time, the one with the larger hash of its text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheaf.operators import parsing

STATE = "newest long, hash long"
EARLIEST = -(2**62)


def _numbered(rows: DataFrame) -> DataFrame:
    """doc_id, text, ts, and version: the time in microseconds."""
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "ts", F.coalesce(F.unix_micros("ts"), F.lit(EARLIEST)).alias("version"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))


def newer_versions(arriving: DataFrame, delay: str = "1 day", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """doc_id, text, ts, version, hash of the arriving rows (doc_id, text, ts) that are newer than all versions of their document so far."""
    rows = _numbered(arriving.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", delay)

    def pick(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = state.get if state.exists else (EARLIEST - 1, 0)
        best, late = None, state.getCurrentWatermarkMs() * 1000  # Spark itself drops by the watermark of the batch before
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.version, row.hash) > newest and not EARLIEST < row.version < late:
                    newest, best = (int(row.version), int(row.hash)), row
        if best is None:
            return
        state.update(newest)
        due = newest[0] // 1000 + keep_ms
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame([best], columns=batch.columns)

    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    return rows.groupBy("doc_id").applyInPandasWithState(pick, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """doc_id, text, ts, version, hash: the latest version of each document, of rows that are all there. Combined before the exchange by (version, hash) alone."""
    best = rows.groupBy("doc_id").agg(F.max(F.struct("version", "hash")).alias("b")).select(F.col("doc_id").alias("d"), F.col("b.version").alias("v"), F.col("b.hash").alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")) & (F.col("hash") == F.col("h"))
    return rows.join(best, same, "left_semi").dropDuplicates(["doc_id", "version", "hash"])


def latest_of(rows: DataFrame) -> DataFrame:
    return latest(_numbered(rows.withColumn("ts", F.col("ts").cast("timestamp"))))


def keep_versions(arriving: DataFrame, out: str, checkpoint: str, delay: str = "1 day", keep_ms: int = 30 * 86_400_000) -> StreamingQuery:
    """Starts a query that appends the newer versions to the folder ``out``, one folder for each batch, which a repeated batch writes anew."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return newer_versions(arriving, delay, keep_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, out: str) -> DataFrame:
    """The latest version of each document of ``keep_versions``."""
    return latest(spark.read.option("recursiveFileLookup", True).parquet(out))


def current_items(spark, out: str) -> DataFrame:
    """Items and bullets of the latest versions."""
    return parsing.items_with_bullets(parsing.parse(current(spark, out).select("doc_id", "text")))
