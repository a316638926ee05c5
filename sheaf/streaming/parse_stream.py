"""An addition: the parser over files as they arrive. All windows are by document, so each micro-batch stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import parsing


def parse_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000):
    """Starts a query that appends the items and bullets of new text files in ``folder`` to the table ``out``. A batch that is tried again writes the same batch folder."""
    arriving = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        parsing.items_with_bullets(parsing.parse(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
