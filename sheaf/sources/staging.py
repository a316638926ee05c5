"""Tables and folders between steps, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_folders: list[tuple[SparkSession, str]] = []


@atexit.register
def _drop_all() -> None:
    """Stage folders go when the program ends; where the session is gone by then, the cluster's cleaner has them."""
    for spark, path in _folders:
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Unset, it is a local one where driver and executors are one machine, and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sheaf-stage-")
    path = f"{base.rstrip('/')}/sheaf-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _folders.append((spark, path))
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table that must not be computed twice, and reads it again."""
    path = stage_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
