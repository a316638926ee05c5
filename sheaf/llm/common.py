"""Shared helpers: stage tables in the cluster's shared folder, tables by name, and word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern of the contracts has it: [^\x20\x09-\x0D]+
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or where unset and all is one machine (tests) a new local one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sheaf-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sheaf-{sc.applicationId}"


_kept: list[tuple[SparkSession, str]] = []


def _drop_all() -> None:
    for spark, path in _kept:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is then left for the cluster's cleaner
            return


atexit.register(_drop_all)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _kept.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a stage table that no later step reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again: lineage ends there, a lost executor loses nothing."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_folder = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes stage tables that no later step reads."""
    for t in tables:
        if (path := getattr(t, "_stage_folder", None)) is not None:
            drop_folder(t.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, ``[^\\x20\\x09-\\x0D]+``; null text: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body`` of ``value``: in its lambda the value is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
