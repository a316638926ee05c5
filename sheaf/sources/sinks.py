"""Sinks: files with exact names, saved profiles, run output."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.sources import profile_store
from sheaf.sources.files import exists, resolve


def pretty(text: str) -> str:
    """JSON with two spaces of indent and a final newline, non-ASCII as it is."""
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n"


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes rows (run_dir, file_name, content) below ``root`` and returns the paths written.

    Each file is written under a name of its attempt and renamed, so retries leave whole files.
    JSON files are indented. ``root`` is any folder that pyarrow can open: local, hdfs, s3, gs.
    """
    base = resolve(root)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
        for batch in batches:
            done = []
            for d, name, content in zip(batch["run_dir"], batch["file_name"], batch["content"], strict=True):
                path = f"{folder}/{d}/{name}"
                system.create_dir(os.path.dirname(path), recursive=True)
                attempt = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
                with system.open_output_stream(attempt) as out:
                    out.write((pretty(content) if name.endswith(".json") else content).encode("utf-8"))
                if system.get_file_info(path).type != fs.FileType.NotFound:  # some file systems refuse to move onto a file
                    system.delete_file(path)
                system.move(attempt, path)
                done.append(path)
            yield pd.DataFrame({"path": done})

    return files.select("run_dir", "file_name", "content").mapInPandas(run, "path string")


def save_profiles(profiles: DataFrame, path: str) -> None:
    """Overwrites the saved profiles (doc_id, data). What counts is the committed version (``profile_store``); one pretty JSON
    file for each row is written beside it for people, and brought up to date after the commit."""
    root = resolve(path).rstrip("/")
    profile_store.replace(profiles, root)
    _export(profiles.sparkSession, root)


def upsert_profiles(profiles: DataFrame, path: str) -> int:
    """Adds and replaces saved profiles by doc_id, as far as contents differ; returns the version."""
    root = resolve(path).rstrip("/")
    version = profile_store.upsert(profiles, root)
    _export(profiles.sparkSession, root)
    return version


def _export(spark: SparkSession, root: str) -> None:
    saved = profile_store.read_store(spark, root)
    name = F.concat(F.lit("profile-"), F.col("doc_id").cast("string"), F.lit(".json"))
    write_files(saved.where("doc_id is not null").select(F.lit("").alias("run_dir"), name.alias("file_name"), F.col("data").alias("content")), root).count()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = p(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [x.getPath().getName() for x in system.listStatus(p(root))]
    files = spark.createDataFrame([(n,) for n in there if n.startswith("profile-") and n.endswith(".json")], "file string")
    for row in files.join(saved.select(name.alias("file")), "file", "left_anti").toLocalIterator():
        system.delete(p(f"{root}/{row['file']}"), False)


def delete_if_exists(spark: SparkSession, path: str) -> bool:
    if not exists(spark, path):
        return False
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(resolve(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
