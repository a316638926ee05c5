"""Saved profiles as versions: a keyed table of which a reader sees the old or the new state, never anything between.

Rows (doc_id, data) lie in Parquet folders by a hash of the key. A manifest names, for each bucket, the folder that holds it; it is
written under another name and renamed to ``manifest-<version>.json``, which must not exist. That rename is the commit: the
manifest with the highest number is the current state, a failure before it leaves the state as it was, and a second writer
that began from the same version fails. An upsert compares hashes of contents and writes anew only the buckets
in which something changed; without a change there is no new version. Folders that none of the last
``keep`` manifests names are deleted after a commit.

Nulls: a null doc_id is a key like others; a null data is not saved. Of several rows with one key, that with the largest content hash is saved.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORE, BUCKETS = "_store", 64


def _system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[int]:
    p, system = _system(spark, root)
    if not system.exists(p(f"{root}/{STORE}")):
        return []
    names = [x.getPath().getName() for x in system.listStatus(p(f"{root}/{STORE}"))]
    return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in names if n.startswith("manifest-"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The current manifest, or that of a version: version, buckets (number to folder). None where nothing is saved."""
    found = _versions(spark, root)
    if not found:
        return None
    text = spark.read.text(f"{root}/{STORE}/manifest-{found[-1] if version is None else version}.json", wholetext=True).first()
    return json.loads(text[0])


def _commit(spark: SparkSession, root: str, new: dict) -> None:
    p, system = _system(spark, root)
    at, final = p(f"{root}/{STORE}/.{uuid.uuid4().hex}"), p(f"{root}/{STORE}/manifest-{new['version']}.json")
    out = system.create(at, False)
    out.write(json.dumps(new).encode())
    out.close()
    if system.exists(final) or not system.rename(at, final):
        system.delete(at, False)
        raise RuntimeError(f"version {new['version']} of {root} was saved by another writer")


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00"))), F.lit(BUCKETS)).cast("int")


def read_store(spark: SparkSession, root: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """doc_id, data, hash, bucket of a version; None where nothing is saved."""
    state = manifest(spark, root, version)
    if state is None:
        return None
    folders = [f"{root}/{STORE}/{f}/bucket={b}" for b, f in state["buckets"].items() if buckets is None or int(b) in buckets]
    schema = f"doc_id {state['key']}, data string, hash string"
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return rows.withColumn("bucket", _bucket(F.col("doc_id")))


def _own(profiles: DataFrame) -> DataFrame:
    rows = profiles.where("data is not null").select("doc_id", "data", F.sha2("data", 256).alias("hash"))
    best = rows.groupBy("doc_id").agg(F.max(F.struct("hash", "data")).alias("x"))
    return best.select("doc_id", "x.data", "x.hash", _bucket(F.col("doc_id")).alias("bucket"))


def _write(rows: DataFrame, root: str) -> tuple[str, list[int]]:
    """A new folder with the rows by bucket; its name, and the buckets that it has."""
    folder = f"data-{uuid.uuid4().hex[:12]}"
    path = f"{root}/{STORE}/{folder}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
    p, system = _system(rows.sparkSession, root)
    names = [x.getPath().getName() for x in system.listStatus(p(path))]
    return folder, [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]


def replace(profiles: DataFrame, root: str, keep: int = 2) -> int:
    """Saves the rows as the whole state; returns the version."""
    spark = profiles.sparkSession
    version = (_versions(spark, root) or [0])[-1] + 1
    folder, buckets = _write(_own(profiles), root)
    _commit(spark, root, {"version": version, "key": profiles.schema["doc_id"].dataType.simpleString(), "buckets": {str(b): folder for b in buckets}})
    _clean(spark, root, keep)
    return version


def upsert(profiles: DataFrame, root: str, keep: int = 2) -> int:
    """Adds rows of new keys and puts those with another content in place of what is saved; returns the version that then holds."""
    spark, state = profiles.sparkSession, manifest(profiles.sparkSession, root)
    if state is None:
        return replace(profiles, root, keep)
    new, old = _own(profiles).alias("n"), read_store(spark, root).alias("o")
    same = F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("n.hash") == F.col("o.hash"))
    changed = new.join(old, same, "left_anti")
    touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())
    if not touched:
        return state["version"]
    before = read_store(spark, root, buckets=touched).alias("o")
    kept = before.join(new, F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")), "left_anti")
    folder, buckets = _write(kept.unionByName(new.where(F.col("bucket").isin(touched))), root)
    _commit(spark, root, {**state, "version": state["version"] + 1, "buckets": state["buckets"] | {str(b): folder for b in buckets}})
    _clean(spark, root, keep)
    return state["version"] + 1


def _clean(spark: SparkSession, root: str, keep: int) -> None:
    """Deletes manifests before the last ``keep``, and folders that the others do not name and that are older than the current state."""
    p, system = _system(spark, root)
    versions = _versions(spark, root)
    named = {f for v in versions[-keep:] for f in manifest(spark, root, v)["buckets"].values()}
    gone = {f for v in versions[:-keep] for f in manifest(spark, root, v)["buckets"].values()} - named
    for v in versions[:-keep]:
        system.delete(p(f"{root}/{STORE}/manifest-{v}.json"), False)
    for f in gone:
        system.delete(p(f"{root}/{STORE}/{f}"), True)
