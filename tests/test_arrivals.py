"""The data source with its commit and abort, and versions of documents that arrive in any order."""

import json
import os
import random
from collections import Counter

import pytest
from sheaf.sources import data_source as S
from sheaf.streaming import versions as V


def test_documents_by_size(spark, tmp_path):
    S.register(spark)
    sizes = {"a.txt": 10, "b.md": 400, "c/d.txt": 300, "c/e.TXT": 0, "f.pdf": 5, "_g.txt": 9, ".h": 9}
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\xffx\r\n" * (n // 4) + b"y" * (n % 4))
    df = spark.read.format("sheaf").option("partitionBytes", 500).load(str(tmp_path))
    got = {os.path.relpath(r.path, tmp_path): (r.text, r.error) for r in df.collect()}
    assert set(got) == {"a.txt", "b.md", "c/d.txt", "c/e.TXT", "f.pdf"} and got["a.txt"] == ("�x\r\n�x\r\nyy", None) and got["c/e.TXT"] == ("", None)
    assert got["f.pdf"][0] is None and "f.pdf" in got["f.pdf"][1]
    assert df.rdd.getNumPartitions() == 2
    assert spark.read.format("sheaf").load(str(tmp_path / "b.md")).count() == 1
    assert S.by_size([("a", 5), ("b", 5), ("c", 90), ("d", 1)], 10) == [("a", "b"), ("c",), ("d",)]


def test_run_files_are_committed_whole_or_not_at_all(spark, tmp_path):
    S.register(spark)
    root = str(tmp_path / "out")
    rows = [(f"r{i % 3}", f"debug/{i}.json" if i % 2 else f"{i}.txt", json.dumps({"i": i})) for i in range(20)]
    schema = "run_dir string, file_name string, content string"
    write = lambda x: spark.createDataFrame(x, schema).repartition(4).write.format("sheaf").mode("append").save(root)
    files = lambda: Counter(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)
    with pytest.raises(Exception, match="Expecting|JSON"):
        write([*rows, ("r1", "bad.json", "{broken")])
    assert not files() and not [x for x in os.listdir(root) if x.startswith(".run")]
    write(rows)
    want = Counter(f"{d}/{f}" for d, f, _ in rows)
    assert files() == want and (tmp_path / "out/r1/debug/1.json").read_text() == '{\n  "i": 1\n}\n'
    with pytest.raises(Exception, match="Expecting|JSON"):
        write([("r0", "0.txt", "changed"), ("r1", "bad.json", "{broken")])
    assert files() == want and (tmp_path / "out/r0/0.txt").read_text() == '{"i": 0}'
    write([("r0", "0.txt", "changed")])
    assert files() == want and (tmp_path / "out/r0/0.txt").read_text() == "changed"
    with pytest.raises(Exception, match="missing"):
        spark.createDataFrame([(1,)], "a int").write.format("sheaf").mode("append").save(root)


def arrivals(spark, tmp_path, name, parts):
    """A stream that gets one part after another."""
    folder = tmp_path / name
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "doc_id string, text string, ts timestamp").coalesce(1).write.parquet(str(folder / f"p{i}"))
        for f in (folder / f"p{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
            f.rename(folder / f"{i}.parquet")
    return spark.readStream.schema("doc_id string, text string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def stamp(minutes):
    import datetime

    return None if minutes is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


@pytest.mark.parametrize("seed", [0, 1])
def test_versions_in_any_order(spark, tmp_path, seed):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", "c", "d", None]), r.choice(["x", "y", "z", None]), stamp(r.choice([r.randrange(500), 499, None]))) for _ in range(60)]
    rows += rows[:10] + [("once", "Experience\nDev\tX Corp\tMay 2018 - May 2019\n- did", stamp(3))]
    random.Random(seed).shuffle(rows)
    stream = arrivals(spark, tmp_path, "in", [rows[i::4] for i in range(4)])
    V.keep_versions(stream, str(tmp_path / "out"), str(tmp_path / "cp"), delay="10 days").awaitTermination(300)
    pick = lambda df: {(x.doc_id, x.text, x.ts) for x in df.collect()}
    got = pick(V.current(spark, str(tmp_path / "out")))
    assert got == pick(V.latest_of(spark.createDataFrame(rows, "doc_id string, text string, ts timestamp"))) and len(got) == 6
    assert [x.bullets for x in V.current_items(spark, str(tmp_path / "out")).collect()] == [["did"]]
    passed = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    assert passed.count() <= len(set(rows))  # repeats do not pass


def test_late_versions_are_dropped(spark, tmp_path):
    parts = [[("a", "1", stamp(100))], [("b", "2", stamp(5000))], [("c", "late", stamp(10)), ("a", "also late", stamp(200))], [("d", "3", stamp(4990))]]
    V.keep_versions(arrivals(spark, tmp_path, "in", parts), str(tmp_path / "out"), str(tmp_path / "cp"), delay="60 minutes", keep_ms=1000).awaitTermination(300)
    assert {(x.doc_id, x.text) for x in V.current(spark, str(tmp_path / "out")).collect()} == {("a", "1"), ("b", "2"), ("d", "3")}
