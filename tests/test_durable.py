"""What must survive a failure: answers that were paid for, and saved profiles."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from sheaf.operators import model_stage as M
from sheaf.sources import files, profile_store, sinks


def asked_rows(spark, n):
    rows = spark.range(n).select(F.col("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.withColumn("m", F.array(message("system", F.lit("s")), message("user", F.col("t"))))


def test_a_killed_task_pays_for_no_answered_call_again(spark, tmp_path):
    asked, fuse = str(tmp_path / "asked"), str(tmp_path / "fuse")

    def answer(messages):
        text = messages[1]["content"]
        if "repair" not in messages[0]["content"].lower() and os.path.exists(fuse) and len(open(asked).readlines()) >= 17:
            os.remove(fuse)
            os._exit(1)  # the worker dies in the middle of its calls
        with open(asked, "a") as f:
            f.write(f"{text[:40]!r}\n")
        if text.endswith(("3", "7")) and text.startswith("text"):
            return "not valid"
        return json.dumps({"passed": True})

    open(fuse, "w").close(), open(asked, "w").close()
    rows, pace = asked_rows(spark, 30), M.Pace(calls=3, log=f"file://{tmp_path}/log")
    with pytest.raises(Exception, match="Job aborted|exited|crash|Stage"):
        M.generate(rows, "m", "output review", M.FunctionProvider(answer), pace=pace)[0].collect()
    before = len(open(asked).readlines())
    assert 17 <= before < 30 and not os.path.exists(fuse)
    out, audit = M.generate(rows, "m", "output review", M.FunctionProvider(answer), pace=pace)
    assert [r.error for r in out.collect()] == [None] * 30
    calls = open(asked).readlines()
    first = [c for c in calls if c.startswith("'text")]
    assert len(first) == len(set(first)) == 30 and len(calls) == 31  # one repair: the six bad answers are alike
    assert audit.where("label = 'output review repair'").count() == 6
    # A third run asks for nothing.
    again, _ = M.generate(rows, "m", "output review", M.FunctionProvider(answer), pace=pace)
    assert again.where("error is null").count() == 30 and len(open(asked).readlines()) == 31


def test_calls_keep_their_pace(spark):
    began = time.time()
    out, _ = M.generate(asked_rows(spark, 12), "m", "output review", M.FunctionProvider(lambda m: '{"passed": true}'), pace=M.Pace(calls=1, per_minute=300))
    assert out.where("error is null").count() == 12 and time.time() - began > 11 * 0.2


def profiles(spark, rows):
    return spark.createDataFrame([(d, None if s is None else json.dumps({"summary": s})) for d, s in rows], "doc_id long, data string")


def saved(spark, root):
    return {r.path.rsplit("/", 1)[-1]: json.loads(r.data)["summary"] for r in files.load_profiles(spark, root).collect()}


def test_profiles_as_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ctx")
    assert sinks.upsert_profiles(profiles(spark, [(i, f"s{i}") for i in range(200)] + [(5, "s5"), (300, None)]), root) == 1
    assert sinks.upsert_profiles(profiles(spark, [(i, f"s{i}") for i in range(100)]), root) == 1  # nothing is new
    old = profile_store.manifest(spark, root)["buckets"]
    assert sinks.upsert_profiles(profiles(spark, [(1, "other"), (2, "s2"), (999, "new")]), root) == 2
    want = {f"profile-{i}.json": f"s{i}" for i in range(200)} | {"profile-1.json": "other", "profile-999.json": "new"}
    assert saved(spark, root) == want and len(list((tmp_path / "ctx").glob("profile-*.json"))) == 201
    new = profile_store.manifest(spark, root)["buckets"]
    assert 1 <= sum(old.get(b) != new[b] for b in new) <= 2  # only buckets with a change are written
    assert profile_store.read_store(spark, root, version=1).count() == 200
    # A failure before the commit leaves what was there; one after it leaves the new set.
    with monkeypatch.context() as m:
        m.setattr(profile_store, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.save_profiles(profiles(spark, [(7, "lost")]), root)
    assert saved(spark, root) == want
    with monkeypatch.context() as m:
        m.setattr(sinks, "write_files", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.save_profiles(profiles(spark, [(7, "kept")]), root)
    assert saved(spark, root) == {"profile-7.json": "kept"}
    sinks.save_profiles(profiles(spark, [(8, "last")]), root)
    assert saved(spark, root) == {"profile-8.json": "last"} and [p.name for p in (tmp_path / "ctx").glob("*.json")] == ["profile-8.json"]
    assert len(list((tmp_path / "ctx" / "_store").glob("data-*"))) <= 3


def test_a_second_writer_fails_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ctx")
    profile_store.replace(profiles(spark, [(1, "a")]), root)
    state = profile_store.manifest(spark, root)
    profile_store.upsert(profiles(spark, [(2, "b")]), root)
    monkeypatch.setattr(profile_store, "manifest", lambda *a, **k: state)
    with pytest.raises(RuntimeError, match="another writer"):
        profile_store.upsert(profiles(spark, [(3, "c")]), root)
    monkeypatch.undo()
    assert {r.doc_id for r in profile_store.read_store(spark, root).collect()} == {1, 2}


def test_null_keys_are_saved_once(spark, tmp_path):
    root = str(tmp_path / "ctx")
    profile_store.upsert(profiles(spark, [(None, "a"), (None, "b"), (1, "c")]), root)
    profile_store.upsert(profiles(spark, [(None, "z")]), root)
    assert {(r.doc_id, json.loads(r.data)["summary"]) for r in profile_store.read_store(spark, root).collect()} == {(None, "z"), (1, "c")}
