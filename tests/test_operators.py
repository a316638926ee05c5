"""Odd cases and properties beyond what the queries hold."""

import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sheaf.functions import text as T
from sheaf.operators import evidence as E
from sheaf.operators import json_text as J
from sheaf.operators import model_stage as M
from sheaf.operators import parsing as P
from sheaf.operators import validation as V
from sheaf.plans import workflow as W
from sheaf.plans import workflow_queries as Q
from sheaf.sources import files, sinks

CV = "# Nia Holt\nData engineer\n## Skills\n- SQL\n- Python\n## Experience\n### Engineer, Marble Lake\n2020-2024\n- Built loaders\n- Ran audits\n### Analyst, Copper Hill\n2017-2020\n- Wrote reports\n## Education\nBSc\n"


def test_semantic_record(spark):
    [r] = P.semantic(spark.createDataFrame([(1, CV)], "doc_id long, text string")).collect()
    assert r.header == ["# Nia Holt", "Data engineer"]
    assert [s.type for s in r.sections] == ["skills", "employment", "education"]
    jobs = r.sections[1]
    assert jobs.content == ["### Engineer, Marble Lake", "### Analyst, Copper Hill"]
    assert [(i.role, i.company, i.startDate, i.endDate, i.bullets) for i in jobs["items"]] == [("Engineer", "Marble Lake", "2020", "2024", ["Built loaders", "Ran audits"]), ("Analyst", "Copper Hill", "2017", "2020", ["Wrote reports"])]


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    assert P.lines(docs).count() == 0
    assert [(r.header, r.sections) for r in P.semantic(docs).collect()] == [([], [])] * 3
    assert P.semantic(docs.where("false")).count() == 0


words = st.text(st.sampled_from("aB1 -é日."), max_size=8)


@settings(max_examples=15, deadline=None)
@given(st.lists(words, max_size=6), st.lists(words, max_size=6))
def test_merge_bullets_is_idempotent_and_same_meaning_symmetric(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    once = df.select(E.merge_bullets(F.col("a"), F.col("b")).alias("m"))
    [(m, again)] = once.select("m", E.merge_bullets(F.col("m"), F.array().cast("array<string>"))).collect()
    assert m == again
    assert all(x in a + b for x in m)


def test_large_documents_are_merged_and_matched_in_little_time(spark):
    """A thousand bullets of forty texts, and three hundred items: each field and text is normalised once, not for each pair."""
    own = [f"Did  thing {i % 40:03d}!" if i % 2 else f"did thing {i % 40:03d}" for i in range(1000)] + [None, "日", "did thing 007 and more"]
    [(got,)] = spark.createDataFrame([(own,)], "own array<string>").select(E.merge_bullets(F.array().cast("array<string>"), F.col("own"))).collect()
    assert got == own[:40] + [None]
    given = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("pos"), (F.col("id") % 7).cast("string").alias("company"), F.when(F.col("id") % 11 > 0, (F.col("id") % 11).cast("string")).alias("role"), F.lit("").alias("startDate"), (F.col("id") % 3).cast("string").alias("endDate"))
    joined = {(r.item, r.match_pos, r.score) for r in E.best_matches(given.withColumnRenamed("pos", "item"), given.where("pos % 4 <> 0"), ["k"], "item", "pos").collect()}
    rows = given.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "company", "role", "startDate", "endDate"))).alias("items")).withColumn("experiences", F.filter("items", lambda i: i["pos"] % 4 != 0))
    rows = rows.withColumn("best", E.best_indexes(F.col("experiences"), F.col("items")))
    one = F.zip_with("items", "best", lambda i, b: F.struct(i["pos"].alias("item"), F.get("experiences", b["at"])["pos"].alias("match_pos"), b["score"].alias("score")))
    assert {tuple(r) for r in rows.select(F.inline(one)).collect()} == joined
    assert len(joined) == 300


def test_texts_of_the_corpora_are_placed_by_document_once(spark, monkeypatch):
    """Partitions grow with the line items, and nothing after the texts moves rows or compares documents in a join."""
    from sheaf.plans import corpora as C
    from sheaf.plans import record_queries as R

    from tests.conftest import SF

    monkeypatch.setattr(C, "TASK_ITEMS", 100)
    n = C.tasks(spark, SF)
    assert n > 50
    for name in ("evd5_best_match", "evd6_fuzzy_dedupe", "evd7_merge", "evd8_missing_evidence"):
        plan = R.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Window", 1)[0]
        assert "Join" not in plan and "REPARTITION_BY_COL" not in plan and plan.count("Exchange") == 0, name


@settings(max_examples=25, deadline=None)
@given(st.text(st.sampled_from('{}"\\ a'), max_size=20))
def test_balanced_object_matches_a_plain_loop(spark, text):
    def plain(s):
        start = s.find("{")
        depth, quoted, skip = 0, False, False
        for i in range(start, len(s)) if start >= 0 else ():
            c = s[i]
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return s[start : i + 1]
        return None

    [(got,)] = spark.createDataFrame([(text,)], "t string").select(J.balanced_object(F.col("t"))).collect()
    assert got == plain(text)


@pytest.mark.parametrize("value", [None, "", "Ann", "__a__", "日本"])
def test_sanitize_is_idempotent(spark, value):
    once = T.sanitize_path(F.lit(value).cast("string"))
    [(a, b)] = spark.range(1).select(once, T.sanitize_path(once)).collect()
    assert a == b and a


def test_validation_tells_missing_null_and_wrong_type():
    ok = {"summary": "s", "skills": [" a ", 1, None, {"k": "v", "n": 2, "z": True}, ["x"]], "extra": 1}
    assert V.PROFILE.check(ok, "") == {"summary": "s", "education": [], "skills": ["a", "v: 2"], "industries": [], "companies": [], "workExperience": [], "projects": [], "achievements": []}
    for bad in ({"summary": "s", "name": None}, {"summary": 1}, {}, {"summary": "s", "skills": None}, {"summary": "s", "yearsOfExperience": -1}, {"summary": "s", "yearsOfExperience": "3"}, {"summary": "s", "education": [{"graduationYear": 2020.5}]}, {"summary": "s", "projects": [{"name": "x"}]}, []):
        with pytest.raises(V.Invalid):
            V.PROFILE.check(bad, "")
    assert V.first_valid(["{'a':1}", '{"passed": true}'], V.REVIEW, "r") == ({"passed": True, "issues": [], "suggestedFixes": []}, None)
    assert "Last validation error" in V.first_valid(['{"passed": NaN}'], V.REVIEW, "r")[1]


def test_provider_selection(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    monkeypatch.setenv("DEFAULT_PROVIDER", "OLLAMA")
    assert M.create_provider().name == "ollama"
    with pytest.raises(ValueError, match="OPENAI_API_KEY"):
        M.create_provider("OpenAI")
    with pytest.raises(ValueError, match="Unsupported"):
        M.create_provider("other")


def test_failed_calls_are_rows_and_cached_answers_are_not_asked(spark):
    def answer(messages):
        if "bad" in messages[1]["content"]:
            raise RuntimeError("no line")
        return json.dumps({"passed": True})

    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, t string")
    rows = rows.withColumn("m", F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))))
    out, audit = M.generate(rows, "m", "output review", M.FunctionProvider(answer))
    assert {r.id: r.error for r in out.collect()} == {1: None, 2: "no line"}
    assert audit.count() == 2

    def never(messages):
        raise RuntimeError("asked")

    again, _ = M.generate(rows.where("id = 1"), "m", "output review", M.FunctionProvider(never), cache=audit.where("response is not null"))
    assert [r.error for r in again.collect()] == [None]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes(b"x\r\ny\xff")
    (tmp_path / "in" / "b.PDF").write_bytes(b"pdf")
    (tmp_path / "in" / "c.pdf").write_bytes(b" ")
    got = {r.path[-5:]: (r.text, r.error is None) for r in files.read_documents(spark, str(tmp_path / "in"), lambda b: b.decode().upper()).collect()}
    assert got == {"/a.md": ("x\r\ny\ufffd", True), "b.PDF": ("PDF", True), "c.pdf": (None, False)}
    out = spark.createDataFrame([("d", "debug/01-x.json", '{"a":"é","b":[1]}'), ("d", "r.md", "text\n")], "run_dir string, file_name string, content string")
    assert sinks.write_files(out, str(tmp_path / "out")).count() == 2
    assert (tmp_path / "out/d/debug/01-x.json").read_text() == '{\n  "a": "é",\n  "b": [\n    1\n  ]\n}\n'
    assert sinks.delete_if_exists(spark, str(tmp_path / "out")) and not sinks.delete_if_exists(spark, str(tmp_path / "out"))


def test_preferences_file_is_not_merged_with_defaults(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"linkedinTone": "warm"}')
    [r] = files.load_preferences(spark, str(tmp_path / "p.json")).collect()
    assert json.loads(r.data) == {"linkedinTone": "warm", "preferredRoles": [], "avoidPhrases": []}


def test_saved_profiles_and_missing_ones(spark, tmp_path):
    rows = pd.DataFrame({"doc_id": [1], "data": ['{"summary":"s"}']})
    sinks.save_profiles(spark.createDataFrame(rows), str(tmp_path / "ctx"))
    [r] = files.load_profiles(spark, str(tmp_path / "ctx")).collect()
    assert json.loads(r.data)["summary"] == "s" and r.error is None
    with pytest.raises(ValueError, match="No CV"):
        W.analyze(spark, None, spark.createDataFrame([(1, "x")], "job_id long, text string"), M.FunctionProvider(lambda m: "{}"))


def test_stream_of_files(spark, tmp_path):
    from sheaf.streaming.parse_stream import parse_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(CV)
    parse_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_documents_that_share_an_id_are_parsed_apart(spark):
    from sheaf.operators import parsing as P

    a, b = "A\nExperience\n### Dev, One\n2019-2020\n- did a", "B\nSkills\n- s\nExperience\n### Ops, Two\n2011-2012\n- did b"
    rows = [(1, a), (1, b), (1, a), (None, a), (None, b), (2, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = sorted((r.doc_id or 0, r.company, r.start_date, tuple(r.bullets)) for r in P.items_with_bullets(P.parse(docs)).collect())
    assert items == [(d, *rest) for d in (0, 1) for rest in (("One", "2019", ("did a",)), ("Two", "2011", ("did b",)))]
    found = sorted((r.doc_id or 0, r.header, len(r.sections)) for r in P.semantic(docs).collect())
    assert found == [(0, ["A"], 1), (0, ["B"], 2), (1, ["A"], 1), (1, ["B"], 2), (2, [], 0), (2, [], 0)]


def test_settings_file_and_unreadable_documents(spark, tmp_path, monkeypatch):
    import os

    from sheaf import __main__ as cli

    monkeypatch.setenv("SHEAF_A", "kept")
    monkeypatch.delenv("SHEAF_B", raising=False)
    (tmp_path / ".env").write_text("# note\nSHEAF_A=other\nexport SHEAF_B='x y'\nSHEAF_C=v # why\nbroken\n")
    cli.load_env(str(tmp_path / ".env"))
    assert (os.environ["SHEAF_A"], os.environ.pop("SHEAF_B"), os.environ.pop("SHEAF_C")) == ("kept", "x y", "v")
    (tmp_path / "cv.pdf").write_bytes(b"no pdf")
    monkeypatch.setattr("sheaf.sources.files.pdf_text", lambda content: 1 / 0)
    assert cli.main(["profile", "build", "--cv", str(tmp_path / "cv.pdf"), "--context", str(tmp_path / "c")]) == 1
    assert not (tmp_path / "c").exists()


def test_local_provider_over_http_and_profile_commands(spark, tmp_path, monkeypatch, caplog):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from sheaf import __main__ as cli
    from sheaf.operators.model_stage import create_provider

    asked, answers = [], [{"message": {"content": "  {} \n"}}, {"message": {"content": " "}}, {"error": "no such model"}]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps(answers[len(asked) - 1]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("OLLAMA_BASE_URL", f"http://127.0.0.1:{server.server_port}")
    provider = create_provider("Ollama")
    try:
        assert provider.generate_text([{"role": "user", "content": "hi"}]) == "{}"
        for wrong in ("empty response", "no such model"):
            with pytest.raises(RuntimeError, match=wrong):
                provider.generate_text([{"role": "user", "content": "hi"}], as_json=False)
    finally:
        server.shutdown()
    assert [p for p, _ in asked] == ["/api/chat"] * 3 and asked[0][1]["format"] == "json" and "format" not in asked[1][1]
    folder = str(tmp_path / "context")
    sinks.save_profiles(spark.createDataFrame([(1, '{"summary":"s"}')], "doc_id long, data string"), folder)
    sinks.save_profiles(spark.createDataFrame([(2, '{"summary":"t"}')], "doc_id long, data string"), folder)
    assert [p.name for p in (tmp_path / "context").glob("*.json")] == ["profile-2.json"]
    caplog.set_level("INFO", logger="sheaf")
    for command, said in (("show", '"summary": "t"'), ("reset", "Deleted"), ("reset", "No profile"), ("show", "No profile")):
        caplog.clear()
        assert cli.main(["profile", command, "--context", folder]) == 0 and said in caplog.text


def test_a_run_written_twice_has_each_call_once_and_numbered_debug_files(spark, tmp_path):
    run = Q._run(spark, Q.JOBS[1:])
    for _ in range(2):
        W.write_run(run, str(tmp_path)).count()
    audit = spark.read.parquet(str(tmp_path / "audit"))
    assert audit.count() == run.audit.count() > 0
    [folder] = (tmp_path / "output").glob("*_-1_3")
    names = sorted(p.name for p in (folder / "debug").iterdir())
    assert names == ["01-CV_profile.json", "02-job_requirements.json", "03-job_requirements_repair.json", "04-match_analysis.json", "05-application_assets.json", "06-output_review.json"]
    first, mended = (json.loads((folder / "debug" / n).read_text()) for n in names[1:3])
    assert first["response"] == "{broken" and "error" in first and "error" not in mended
    assert list(mended) == ["label", "messages", "response"]


def test_semantic_reads_lines_once_in_one_order(spark):
    """Items, sections and headers come from one look at the lines, whose windows share one sort."""
    from sheaf.operators import parsing

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = parsing.semantic(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
    parsed = parsing.parse(docs)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum(" Sort [" in x and "pos#" in x for x in parsed.splitlines()) == 1


def test_one_look_at_dates_is_that_of_the_single_functions(spark):
    from pyspark.sql import functions as F
    from sheaf.functions import text as T

    lines = ["2021-2025", "Jan 2020 – Present)", "x 2018 to 2020 abc", "May 2018 - CURRENT", "12345-67890", "no date", "", "1999-2000 and 2001-2002", "日本\t2018—now", "a 2018 to 2019xy"]
    d, r = T.dated(F.col("line")), T.date_range(F.col("line"))
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.when(d["near"], F.struct(d["start"].alias("start"), d["end"].alias("end"))).alias("a"), r.alias("b"), d["before"].alias("c"), T.trim_js(T.date_before(F.col("line"))).alias("d"))
    assert all(x.a == x.b and x.c == x.d for x in rows.collect())


def test_bullet_bodies_and_trims(spark):
    from pyspark.sql import functions as F
    from sheaf.functions import text as T

    want = {"- a ": "a", "-a": None, "- ": None, "-  ": "", "-　x": "x", "● a\nb": None, "-\n": None, "- \n": None, "-\n ": "", "-\nx": "x", "+ a": None, "": None}
    got = spark.createDataFrame([(x,) for x in want], "line string").select("line", T.bullet_body(F.col("line")).alias("b")).collect()
    assert {x.line: x.b for x in got} == want
