"""The expressions over VARIANT against the Python check, on generated records of every schema."""

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from sheaf.operators import validation as V

LEAVES = ["a", " pad ", "", "  ", "　", 0, 1, -1, 2020, 2020.0, 2.5, 100, 100.5, 1e3, 1e12, -0.0, True, False, None, [], {}, ["x", " ", 3], [{"k": "v", "n": 2}], {"z": 1, "a": 2}, "é", "日本", "😀", "x\ny", '"q"', "\\"]


def record(r, ddl_kind, depth=0):
    """A value for a schema: mostly right, sometimes any leaf, sometimes missing."""
    if r.random() < 0.06:
        return r.choice(LEAVES)
    if isinstance(ddl_kind, dict):
        return {k: record(r, x, depth + 1) for k, x in ddl_kind.items() if r.random() > 0.1} | ({"extra": r.choice(LEAVES)} if r.random() < 0.1 else {})
    if isinstance(ddl_kind, list):
        return [record(r, ddl_kind[0], depth + 1) for _ in range(r.randrange(3))]
    return {"string": lambda: r.choice(["a", " pad ", "é", "text", "t"]), "double": lambda: r.choice([0, 2.5, 50, 99.9, 3]), "int": lambda: r.choice([2020, 1999, 7]), "boolean": lambda: r.random() < 0.5}[ddl_kind]()


def shape(kind):
    """The nested shape of a Spark type, as dicts, lists and names."""
    from pyspark.sql import types as S

    if isinstance(kind, S.StructType):
        return {f.name: shape(f.dataType) for f in kind.fields}
    if isinstance(kind, S.ArrayType):
        return [shape(kind.elementType)]
    return {"StringType": "string", "DoubleType": "double", "IntegerType": "int", "BooleanType": "boolean"}[type(kind).__name__]


def spoiled(r, text):
    return r.choice([text, text, text, text, text, text, text, f"  {text}\n", f"{text} tail", f"{text}, {text}", text[:-1], text.replace('"', "'"), text.replace("{", '{"summary":"first",', 1), text.replace(":", ": NaN,", 1), f"[{text}]", "", "null", text.replace("a", "\\ud800", 1), text.replace("a", "\\u0061", 1)])


@pytest.mark.parametrize("label", [x for x in V.SCHEMAS if x != "raw analysis"])
def test_expressions_agree_with_the_check(spark, label):
    """Over 100,000 records in all."""
    r = random.Random(label)
    kind = V.SCHEMAS[label]
    own = shape(spark.createDataFrame([], f"x {kind.ddl}").schema["x"].dataType)
    texts = [spoiled(r, json.dumps(record(r, own), ensure_ascii=r.random() < 0.5)) for _ in range(15_000)]
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "t": texts})).select("i", "t", V.right_data(F.array("t"), label).alias("d"), V.validate(F.array("t"), label).alias("v"))
    taken = right = 0
    for row in df.toPandas().itertuples():
        data, error = V.first_valid([row.t], kind, label)
        got = row.v["data"]
        assert (row.v["error"] is None) == (error is None), row.t
        if error is None:
            right += 1
            assert json.loads(got) == json.loads(V.printed(data)), row.t
            taken += row.d is not None
        else:
            assert row.d is None and row.v["error"] == error, (row.t, row.d)
    assert right > 1000 and taken > 0.6 * right  # most right records never reach Python


def test_first_candidate_counts(spark):
    rows = [(1, ['{"passed":true}', '{"passed":false}']), (2, ["no", '{"passed":false}']), (3, []), (4, None)]
    out = spark.createDataFrame(rows, "i int, c array<string>").select("i", V.validate(F.col("c"), "output review").alias("v")).collect()
    assert [(json.loads(x.v.data)["passed"] if x.v.data else None, x.v.error is None) for x in sorted(out)] == [(True, True), (False, True), (None, False), (None, False)]


def test_typed_records_are_the_same_by_both_ways(spark):
    texts = ['{"summary":" s ","yearsOfExperience":3,"skills":["a"," ",1],"education":[{"graduationYear":2020.0,"degree":" "}],"workExperience":[{"company":"X","responsibilities":["r"]}]}', '{"summary":" s ","yearsOfExperience":3,"skills":["a"," ",1,{"k":"v"}],"education":[{"graduationYear":2020.0,"degree":" "}],"workExperience":[{"company":"X","responsibilities":["r"]}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("d", V.right_data(F.array("t"), "CV profile")).withColumn("p", V.typed(V.validate(F.array("t"), "CV profile")["data"], "CV profile"))
    one, two = df.orderBy("i").collect()
    assert one.d is not None and two.d is None
    assert one.p.skills == ["a"] and two.p.skills == ["a", "v"]
    assert one.p.asDict(True) | {"skills": 0} == two.p.asDict(True) | {"skills": 0} and one.p.education[0].graduationYear == 2020 and one.p.education[0].degree is None


def test_usual_answers_are_faster_than_by_python(spark):
    rows = spark.range(0, 60_000, 1, 4).select(F.concat(F.lit('{"matchScore":'), (F.col("id") % 100).cast("string"), F.lit(',"summary":"s","suggestedPositioning":"p","gaps":["a","b","c"],"risks":["x"]}')).alias("t")).cache()
    rows.count()
    times = {}
    for name, column in (("expressions", V.right_data(F.array("t"), "match analysis")), ("all", V.validate(F.array("t"), "match analysis"))):
        for _ in range(2):
            began = time.time()
            rows.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            times[name] = time.time() - began
    print(times)
    rows.unpersist()


def test_what_follows_a_last_bracket_is_seen(spark):
    text = '{"matchScore":5,"summary":"s","suggestedPositioning":"p"}'
    rows = [(text, True), (text + "] x", False), (text + "],[1", False), (text + ",1", False), (f"[{text}] x", False)]
    out = spark.createDataFrame(rows, "t string, ok boolean").select("t", "ok", V.validate(F.array("t"), "match analysis")["error"].isNull().alias("got")).collect()
    assert [(r.t, r.ok) for r in out if r.ok != r.got] == []


def test_answers_are_checked_as_their_candidates_and_once(spark):
    """The check runs once where a filter reads its error, and finds what it finds among all candidates."""
    from sheaf.operators import json_text as J

    text = '{"matchScore":5,"summary":"s","suggestedPositioning":"p","gaps":["```{}```"]}'
    texts = [text, f"so {text} it is", f"```json\n{text}\n```", text + "] x", '{"matchScore":5} ' + text, text[:-1], "", " ", None, "{" + text + "}", '{"a":"```' + text.replace('"', "'") + '```"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    one, two = (df.select("i", c.alias("v")).orderBy("i").collect() for c in (V.validate_answer(F.col("t"), "match analysis"), V.validate(J.candidates(F.col("t")), "match analysis")))
    assert [(r.i, r.v.data and json.loads(r.v.data), r.v.error) for r in one] == [(r.i, r.v.data and json.loads(r.v.data), r.v.error) for r in two]
    kept = df.withColumn("v", V.validate_answer(F.col("t"), "match analysis")).where("v.error is null").select("i", "v.data")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
