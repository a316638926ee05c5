"""SQL functions give what the columns give that they are printed from."""

from pyspark.sql import functions as F
from sheaf.functions import sql as S
from sheaf.plans.parsing_queries import DATES, HEADINGS
from sheaf.plans.record_queries import ANSWERS, MESSAGES

TEXTS = [*(x for _, x in [*DATES, *HEADINGS, *ANSWERS, *MESSAGES]), None, "", " \t", "it's \\ \"q\" 'x'", "- b", "Lead, Acme, Oslo", "Jan 2018", "present"]


def test_every_function(spark):
    assert len(S.register(spark)) == len(S.FUNCTIONS)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, t string")
    df.createOrReplaceTempView("sheaf_test_texts")
    for name, (function, parameters, _) in S.FUNCTIONS.items():
        kinds = [p.split(" ", 1)[1] for p in parameters.split(", ")]
        given = {"STRING": "t", "ARRAY<STRING>": "array(t, 'x')", "DATE": "date '2020-05-01'"}
        want = df.select("i", function(*[F.expr(given[k]) for k in kinds]).alias("v")).orderBy("i").collect()
        got = spark.sql(f"select i, sheaf_{name}({', '.join(given[k] for k in kinds)}) as v from sheaf_test_texts order by i").collect()
        assert got == want, name
