"""Roll-ups of merged bases against plain sums, and sketches within their stated error."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from sheaf.operators import rollups as R


def test_roll_up_of_merged_parts(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "b", None]), r.randrange(3), r.randrange(9000) if r.random() < 0.9 else None, int(r.gauss(500, 100)) if r.random() < 0.95 else None) for _ in range(30_000)]
    columns = ["a", "b"]
    df = spark.createDataFrame(rows, "a string, b int, k long, m long")
    parts = [R.base(df.where(F.col("b") == i), columns, "k", "m") for i in range(3)] + [R.base(df.limit(0), columns, "k", "m")]
    out = R.roll_up(R.merge(parts, columns), columns, [["a", "b"], ["a"], ["b"], []])
    got = {(x.level, x.a, x.b): x for x in out.select("*", R.distinct_keys(F.col("keys")).alias("d"), R.quantile(F.col("measures"), 0.5).alias("q"), R.quantile(F.col("measures"), 0.9).alias("p")).collect()}
    want = defaultdict(list)
    for a, b, k, m in rows:
        for level, key in ((0, (a, b)), (1, (a, None)), (2, (None, b)), (3, (None, None))):
            want[(level, *key)].append((k, m))
    assert set(got) == set(want)
    for key, own in want.items():
        x, ms = got[key], sorted(m for _, m in own if m is not None)
        assert (x.n, x.total) == (len(own), sum(ms))
        n = len({k for k, _ in own if k is not None})
        assert abs(x.d - n) <= 0.06 * n
        for q, at in ((0.5, x.q), (0.9, x.p)):
            assert abs(sum(m <= at for m in ms) / len(ms) - q) < 0.03


def test_no_sketch_of_many_is_further_off_than_asked(spark):
    """1,500 groups of 8,000 keys, each from sketches of 16 parts: the worst is within the error asked for with room to spare, with 12 bits it comes near it."""
    rows = spark.range(0, 12_000_000, 1, 16).select((F.col("id") % 1_500).alias("g"), F.col("id").alias("key"), F.lit(1).alias("m"))

    def worst(bits):
        return R.base(rows, ["g"], "key", "m", bits).agg(F.max(F.abs(R.distinct_keys(F.col("keys")) - 8_000)) / 8_000).first()[0]

    assert worst(R.bits_for(0.05)) < 0.03 < worst(R.BITS)
