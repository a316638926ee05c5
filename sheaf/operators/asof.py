"""As-of join: to each row the latest row of another table with the same keys that is not later.

Both sides are merged by union: the points (keys, time) of the left and the last row of each point of the right, one
row for each point. The latest value is then a running ``last`` over a key's points. A key with more than
``slice_points`` points is cut by time, at quantiles of its own points: within a slice the running value is a window
of bounded size, and what a slice begins with is the last value of the slices before it, a window over one row for each slice. Only
keys and times are sorted; the left rows are joined with their point's answer, where Spark
splits a point that many rows share.

Nulls: a null key or time has no match, as in SQL. Where several right rows share keys and time, the one with the largest ``prefer``
columns counts, then the largest values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.sources.staging import stage_table


def _points(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], prefer: list[str]) -> DataFrame:
    """k0, k1, ..., t, v (struct of the right row or null), asked: one row for each point."""
    named = lambda t: [*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(t).alias("t")]
    none = lambda row: row.isNull()
    held = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(prefer)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    r = right.select(*named(right_time), held.alias("v"), F.lit(False).alias("asked"))
    a = left.select(*named(left_time), F.lit(None).cast(r.schema["v"].dataType).alias("v"), F.lit(True).alias("asked"))
    both = a.unionByName(r)
    for c in [f"k{i}" for i in range(len(keys))] + ["t"]:
        both = both.where(~none(F.col(c)))
    return both.groupBy(*[f"k{i}" for i in range(len(keys))], "t").agg(F.max("v").alias("v"), F.max("asked").alias("asked"))


def _latest(by: list[str]) -> Column:
    return F.last("v", ignorenulls=True).over(Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: dict[str, str], prefer: list[str] | None = None, slice_points: int = 1_000_000) -> DataFrame:
    """All rows of ``left`` with ``values`` (column of ``right`` to its new name), null where no right row is as early."""
    ks = [f"k{i}" for i in range(len(keys))]
    points = stage_table(_points(left, right, keys, left_time, right_time, list(values), prefer or []), "points")
    hot = points.groupBy(*ks).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > slice_points)
    few = points.join(hot, ks, "left_anti").withColumn("latest", _latest(ks))
    many = points.join(hot, ks)
    # Cuts at quantiles of the key's points, as many for each hot key as the hottest needs.
    parts = -(-(hot.agg(F.max("n")).first()[0] or 1) // slice_points)
    cuts = many.groupBy(*ks).agg(F.array_distinct(F.percentile_approx("t", F.array(*[F.lit(i / parts) for i in range(1, parts)], F.lit(1.0)), max(10_000, 20 * parts))).alias("cuts"))
    sliced = many.drop("n").join(cuts, ks).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("t")))).drop("cuts")
    before = Window.partitionBy(*ks).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = sliced.groupBy(*ks, "slice").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("t"))).alias("v")).withColumn("carried", F.last("v", ignorenulls=True).over(before)).drop("v")
    inside = sliced.withColumn("latest", _latest([*ks, "slice"])).join(ends, [*ks, "slice"])
    cut = inside.withColumn("latest", F.coalesce("latest", "carried"))
    answers = few.select(*ks, "t", "latest", "asked").unionByName(cut.select(*ks, "t", "latest", "asked")).where("asked")
    own = left.select(F.struct(*left.columns).alias("row"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("t"))
    joined = own.join(answers.drop("asked"), [*ks, "t"], "left")
    return joined.select("row.*", *[F.col(f"latest.v{i}").alias(new) for i, new in enumerate(values.values())])
