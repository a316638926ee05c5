"""Time lines of employment: dates of items as months, stretches that intervals make together, gaps, and joins of intervals.

Months count from year 0. An interval has its first month and the month after its last. A year alone is January
where an interval begins and December where it ends; ``present``, ``current`` and ``now`` end with the month of ``as_of``. Items
without a readable beginning or end, or that end before they begin, have null months and are only counted.

``stretches`` first takes the latest end of each beginning of a key, by an aggregation that combines before its exchange. So a
key has at most as many rows as there are months, whatever the skew, and the running maximum over them is a
bounded window. ``overlaps`` joins intervals by equal keys and bins: each interval goes to the bins of its own length (the power of two above
it), two at most, and looks up those of each larger length that the other side has, so neither long intervals nor short ones multiply. A
pair is kept in the one bin that holds the later of both beginnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import WS, trim_js
from sheaf.sources.staging import stage_table

#: The first letters of the months, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
OPEN = ("present", "current", "now")


def month_of(text: Column, ends: bool, as_of: Column) -> Column:
    """Months from year 0 of a text such as ``Jan 2018``, ``2018`` or ``present``; null where it is no date."""
    t = F.lower(trim_js(text))
    year = F.regexp_extract(t, r"([0-9]{4})\z", 1)
    name = F.substring(F.regexp_extract(t, rf"([a-z]+){WS}+[0-9]{{4}}\z", 1), 1, 3)
    place = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    month = F.when(place > 0, place - 1).otherwise(11 if ends else 0)
    # The word before the year may be any ("since 2018"), the last word alone tells an open end.
    is_open = F.regexp_extract(t, r"([a-z]+)\z", 1).isin(*OPEN)
    now = F.year(as_of) * 12 + F.month(as_of) - 1
    return F.when(year != "", F.nullif(year, F.lit("")).cast("int") * 12 + month).when(F.lit(ends) & is_open, now)


def spans(items: DataFrame, as_of: Column, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Adds first_month and past_month, the month after the last; both null where the dates make no interval."""
    first, past = month_of(F.col(start), False, as_of), month_of(F.col(end), True, as_of) + 1
    dated = items.withColumn("first_month", first).withColumn("past_month", past)
    fits = F.coalesce(F.col("first_month") < F.col("past_month"), F.lit(False))
    return dated.withColumn("fits", fits).withColumn("first_month", F.when(F.col("fits"), F.col("first_month"))).withColumn("past_month", F.when(F.col("fits"), F.col("past_month"))).drop("fits")


def stretches(intervals: DataFrame, keys: list[str], first: str = "first_month", past: str = "past_month") -> DataFrame:
    """keys, stretch (from 1), first, past: the union of each key's intervals; those that touch make one."""
    ends = intervals.where(F.col(first).isNotNull() & F.col(past).isNotNull()).groupBy(*keys, first).agg(F.max(past).alias(past))
    order = Window.partitionBy(*keys).orderBy(first)
    before = F.max(past).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ends.withColumn("opens", F.when(before.isNull() | (F.col(first) > before), 1).otherwise(0))
    placed = opened.withColumn("stretch", F.sum("opens").over(order).cast("int"))
    return placed.groupBy(*keys, "stretch").agg(F.min(first).alias(first), F.max(past).alias(past))


def time_lines(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_items, n_dated, months (of the union), months_doubled (covered more than once, with each further time), n_stretches, months_of_gaps, longest_gap."""
    intervals = stage_table(intervals.select(*keys, "first_month", "past_month"), "intervals")
    counted = intervals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), F.count("first_month").alias("n_dated"), F.coalesce(F.sum(F.col("past_month") - F.col("first_month")), F.lit(0)).cast("long").alias("summed"))
    own = stretches(intervals, keys)
    gap = F.col("first_month") - F.lag("past_month").over(Window.partitionBy(*keys).orderBy("stretch"))
    joined = own.withColumn("gap", gap).groupBy(*keys).agg(F.sum(F.col("past_month") - F.col("first_month")).cast("long").alias("months"), F.count(F.lit(1)).alias("n_stretches"), F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("months_of_gaps"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("longest_gap"))
    c, j = counted.alias("c"), joined.alias("j")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"j.{k}"))
    none = F.lit(0).cast("long")
    return c.join(j, same, "left").select(*[F.col(f"c.{k}").alias(k) for k in keys], "n_items", "n_dated", F.coalesce("months", none).alias("months"), (F.col("summed") - F.coalesce("months", none)).alias("months_doubled"), *[F.coalesce(x, none).alias(x) for x in ("n_stretches", "months_of_gaps", "longest_gap")])


def _level(first: str, past: str) -> Column:
    """The smallest power of two that is no shorter than the interval."""
    return F.ceil(F.log2((F.col(past) - F.col(first)).cast("double"))).cast("int")


def _bins(rows: DataFrame, levels: Column, first: str, past: str) -> DataFrame:
    """A row for each of the levels and each bin of it that the interval touches."""
    out = rows.withColumn("level", F.explode(levels)).withColumn("width", F.expr("shiftleft(1L, level)"))
    return out.withColumn("bin", F.explode(F.sequence(F.floor(F.col(first) / F.col("width")), F.floor((F.col(past) - 1) / F.col("width")))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], first: str = "first_month", past: str = "past_month") -> DataFrame:
    """Pairs of rows with equal ``keys`` whose intervals [first, past) have a month in common: keys, and the structs ``l`` and ``r`` of both rows. Rows without an interval, or with a null key, have no pair."""

    def prepared(rows: DataFrame, side: str) -> DataFrame:
        has = F.col(first) < F.col(past)
        for k in keys:
            has = has & F.col(k).isNotNull()
        return rows.where(has).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(first).cast("long").alias(f"{side}0"), F.col(past).cast("long").alias(f"{side}1"), F.struct(*rows.columns).alias(side))

    a, b = (stage_table(prepared(x, s), "intervals") for x, s in ((left, "l"), (right, "r")))
    on = [f"k{i}" for i in range(len(keys))] + ["level", "bin"]
    level = lambda s: _level(f"{s}0", f"{s}1")
    # At most one number for each power of two.
    there = {s: sorted(x.agg(F.collect_set(level(s))).first()[0]) for x, s in ((a, "l"), (b, "r"))}
    own = lambda x, s: _bins(x, F.array(level(s)), f"{s}0", f"{s}1")
    # What is no longer than the other side looks the other up at each of its lengths from its own on.
    from_level = lambda x, s, other, more: _bins(x, F.filter(F.array(*map(F.lit, there[other])).cast("array<int>"), lambda v: v >= level(s) + more), f"{s}0", f"{s}1")
    later = F.greatest("l0", "r0")
    meets = (F.col("l0") < F.col("r1")) & (F.col("r0") < F.col("l1")) & (F.floor(later / F.col("width")) == F.col("bin"))
    longer = own(a, "l").join(from_level(b, "r", "l", 0).drop("width"), on).where(meets)
    shorter = own(b, "r").join(from_level(a, "l", "r", 1).drop("width"), on).where(meets)
    out = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]
    return longer.select(*out, "l", "r").unionByName(shorter.select(*out, "l", "r"))
