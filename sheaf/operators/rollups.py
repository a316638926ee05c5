"""Roll-ups of parsed records over sets of columns, exact counts and sums with sketches of distinct keys and of quantiles.

The rows are grouped once, by all columns: counts, sums, a HyperLogLog sketch of the keys and a KLL sketch of the measure for
each finest group. This base is what grouping sets are made of, so each level merges a few groups instead of
reading the rows again, and no row is copied for each level. Bases of parts, days or regions merge to the base of
the whole, which is how a table that grows is rolled up. A hot group is a few partial
sums and sketches of fixed size before its exchange.

Distinct keys are estimated with a standard error of about 1.04 / sqrt(2**bits), 1.6 % with 12 bits; ``bits_for`` gives the bits with which six of
these are within an error, as one group of hundreds is three off by chance. Quantiles are within about 1.3 % of ranks with k = 200.
Nulls: a null in a column is a group of its own, told from the level's total by ``level``; null keys and measures are in no sketch and no sum.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, K = 12, 200


def bits_for(error: float) -> int:
    """The bits of a sketch of keys whose estimates are all within ``error`` (a share of the number) but for chances below one in a hundred million."""
    return min(21, max(4, ceil(2 * log2(6 * 1.04 / error))))


def base(rows: DataFrame, columns: list[str], key: str, measure: str, bits: int = BITS) -> DataFrame:
    """columns, n, total, keys, measures: one row for each finest group."""
    m = F.col(measure).cast("long")
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.sum(m).alias("total"), F.hll_sketch_agg(F.col(key), bits).alias("keys"), F.kll_sketch_agg_bigint(m, K).alias("measures"))


def _merged() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_bigint("measures", K).alias("measures")]


def merge(bases: list[DataFrame], columns: list[str]) -> DataFrame:
    """The base of all rows of the parts."""
    out = bases[0]
    for b in bases[1:]:
        out = out.unionByName(b)
    return out.groupBy(*columns).agg(*_merged())


def roll_up(base: DataFrame, columns: list[str], levels: list[list[str]]) -> DataFrame:
    """level (bits of the columns that are totalled, the first the highest), columns, n, total, keys, measures for each of ``levels``, lists of columns."""
    sets = [[F.col(c) for c in level] for level in levels]
    return base.groupingSets(sets, *columns).agg(F.grouping_id().cast("long").alias("level"), *_merged()).select("level", *columns, "n", "total", "keys", "measures")


def by_prefixes(columns: list[str]) -> list[list[str]]:
    """The levels of a roll-up: all columns, all but the last, ... none."""
    return [columns[:k] for k in range(len(columns), -1, -1)]


def distinct_keys(keys: Column) -> Column:
    return F.hll_sketch_estimate(keys)


def quantile(measures: Column, rank: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(measures, F.lit(rank))
