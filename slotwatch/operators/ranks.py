"""Exact order statistics without sorting a group in one task.

The rank rule of every percentile here is ``sorted[floor((n-1) * p)]``, which no
built-in percentile follows. Values are first counted per distinct value (combined
before the shuffle), then per logarithmic range of values. The ranges of a group are few (about a thousand
per power of two), so finding the range that holds a rank is cheap; only the distinct
values of that one range are then put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEPS_PER_DOUBLING = 1024


def _range_of(value: Column) -> Column:
    """A non-decreasing range number, the same for values within about 0.1 percent."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * STEPS_PER_DOUBLING)).cast("int")


def rank_floor(p: float):
    """Rank rule ``floor((n-1) * p)`` with p clamped to [0, 1]; NaN counts as 0."""
    p = 0.0 if p != p else min(max(p, 0.0), 1.0)
    return lambda n: F.floor((n - 1) * F.lit(p)).cast("bigint")


def rank_tenth(n: Column) -> Column:
    """Rank rule ``n div 10`` of the baseline."""
    return F.call_function("div", n, F.lit(10).cast("bigint"))


def count_values(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``[keys, value, _w]``: how often each value occurs in each group."""
    return samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))


def ranks_of_counts(
    counts: DataFrame, keys: Sequence[str], value: str, rules: dict
) -> DataFrame:
    """Per group: ``n``, ``max_value`` and one column per entry of ``rules``.

    ``counts`` comes from :func:`count_values`. A rule maps the group size to a 0-based
    rank.
    """
    keys = list(keys)
    counted = counts.withColumn("_range", _range_of(F.col(value)))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    ranges = (
        counted.groupBy(*keys, "_range")
        .agg(F.sum("_w").alias("_rw"), F.max(value).alias("_rmax"))
        .select(
            *keys,
            "_range",
            "_rw",
            F.coalesce(F.sum("_rw").over(upto), F.lit(0)).alias("_base"),
            F.sum("_rw").over(whole).alias("n"),
            F.max("_rmax").over(whole).alias("max_value"),
        )
    )
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), rule(F.col("n")).alias("rank")) for name, rule in rules.items()]
    )
    # Every group has a rank in some range, so a group's size and maximum survive here.
    hits = ranges.withColumn(
        "_wanted",
        F.filter(wanted, lambda w: (w["rank"] >= F.col("_base")) & (w["rank"] < F.col("_base") + F.col("_rw"))),
    ).where(F.size("_wanted") > 0)
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(
        hits.select(*keys, "_range", "_base", "n", "max_value", "_wanted"), [*keys, "_range"]
    ).withColumn("_from", F.col("_base") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))

    def at(name: str) -> Column:
        here = F.exists(
            "_wanted",
            lambda w: (w["name"] == name)
            & (w["rank"] >= F.col("_from"))
            & (w["rank"] < F.col("_from") + F.col("_w")),
        )
        return F.max(F.when(here, F.col(value))).alias(name)

    return placed.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("max_value").alias("max_value"), *[at(name) for name in rules]
    )


def exact_ranks(samples: DataFrame, keys: Sequence[str], value: str, rules: dict) -> DataFrame:
    """Exact rank statistics of ``value`` per group; see :func:`ranks_of_counts`."""
    return ranks_of_counts(count_values(samples, keys, value), keys, value, rules)


PCTS = {"p50": rank_floor(0.50), "p95": rank_floor(0.95), "p99": rank_floor(0.99)}


def register_percentile_floor(spark: SparkSession) -> None:
    """SQL function ``percentile_floor(values ARRAY<BIGINT>, p DOUBLE)`` for short arrays."""
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION percentile_floor(xs ARRAY<BIGINT>, p DOUBLE)
        RETURNS BIGINT
        RETURN get(array_sort(xs),
                   CAST(floor((size(xs) - 1) * CASE WHEN isnan(p) THEN 0D
                                                    ELSE greatest(least(p, 1D), 0D) END) AS INT))
        """
    )
