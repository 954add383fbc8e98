"""Order-dependent operators that never sort one log in one task.

A window over ``partitionBy("log_id")`` puts a whole log into one task, however long it
is. Here the order column is cut into fixed ranges ("chunks"): the window runs per
(log, chunk), each chunk is summarised in one row, and the short list of summaries
carries the state from chunk to chunk. Slots are unique per log, so a chunk of slots
never holds more than ``SLOT_CHUNK`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_CHUNK = 65_536


def _chunked(df: DataFrame, order: str, size: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(size)).cast("bigint"))


def neighbour(
    df: DataFrame,
    value: Column,
    alias: str,
    forward: bool,
    keys: Sequence[str] = ("log_id",),
    order: str = "slot",
    size: int = SLOT_CHUNK,
) -> DataFrame:
    """Adds ``alias``: ``value`` of the nearest row before (or after) with one set.

    ``value`` may be a struct; rows where it is NULL are skipped over.
    """
    keys = list(keys)
    rows = _chunked(df, order, size).withColumn("_value", value)
    direction = "lead" if forward else "lag"
    parts = ", ".join(f"`{k}`" for k in [*keys, "_chunk"])
    near = F.expr(f"{direction}(_value) IGNORE NULLS OVER (PARTITION BY {parts} ORDER BY `{order}`)")
    has_value = F.when(F.col("_value").isNotNull(), F.struct(order, "_value"))
    edge = F.min(has_value) if forward else F.max(has_value)
    # Walk the chunks in reading direction, so that the frame only ever grows.
    towards = F.col("_chunk").desc() if forward else F.col("_chunk").asc()
    across = Window.partitionBy(*keys).orderBy(towards).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last("_edge", ignorenulls=True).over(across)
    edges = (
        rows.groupBy(*keys, "_chunk")
        .agg(edge.alias("_edge"))
        .select(*keys, "_chunk", carry.alias("_carry"))
    )
    return (
        rows.withColumn("_near", near)
        .join(edges, [*keys, "_chunk"])
        .select(*df.columns, F.coalesce("_near", "_carry._value").alias(alias))
    )


def running_max(
    df: DataFrame,
    value: str,
    alias: str,
    keys: Sequence[str] = ("log_id",),
    order: str = "slot",
    size: int = SLOT_CHUNK,
) -> DataFrame:
    """Adds ``alias``: the maximum of ``value`` over all rows up to and including peers."""
    keys = list(keys)
    rows = _chunked(df, order, size)
    # The default frame of an ordered window ends with the row's peers.
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.max(value).alias("_top"))
        .select(*keys, "_chunk", F.max("_top").over(before).alias("_carry"))
    )
    return (
        rows.withColumn("_near", F.max(value).over(inside))
        .join(edges, [*keys, "_chunk"])
        .select(*df.columns, F.greatest("_near", "_carry").alias(alias))
    )


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Sequence[Column]],
    leaf: Sequence[Column],
    alias: str,
) -> DataFrame:
    """Adds ``alias``: the 1-based position of each row within its ``keys`` group.

    The sort order is all ``levels`` in turn, then ``leaf``; it must not tie. Every level
    is counted first (combined before the shuffle), the counts give each level's
    offset, and only the rows of one innermost level are sorted in one task.
    """
    keys = list(keys)
    out = df
    names: list[list[str]] = []
    for i, level in enumerate(levels):
        cols = [f"_l{i}_{j}" for j in range(len(level))]
        out = out.select("*", *[c.alias(n) for c, n in zip(level, cols)])
        names.append(cols)
    outer: list[str] = []
    ranked = out
    offsets = []
    for i, cols in enumerate(names):
        before = (
            Window.partitionBy(*keys, *outer)
            .orderBy(*cols)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        counts = (
            out.groupBy(*keys, *outer, *cols)
            .agg(F.count(F.lit(1)).alias("_n"))
            .select(*keys, *outer, *cols, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_o{i}"))
        )
        outer = [*outer, *cols]
        ranked = ranked.join(counts, [*keys, *outer])
        offsets.append(F.col(f"_o{i}"))
    position = F.row_number().over(Window.partitionBy(*keys, *outer).orderBy(*leaf)).cast("bigint")
    for o in offsets:
        position = position + o
    return ranked.select(*df.columns, position.alias(alias))


def first_by(df: DataFrame, keys: Sequence[str], order: str, cap: int, bits: int = 20) -> DataFrame:
    """The ``cap`` rows of each group that come first by the unique BIGINT ``order``.

    Counts per range of ``order`` find the one range in which the cap falls; only that
    range is ranked. Groups below the cap are passed through.
    """
    keys = list(keys)
    rows = df.withColumn("_range", F.shiftright(order, bits))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    whole = counts.where(F.col("_before") + F.col("_n") <= cap).select(*keys, "_range")
    cut = counts.where((F.col("_before") < cap) & (F.col("_before") + F.col("_n") > cap)).select(
        *keys, "_range", "_before"
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    partial = (
        rows.join(cut, [*keys, "_range"])
        .withColumn("_pos", F.row_number().over(inside) + F.col("_before"))
        .where(F.col("_pos") <= cap)
    )
    return (
        rows.join(whole, [*keys, "_range"])
        .select(*df.columns)
        .unionByName(partial.select(*df.columns))
    )
