"""Standstill periods and the leader timeouts outside of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwatch.operators.ordered import running_max
from slotwatch.operators.sizing import join_small


def standstill_firings(parsed: DataFrame) -> DataFrame:
    """Standstill events merged per anchor slot, first and last by arrival."""
    return (
        parsed.where(F.col("kind") == "Standstill")
        .groupBy("log_id", "slot")
        .agg(
            F.count(F.lit(1)).alias("firings"),
            F.min_by("ts_ns", "seq").alias("first_ns"),
            F.max_by("ts_ns", "seq").alias("last_ns"),
            F.min("seq").alias("seq"),
        )
    )


def standstill_ranges(parsed: DataFrame, slots: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    """Inclusive slot ranges: one per ended period, plus one left open at the log's end.

    ``sized_by`` is a stored table with a row per log, if there is one.
    """
    closed = parsed.where(F.col("kind") == "StandstillEnded").select(
        "log_id", F.col("slot").alias("entry_slot"), F.col("slot_end").alias("exit_slot"), "seq"
    )
    extending = parsed.where(F.col("kind") == "StandstillExtending").select("log_id", "seq", "slot")
    top = slots.groupBy("log_id").agg(F.max("slot").alias("_top"))
    return open_and_closed(closed, extending, top, sized_by)


def open_and_closed(
    closed: DataFrame, extending: DataFrame, top: DataFrame, sized_by: DataFrame | None = None
) -> DataFrame:
    """The ended periods and, per log, the one still open.

    The open period starts at the first extending event after the last ended one and is
    closed at the highest slot seen (its own ``seq`` is NULL).
    """
    last_end = closed.groupBy("log_id").agg(F.max("seq").alias("_ended"))
    entry = (
        join_small(extending, last_end, ["log_id"], "left", sized_by=sized_by)
        .where(F.col("seq") > F.coalesce("_ended", F.lit(-1)))
        .groupBy("log_id")
        .agg(F.min_by("slot", "seq").alias("entry_slot"))
    )
    still_open = entry.join(top, "log_id", "left").select(
        "log_id",
        "entry_slot",
        F.coalesce("_top", "entry_slot").alias("exit_slot"),
        F.lit(None).cast("bigint").alias("seq"),
    )
    return closed.unionByName(still_open)


def tcl_outside_standstill(slots: DataFrame, ranges: DataFrame, overall: DataFrame) -> DataFrame:
    """Leader timeouts outside every range, per log.

    A slot is inside some range exactly when the highest exit among ranges starting at
    or before it reaches it, so one ordered pass replaces a range join. Logs without
    any range report the plain event counter.
    """
    starts = (
        ranges.groupBy("log_id", F.col("entry_slot").alias("slot"))
        .agg(F.max("exit_slot").alias("_exit"))
        .withColumn("_is_slot", F.lit(False))
    )
    timeouts = slots.where(F.col("timeout_crashed_leader_ns").isNotNull()).select(
        "log_id", "slot", F.lit(None).cast("bigint").alias("_exit"), F.lit(True).alias("_is_slot")
    )
    placed = running_max(starts.unionByName(timeouts), "_exit", "_reach")
    outside = placed.groupBy("log_id").agg(
        F.count_if(F.col("_is_slot") & (F.coalesce("_reach", F.lit(-1)) < F.col("slot"))).alias("_outside")
    )
    n_ranges = ranges.groupBy("log_id").agg(F.count(F.lit(1)).alias("standstill_ranges"))
    return (
        overall.select("log_id", "timeout_crashed_leaders")
        .join(n_ranges, "log_id", "left")
        .join(outside, "log_id", "left")
        .select(
            "log_id",
            F.coalesce("standstill_ranges", F.lit(0)).alias("standstill_ranges"),
            F.col("timeout_crashed_leaders").alias("tcl_events"),
            F.when(F.col("standstill_ranges").isNull(), F.col("timeout_crashed_leaders"))
            .otherwise(F.coalesce("_outside", F.lit(0)))
            .alias("tcl_outside_standstill"),
        )
    )
