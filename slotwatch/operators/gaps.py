"""Runs of slots without a local vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwatch.functions.classify import div
from slotwatch.operators.latency import top_per_log
from slotwatch.operators.ordered import neighbour

REPORT_MIN_GAP = 2


def voting_gaps(slots: DataFrame, min_size: int = REPORT_MIN_GAP) -> DataFrame:
    """Gaps of at least ``min_size`` slots between two voted slots.

    Slot numbers without a record count as not voted, so a gap is simply the distance
    between neighbouring voted slots; no slot is materialised for it.
    """
    voted = slots.select(
        "log_id", "slot", F.coalesce("voted_notarize_ns", "voted_skip_ns").alias("vote_ns")
    ).where(F.col("vote_ns").isNotNull())
    return (
        neighbour(voted, F.struct("slot", "vote_ns"), "last", forward=False)
        .where(F.col("slot") - F.col("last.slot") > F.lit(max(min_size, 1)))
        .select(
            "log_id",
            (F.col("last.slot") + 1).alias("start_slot"),
            (F.col("slot") - 1).alias("end_slot"),
            (F.col("slot") - F.col("last.slot") - 1).alias("gap_slots"),
            F.col("last.vote_ns").alias("last_vote_ns"),
            F.col("vote_ns").alias("resume_vote_ns"),
        )
    )


def top_gaps(gaps: DataFrame, k: int = 5) -> DataFrame:
    rows = gaps.withColumn(
        "wall_secs", div(F.col("resume_vote_ns") - F.col("last_vote_ns"), 1_000_000_000)
    ).select("log_id", "start_slot", "end_slot", "gap_slots", "wall_secs")
    return top_per_log(rows, k, F.col("gap_slots").desc(), F.col("start_slot"))
