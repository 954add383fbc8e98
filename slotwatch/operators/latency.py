"""Slot latencies and the time from a leader timeout to the next notarize vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwatch.functions.classify import anchor_ns, delta_us, pct, resume_severity
from slotwatch.operators.ordered import neighbour, rank_within
from slotwatch.operators.ranks import PCTS, exact_ranks

STAGES = {
    "assembly": ("first_shred_ns", "block_emitted_ns"),
    "consensus": ("block_emitted_ns", "finalized_ns"),
    "lifecycle": ("first_shred_ns", "finalized_ns"),
}


def latency_samples(slots: DataFrame, *carry: str) -> DataFrame:
    """``[log_id, slot, stage, us]``, inverted and incomplete pairs left out."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("stage"), delta_us(a, b).alias("us")) for s, (a, b) in STAGES.items()]
    )
    return slots.select("log_id", "slot", *carry, F.inline(pairs)).where(F.col("us").isNotNull())


def percentile_table(samples: DataFrame, keys: list[str], value: str = "us") -> DataFrame:
    """n, p50, p95, p99 and max per group."""
    return exact_ranks(samples, keys, value, PCTS).select(
        *keys, "n", "p50", "p95", "p99", F.col("max_value").alias("max")
    )


def latency_stages(slots: DataFrame) -> DataFrame:
    return percentile_table(latency_samples(slots), ["log_id", "stage"])


def lifecycle_latency(slots: DataFrame) -> DataFrame:
    return percentile_table(
        latency_samples(slots).where(F.col("stage") == "lifecycle"), ["log_id"]
    )


def top_per_log(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each log; pruned to k per task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("log_id").orderBy(*order))
    return (
        df.withColumn("place", place)
        .where(F.col("place") <= k)
        .withColumn("place", F.col("place").cast("bigint"))
    )


def top_slowest_slots(slots: DataFrame, k: int = 5) -> DataFrame:
    us = delta_us(*STAGES["lifecycle"])
    path = F.when(F.col("fast_finalize"), "fast").when(~F.col("fast_finalize"), "slow").otherwise("?")
    rows = slots.select("log_id", "slot", us.alias("us"), path.alias("path")).where(F.col("us").isNotNull())
    return top_per_log(rows, k, F.col("us").desc(), F.col("slot"))


def vote_resumes(slots: DataFrame) -> DataFrame:
    """For each leader timeout the next slot with a notarize vote, in slot order.

    Dropped when there is none, or when that vote came before the timeout.
    """
    notarize = F.when(
        F.col("voted_notarize_ns").isNotNull(), F.struct("slot", F.col("voted_notarize_ns").alias("ns"))
    )
    relevant = slots.where(
        F.col("voted_notarize_ns").isNotNull() | F.col("timeout_crashed_leader_ns").isNotNull()
    ).select(
        "log_id", "slot", "voted_notarize_ns", "timeout_crashed_leader_ns", anchor_ns().alias("anchor_ns")
    )
    return (
        neighbour(relevant, notarize, "next_vote", forward=True)
        .where(F.col("timeout_crashed_leader_ns").isNotNull())
        .select(
            "log_id",
            F.col("slot").alias("tcl_slot"),
            F.col("next_vote.slot").alias("resume_slot"),
            delta_us(F.col("timeout_crashed_leader_ns"), F.col("next_vote.ns")).alias("resume_us"),
            F.col("timeout_crashed_leader_ns").alias("tcl_ns"),
            "anchor_ns",
        )
        .where(F.col("resume_us").isNotNull())
        .withColumn("slot_gap", F.greatest(F.col("resume_slot") - F.col("tcl_slot"), F.lit(0)))
        .withColumn("severity", resume_severity(F.col("resume_us")))
    )


def resume_severity_counts(resumes: DataFrame) -> DataFrame:
    return resumes.groupBy("log_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("normal", "elevated", "severe")],
        F.count(F.lit(1)).alias("total"),
    )


# Upper bounds of the resume-time bins in microseconds (fixed values); the last is open.
RESUME_BINS = (
    ("0.0-0.5s", 0, 500_000),
    ("0.5-1.0s", 500_000, 1_000_000),
    ("1.0-1.5s", 1_000_000, 1_500_000),
    ("1.5-2.0s", 1_500_000, 2_000_000),
    ("2.0-3.0s", 2_000_000, 3_000_000),
    ("3.0-4.0s", 3_000_000, 4_000_000),
    ("4.0-5.0s", 4_000_000, 5_000_000),
    (">5.0s", 5_000_000, None),
)


def resume_distribution(resumes: DataFrame) -> DataFrame:
    """Eight fixed bins per log with count and share of all resumes."""
    us = F.col("resume_us")
    counts = resumes.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("_total"),
        F.array(
            *[
                F.struct(
                    F.lit(i).cast("bigint").alias("bin"),
                    F.lit(label).alias("label"),
                    F.count_if((us >= lo) & (us < hi) if hi is not None else us >= lo).alias("n"),
                )
                for i, (label, lo, hi) in enumerate(RESUME_BINS)
            ]
        ).alias("_bins"),
    )
    return counts.select("log_id", "_total", F.inline("_bins")).select(
        "log_id", "bin", "label", "n", F.round(pct(F.col("n"), F.col("_total")), 6).alias("pct")
    )


def incidents(resumes: DataFrame) -> DataFrame:
    """All resumes with their ``place``: longest first, then by slot."""
    rows = resumes.select("log_id", "tcl_slot", "resume_slot", "resume_us", "slot_gap", "severity")
    down = -F.col("resume_us")
    return rank_within(rows, ["log_id"], [[F.shiftright(down, 20)], [down, F.shiftright("tcl_slot", 16)]], [F.col("tcl_slot")], "place")


def top_resumes(resumes: DataFrame, k: int = 5) -> DataFrame:
    rows = resumes.select("log_id", "tcl_slot", "resume_slot", "resume_us", "slot_gap")
    return top_per_log(rows, k, F.col("resume_us").desc(), F.col("tcl_slot"))
