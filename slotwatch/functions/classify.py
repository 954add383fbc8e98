"""Status labels, severity bands and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: health thresholds ------------------------------------------------
FAST_FIN_GOOD_PCT = 80.0
FAST_FIN_WARN_PCT = 60.0
FIN_GOOD_PCT = 90.0
FIN_WARN_PCT = 80.0
VOTE_SKIP_WARN_PCT = 5.0
VOTE_SKIP_BAD_PCT = 15.0
CANONICAL_SKIP_WARN_PCT = 0.5
CANONICAL_SKIP_BAD_PCT = 2.0
TRUE_FB_ELEVATED_PCT = 0.5
ASSEMBLY_WARN_MS = 500.0
ASSEMBLY_BAD_MS = 600.0
LIFECYCLE_WARN_MS = 600.0
LIFECYCLE_BAD_MS = 1000.0
RESUME_ELEVATED_US = 1_500_000
RESUME_SEVERE_US = 3_000_000
# ------------------------------------------------------------------------------------


def delta_us(start: str | Column, end: str | Column) -> Column:
    """Whole microseconds from ``start`` to ``end`` (both ns); NULL when inverted.

    The division truncates toward zero, so an inversion of under 1 us counts as 0.
    """
    a = F.col(start) if isinstance(start, str) else start
    b = F.col(end) if isinstance(end, str) else end
    us = F.call_function("div", b - a, F.lit(1000).cast("bigint"))
    return F.when(us >= 0, us)


def div(a: Column, b: int | Column) -> Column:
    """Integer division truncating toward zero."""
    return F.call_function("div", a, F.lit(b).cast("bigint") if isinstance(b, int) else b)


def pct(num: Column, den: Column) -> Column:
    """``num`` as a percentage of ``den``, 0 when there is nothing to divide by."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num * F.lit(100.0) / F.nullif(den, F.lit(0)))


def minus_floor0(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def resume_severity(us: Column) -> Column:
    return (
        F.when((us < 0) | (us >= RESUME_SEVERE_US), "severe")
        .when(us >= RESUME_ELEVATED_US, "elevated")
        .otherwise("normal")
    )


def anchor_ns() -> Column:
    """The first known timestamp of a slot; buckets and windows place the slot by it."""
    return F.coalesce("first_shred_ns", "voted_notarize_ns", "voted_skip_ns", "timeout_crashed_leader_ns")


def is_canonical_skip() -> Column:
    return F.col("skip_classification").isin("canonical_direct", "canonical_ancestry")


def slot_status() -> Column:
    return (
        F.when(F.col("voted_skip_ns").isNotNull(), "skipped")
        .when(F.col("finalized_ns").isNull(), "pending")
        .when(F.coalesce(F.col("fast_finalize"), F.lit(False)), "fast")
        .otherwise("slow")
    )


def status_label(status: Column) -> Column:
    return (
        F.when(status.isin("fast", "slow"), "FIN")
        .when(status == "pending", "PEND")
        .when(is_canonical_skip(), "CSKIP")
        .otherwise("VSKIP")
    )


def vote_pattern() -> Column:
    """``N``, ``N+F``, ``N+S``, ``N+F+S``, ``S`` or ``-`` (finalize alone is ``-``)."""
    notarize = F.col("voted_notarize_ns").isNotNull()
    finalize = F.col("voted_finalize_ns").isNotNull()
    skip = F.col("voted_skip_ns").isNotNull()
    return F.when(
        notarize,
        F.concat_ws("+", F.lit("N"), F.when(finalize, "F"), F.when(skip, "S")),
    ).otherwise(F.when(skip, "S").otherwise("-"))


def path_label(status: Column) -> Column:
    fast = F.col("fast_finalize")
    return (
        F.when((status == "fast") | fast, "F")
        .when((status == "slow") | ~fast, "S")
        .otherwise(" ")
    )


def event_tags() -> Column:
    return F.concat_ws(
        " ",
        F.when(F.col("timeout_crashed_leader_ns").isNotNull(), "TCL"),
        F.when(F.col("safe_to_notar_ns").isNotNull(), "S2N"),
        F.when(F.col("safe_to_skip_ns").isNotNull(), "S2S"),
    )


def consensus_inverted() -> Column:
    return F.coalesce(F.col("finalized_ns") < F.col("block_emitted_ns"), F.lit(False))


def band_higher_better(v: Column, good: float, warn: float) -> Column:
    return F.when(v >= good, "good").when(v >= warn, "warn").otherwise("bad")


def band_lower_better(v: Column, warn: float, bad: float) -> Column:
    return F.when(v < warn, "good").when(v < bad, "warn").otherwise("bad")


def severity_rank(severity: Column) -> Column:
    """Info < Warn < Critical."""
    return F.when(severity == "Critical", 2).when(severity == "Warn", 1).otherwise(0)
