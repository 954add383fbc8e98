"""Comparison windows that all end at the log's end.

The windows are nested: a slot inside the 1 h window is inside all longer ones. So each
slot is put into one ring (the innermost window it belongs to), everything is counted
per ring, and only those few counts are repeated for the windows around the ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.functions.classify import anchor_ns, is_canonical_skip, pct
from slotwatch.operators.latency import latency_samples
from slotwatch.operators.ranks import PCTS, count_values, ranks_of_counts
from slotwatch.operators.sizing import join_small
from slotwatch.operators.view import slot_durations

HOUR_NS = 3_600_000_000_000
WINDOW_HOURS = (24, 12, 6, 3, 1)  # fixed values: window lengths, longest first
SLOT_TIME_MS = 400.0  # fixed value: nominal slot time


def window_label(secs: Column) -> Column:
    """Label of a window length: the shortest standard window that holds it."""
    out = F.when(secs <= 3600, "1h")
    for h in (3, 6, 12):
        out = out.when(secs <= h * 3600, f"{h}h")
    return out.otherwise("24h")


def windows(meta: DataFrame) -> DataFrame:
    """Six windows per log: ``[log_id, win, label, start_ns, end_ns, secs]``."""
    lo, hi = F.col("lo_ns"), F.col("hi_ns")
    rows = [
        F.struct(
            F.lit(0).alias("win"),
            F.lit("all").alias("label"),
            lo.alias("start_ns"),
            hi.alias("end_ns"),
            ((hi - lo) / F.lit(1e9)).alias("secs"),
        )
    ]
    for i, h in enumerate(WINDOW_HOURS, 1):
        rows.append(
            F.struct(
                F.lit(i).alias("win"),
                window_label(F.lit(h * 3600)).alias("label"),
                F.greatest(hi - F.lit(h * HOUR_NS), lo).alias("start_ns"),
                hi.alias("end_ns"),
                F.lit(float(h * 3600)).alias("secs"),
            )
        )
    return meta.where(lo.isNotNull()).select("log_id", F.inline(F.array(*rows)))


def in_window(anchor: Column, start: Column, end: Column) -> Column:
    """Half-open: a slot exactly at the end is outside."""
    return (anchor >= start) & (anchor < end)


def with_ring(df: DataFrame, meta: DataFrame, first: Column, last: Column | None = None) -> DataFrame:
    """Adds ``ring``: the innermost window that holds ``first`` (and ``last``).

    Rows outside of all windows are dropped.
    """
    hi, lo = F.col("hi_ns"), F.col("lo_ns")
    ring = F.lit(0)
    for h in WINDOW_HOURS:
        ring = ring + (first >= F.greatest(hi - F.lit(h * HOUR_NS), lo)).cast("int")
    inside = in_window(first, lo, hi)
    if last is not None:
        inside = inside & (last < hi)
    return (
        join_small(df, meta.select("log_id", "lo_ns", "hi_ns"), ["log_id"])
        .where(inside)
        .withColumn("ring", ring)
        .drop("lo_ns", "hi_ns")
    )


def _spread(per_ring: DataFrame) -> DataFrame:
    """Repeat per-ring rows for every window around the ring."""
    return per_ring.withColumn("win", F.explode(F.sequence(F.lit(0), F.col("ring")))).drop("ring")


def window_stats(slots: DataFrame, resumes: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts, shares and exact percentiles for each window of each log."""
    placed = with_ring(slots, meta, anchor_ns())
    skipped = F.col("voted_skip_ns").isNotNull()
    flags = {
        "slot_count": F.lit(True),
        "_fast": F.col("fast_finalize"),
        "_slow": ~F.col("fast_finalize"),
        "vote_skips": skipped,
        "canonical_skips": skipped & is_canonical_skip(),
        "indeterminate_skips": skipped & (F.col("skip_classification") == "indeterminate"),
        "crashed_leaders": F.col("timeout_crashed_leader_ns").isNotNull(),
        "_s2n": F.col("safe_to_notar_ns").isNotNull(),
        "_s2s": F.col("safe_to_skip_ns").isNotNull(),
    }
    per_ring = placed.groupBy("log_id", "ring").agg(*[F.count_if(v).alias(n) for n, v in flags.items()])
    counts = _spread(per_ring).groupBy("log_id", "win").agg(*[F.sum(n).alias(n) for n in flags])

    durations = with_ring(slot_durations(slots), meta, F.col("from_ns"), F.col("to_ns")).select(
        "log_id", "ring", F.lit("slot_duration").alias("stage"), F.col("duration_us").alias("us")
    )
    resume = with_ring(resumes.where(F.col("anchor_ns").isNotNull()), meta, F.col("anchor_ns")).select(
        "log_id", "ring", F.lit("resume").alias("stage"), F.col("resume_us").alias("us")
    )
    stages = latency_samples(placed, "ring").select("log_id", "ring", "stage", "us")
    values = count_values(
        stages.unionByName(durations).unionByName(resume), ["log_id", "ring", "stage"], "us"
    )
    per_window = _spread(values).groupBy("log_id", "win", "stage", "us").agg(F.sum("_w").alias("_w"))
    ranks = ranks_of_counts(per_window, ["log_id", "win", "stage"], "us", PCTS)
    shown = {
        "slot_duration": ("p50", "p95"),
        "assembly": ("p50", "p95"),
        "consensus": ("p50", "p95"),
        "lifecycle": ("p50", "p95", "p99"),
        "resume": ("p50", "p95", "p99"),
    }
    wide = ranks.groupBy("log_id", "win").agg(
        *[
            F.max(F.when(F.col("stage") == s, F.col(p))).alias(f"{s}_{p}_us")
            for s, ps in shown.items()
            for p in ps
        ]
    )
    out = windows(meta).join(counts, ["log_id", "win"], "left").join(wide, ["log_id", "win"], "left")
    out = out.na.fill(0, [*flags, *[f"{s}_{p}_us" for s, ps in shown.items() for p in ps]])
    c = F.col
    return out.select(
        "log_id",
        "label",
        "start_ns",
        "end_ns",
        "slot_count",
        F.round(c("slot_count") / F.greatest(c("secs"), F.lit(1.0)), 6).alias("slot_rate_per_sec"),
        F.round(pct(c("_fast"), c("_fast") + c("_slow")), 6).alias("fast_finalize_pct"),
        F.round(pct(c("vote_skips"), c("slot_count")), 6).alias("vote_skip_pct"),
        "vote_skips",
        "canonical_skips",
        "indeterminate_skips",
        F.round(pct(c("canonical_skips"), c("vote_skips")), 6).alias("canonical_skip_pct"),
        "crashed_leaders",
        (c("_s2n") + c("_s2s")).alias("fragmentation"),
        *[f"{s}_{p}_us" for s, ps in shown.items() for p in ps],
        F.round(c("lifecycle_p95_us") / F.lit(1000.0) / F.lit(SLOT_TIME_MS), 6).alias("lifecycle_p95_per_slot_time"),
    )
