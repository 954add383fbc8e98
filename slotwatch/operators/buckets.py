"""Fixed-width, gap-free time buckets that start at the log's first timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.functions.classify import anchor_ns, delta_us, div, is_canonical_skip
from slotwatch.functions.text import DEFAULT_BUCKET_SECS, saturating_sum
from slotwatch.operators.ranks import exact_ranks, rank_floor, rank_tenth
from slotwatch.operators.sizing import join_small

SECOND_NS = 1_000_000_000
SPINE_BLOCK = 65_536


def _width(bucket_secs: int) -> Column:
    return F.lit(max(bucket_secs, 1)).cast("bigint")


def bucket_count(bucket_secs: int) -> Column:
    """Number of buckets of a log from its ``lo_ns`` and ``hi_ns``; at least a minute's."""
    total = F.greatest(div(F.col("hi_ns") - F.col("lo_ns"), SECOND_NS), F.lit(60).cast("bigint"))
    width = _width(bucket_secs)
    return F.greatest(div(total + width - 1, width), F.lit(1).cast("bigint"))


def bucket_index(ts: Column, bucket_secs: int) -> Column:
    """Bucket of a timestamp; before the start counts as first, the tail as last."""
    elapsed = F.greatest(div(ts - F.col("lo_ns"), SECOND_NS), F.lit(0).cast("bigint"))
    return F.least(div(elapsed, _width(bucket_secs)), bucket_count(bucket_secs) - 1)


def bucket_spine(meta: DataFrame, bucket_secs: int) -> DataFrame:
    """Every bucket of every log: ``[log_id, bucket, start_ns]``."""
    # Blocks first, then each block's buckets: no array is longer than a block, and the
    # blocks of one long log can be spread over tasks.
    block, last = F.lit(SPINE_BLOCK).cast("bigint"), bucket_count(bucket_secs) - 1
    blocks = meta.where(F.col("lo_ns").isNotNull()).select(
        "log_id", "lo_ns", last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("bigint"), div(last, block))).alias("_block")
    )
    first = F.col("_block") * block
    return (
        blocks.select(
            "log_id", "lo_ns", F.explode(F.sequence(first, F.least(first + block - 1, F.col("_last")))).alias("bucket")
        )
        .select(
            "log_id", "bucket", (F.col("lo_ns") + F.col("bucket") * _width(bucket_secs) * SECOND_NS).alias("start_ns")
        )
    )


COUNTS = (
    "finalized_fast",
    "finalized_slow",
    "votes_skip",
    "canonical_skips",
    "crashed_leaders",
    "safe_to_notar",
    "safe_to_skip",
    "our_leader_slots",
    "signature_sum",
    "signature_sample_count",
)


def _placed(df: DataFrame, meta: DataFrame, ts: Column, bucket_secs: int) -> DataFrame:
    joined = join_small(df, meta.select("log_id", "lo_ns", "hi_ns"), ["log_id"])
    return joined.withColumn("bucket", bucket_index(ts, bucket_secs)).drop("lo_ns", "hi_ns")


def bucket_samples(slots: DataFrame, resumes: DataFrame, meta: DataFrame, bucket_secs: int) -> DataFrame:
    """``[log_id, bucket, stage, us]``: the latencies that fall into each bucket.

    A resume belongs to the bucket of its leader timeout.
    """
    lifecycle = _placed(
        slots.select("log_id", anchor_ns().alias("_at"), delta_us("first_shred_ns", "finalized_ns").alias("us")).where(
            F.col("us").isNotNull()
        ),
        meta,
        F.col("_at"),
        bucket_secs,
    ).select("log_id", "bucket", F.lit("lifecycle").alias("stage"), "us")
    resume = _placed(
        resumes.select("log_id", "tcl_ns", F.col("resume_us").alias("us")), meta, F.col("tcl_ns"), bucket_secs
    ).select("log_id", "bucket", F.lit("resume").alias("stage"), "us")
    return lifecycle.unionByName(resume)


def time_buckets(
    slots: DataFrame, resumes: DataFrame, meta: DataFrame, bucket_secs: int = DEFAULT_BUCKET_SECS
) -> DataFrame:
    """Unique-slot counts and p95 latencies per bucket, empty buckets as zeros."""
    placed = _placed(
        slots.withColumn("_at", anchor_ns()).where(F.col("_at").isNotNull()), meta, F.col("_at"), bucket_secs
    )
    skipped = F.col("voted_skip_ns").isNotNull()
    counts = placed.groupBy("log_id", "bucket").agg(
        F.count_if(F.col("fast_finalize")).alias("finalized_fast"),
        F.count_if(~F.col("fast_finalize")).alias("finalized_slow"),
        F.count_if(skipped).alias("votes_skip"),
        F.count_if(skipped & is_canonical_skip()).alias("canonical_skips"),
        F.count_if(F.col("timeout_crashed_leader_ns").isNotNull()).alias("crashed_leaders"),
        F.count_if(F.col("safe_to_notar_ns").isNotNull()).alias("safe_to_notar"),
        F.count_if(F.col("safe_to_skip_ns").isNotNull()).alias("safe_to_skip"),
        F.count_if(F.col("we_are_leader")).alias("our_leader_slots"),
        saturating_sum(F.col("signature_count")).alias("signature_sum"),
        F.count("signature_count").alias("signature_sample_count"),
    )
    ranks = exact_ranks(
        bucket_samples(slots, resumes, meta, bucket_secs), ["log_id", "bucket", "stage"], "us", {"p95": rank_floor(0.95)}
    )
    is_life, is_resume = F.col("stage") == "lifecycle", F.col("stage") == "resume"
    wide = ranks.groupBy("log_id", "bucket").agg(
        F.max(F.when(is_life, F.col("p95"))).alias("lifecycle_p95_us"),
        F.max(F.when(is_life, F.col("n"))).alias("lifecycle_n"),
        F.max(F.when(is_resume, F.col("p95"))).alias("resume_p95_us"),
        F.max(F.when(is_resume, F.col("n"))).alias("resume_n"),
    )
    extra = ("lifecycle_p95_us", "lifecycle_n", "resume_p95_us", "resume_n")
    return (
        bucket_spine(meta, bucket_secs)
        .join(counts, ["log_id", "bucket"], "left")
        .join(wide, ["log_id", "bucket"], "left")
        .na.fill(0, [*COUNTS, *extra])
        .select("log_id", "bucket", "start_ns", *COUNTS, *extra)
    )


def bucket_series(buckets: DataFrame, bucket_secs: int = DEFAULT_BUCKET_SECS) -> DataFrame:
    """The derived series of each bucket."""
    c = F.col
    total = c("finalized_fast") + c("finalized_slow")
    fast_share = F.coalesce(div(c("finalized_fast") * 100, F.nullif(total, F.lit(0).cast("bigint"))), F.lit(0))
    return buckets.select(
        "log_id",
        "bucket",
        F.round(
            F.when(total == 0, 0.0).otherwise(c("finalized_fast") * 100.0 / F.nullif(total, F.lit(0))), 6
        ).alias("fast_finalize_pct"),
        c("votes_skip").alias("skip_count"),
        c("canonical_skips").alias("canonical_skip_count"),
        c("crashed_leaders").alias("crashed_leader_count"),
        (c("safe_to_notar") + c("safe_to_skip")).alias("fragmentation_count"),
        c("safe_to_notar").alias("safe_to_notar_count"),
        c("safe_to_skip").alias("safe_to_skip_count"),
        c("our_leader_slots").alias("our_leader_slot_count"),
        "signature_sum",
        div(c("signature_sum"), _width(bucket_secs)).alias("tx_per_second"),
        total.alias("finalized_total_count"),
        fast_share.alias("fast_pct"),
        F.when(total == 0, F.lit(0).cast("bigint")).otherwise(100 - fast_share).alias("slow_pct"),
        "lifecycle_p95_us",
        "resume_p95_us",
        c("resume_n").alias("resume_count"),
    )


SERIES = (
    "fast_pct",
    "slow_pct",
    "skip_count",
    "canonical_skip_count",
    "safe_to_notar_count",
    "safe_to_skip_count",
    "crashed_leader_count",
    "our_leader_slot_count",
    "tx_per_second",
    "finalized_total_count",
    "lifecycle_p95_ms",
    "resume_p95_ms",
)


def long_series(series: DataFrame) -> DataFrame:
    """``[log_id, bucket, series, value]``; latencies in whole milliseconds."""
    wide = series.withColumn("lifecycle_p95_ms", div(F.col("lifecycle_p95_us"), 1000)).withColumn(
        "resume_p95_ms", div(F.col("resume_p95_us"), 1000)
    )
    pairs = F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).alias("value")) for s in SERIES])
    return wide.select("log_id", "bucket", F.inline(pairs))


def series_stats(long: DataFrame) -> DataFrame:
    v = F.col("value")
    n = F.count(F.lit(1))
    return long.groupBy("log_id", "series").agg(
        saturating_sum(v).alias("total"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        div(saturating_sum(v), n).alias("mean_value"),
        F.count_if(v > 0).alias("active"),
        n.alias("n_buckets"),
    )


def deviation_series(long: DataFrame) -> DataFrame:
    """Each value above the series' baseline (its tenth-percentile value)."""
    keys = ["log_id", "series"]
    base = exact_ranks(long, keys, "value", {"baseline": rank_tenth}).select(
        *keys, "baseline", F.greatest(F.col("max_value") - F.col("baseline"), F.lit(1).cast("bigint")).alias("dev_peak")
    )
    return long.join(base, keys).select(
        *keys,
        "bucket",
        "value",
        "baseline",
        F.greatest(F.col("value") - F.col("baseline"), F.lit(0).cast("bigint")).alias("deviation"),
        "dev_peak",
    )


def trend_stats(buckets: DataFrame) -> DataFrame:
    """Resumes per bucket: total, peak, min, mean, coverage and baseline deviation."""
    v = F.col("resume_n")
    n = F.count(F.lit(1))
    active = F.count_if(v > 0)
    stats = buckets.groupBy("log_id").agg(
        F.sum(v).alias("total"),
        F.max(v).alias("peak"),
        F.min(v).alias("min_value"),
        F.round(F.sum(v) / n, 6).alias("avg_value"),
        active.alias("nonzero"),
        F.round(active * 100.0 / n, 6).alias("coverage_pct"),
    )
    base = exact_ranks(buckets, ["log_id"], "resume_n", {"baseline": rank_tenth})
    return stats.join(base.select("log_id", "baseline"), "log_id").withColumn(
        "dev_peak", F.greatest(F.col("peak") - F.col("baseline"), F.lit(0).cast("bigint"))
    )


def tx_per_block(buckets: DataFrame) -> DataFrame:
    sums = buckets.groupBy("log_id").agg(
        saturating_sum(F.col("signature_sum")).alias("signature_sum"), F.sum("signature_sample_count").alias("blocks")
    )
    return sums.withColumn(
        "avg_tx_per_block",
        F.coalesce(div(F.col("signature_sum"), F.nullif(F.col("blocks"), F.lit(0).cast("bigint"))), F.lit(0)),
    )


def resample_nearest(series: DataFrame, keys: list[str], index: str, value: str, width: int) -> DataFrame:
    """``width`` points per series: point i shows element ``i * len div width``.

    ``index`` numbers the elements of a series densely from 0. Nothing for width 0.
    """
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    points = sizes.where(F.lit(width > 0)).select(
        *keys, "_len", F.explode(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)).cast("array<bigint>")).alias("point")
    )
    wanted = points.select(*keys, "point", div(F.col("point") * F.col("_len"), max(width, 1)).alias(index))
    return wanted.join(series, [*keys, index]).select(*keys, "point", value)
