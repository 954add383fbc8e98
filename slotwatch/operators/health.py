"""Per-log rates, shares and verdicts, all from one row of facts per log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.functions import classify as C
from slotwatch.functions.classify import div, minus_floor0, pct

c = F.col
SLOTS_PER_LEADER_WINDOW = 4  # fixed value


def log_facts(
    meta: DataFrame,
    ingest: DataFrame,
    overall: DataFrame,
    outcomes: DataFrame,
    tcl: DataFrame,
    resumes: DataFrame,
    lifecycle: DataFrame,
) -> DataFrame:
    """Everything known about a log in one row. All inputs have one row per log."""
    counts = outcomes.columns[1:]
    n_counts = [x for x in counts if x not in ("min_slot", "max_slot")]
    resume_counts = resumes.groupBy("log_id").agg(F.count(F.lit(1)).alias("resume_total"))
    life = lifecycle.select(
        "log_id", F.col("p95").alias("lifecycle_p95_us"), F.col("max").alias("lifecycle_max_us")
    )
    return (
        meta.join(ingest.drop("lines"), "log_id")
        .join(overall, "log_id")
        .join(outcomes, "log_id", "left")
        .join(tcl.select("log_id", "standstill_ranges", "tcl_outside_standstill"), "log_id", "left")
        .join(resume_counts, "log_id", "left")
        .join(life, "log_id", "left")
        .na.fill(0, [*n_counts, "resume_total", "lifecycle_p95_us", "lifecycle_max_us"])
    )


def hours() -> Column:
    """Real hours covered by the log; NULL when no line carried a time."""
    return (c("hi_ns") - c("lo_ns")) / F.lit(1e9) / F.lit(3600.0)


def hours_at_least_one() -> Column:
    return F.greatest(F.coalesce(hours(), F.lit(1.0)), F.lit(1.0))


def _final_total() -> Column:
    return c("finalized_fast") + c("finalized_slow")


def _canonical() -> Column:
    return c("canonical_direct") + c("canonical_ancestry")


def _true_fallbacks() -> Column:
    return minus_floor0(c("block_notar_fallback"), c("block_notarized"))


def r6(col: Column) -> Column:
    return F.round(col, 6)


def slot_range(facts: DataFrame) -> DataFrame:
    return facts.where(c("distinct_slots") > 0).select("log_id", "min_slot", "max_slot", "distinct_slots")


def vote_cert_flow(facts: DataFrame) -> DataFrame:
    return facts.select(
        "log_id",
        "votes_notarize",
        "votes_finalize",
        minus_floor0(c("votes_notarize"), c("votes_finalize")).alias("notarize_without_finalize"),
        "block_notarized",
        "block_notar_fallback",
        _true_fallbacks().alias("true_fallbacks"),
        r6(pct(_true_fallbacks(), c("block_notar_fallback"))).alias("true_fallback_pct"),
        "fallback_only_slots",
        _final_total().alias("finalized_total"),
        "finalized_fast",
        "finalized_slow",
        r6(pct(c("finalized_fast"), _final_total())).alias("fast_pct"),
        r6(pct(c("finalized_slow"), _final_total())).alias("slow_pct"),
    )


def block_flow(facts: DataFrame) -> DataFrame:
    return facts.select(
        "log_id",
        "first_shreds",
        "bank_frozen",
        "setting_root",
        "new_root",
        minus_floor0(c("bank_frozen"), c("first_shreds")).alias("frozen_without_shred"),
        minus_floor0(c("bank_frozen"), c("setting_root")).alias("frozen_not_rooted"),
        minus_floor0(c("setting_root"), c("new_root")).alias("pruning_in_flight"),
    )


def cluster_slots_rate(facts: DataFrame) -> DataFrame:
    """Only logs that show the signal have a row."""
    return facts.where((c("no_epoch_metadata") > 0) | c("cluster_slots_service_stopped")).select(
        "log_id",
        "no_epoch_metadata",
        "cluster_slots_service_stopped",
        r6(c("no_epoch_metadata") / (hours_at_least_one() * F.lit(3600.0))).alias("per_sec"),
    )


def leadership_share(facts: DataFrame) -> DataFrame:
    return facts.select(
        "log_id",
        "produce_windows",
        "leader_slots",
        "distinct_slots",
        r6(pct(c("leader_slots"), c("distinct_slots"))).alias("leader_slot_pct"),
    )


def crashed_leader_pct(facts: DataFrame) -> DataFrame:
    """Leader timeouts against the number of leader windows, with and without standstills."""
    total = div(c("distinct_slots"), SLOTS_PER_LEADER_WINDOW)
    return facts.select(
        "log_id",
        total.alias("leader_windows"),
        c("timeout_crashed_leaders").alias("tcl_events"),
        "tcl_outside_standstill",
        r6(pct(c("timeout_crashed_leaders"), total)).alias("crashed_pct"),
        r6(pct(c("tcl_outside_standstill"), total)).alias("crashed_outside_pct"),
        (c("standstill_ranges") > 0).alias("has_standstill"),
    )


def rates(facts: DataFrame) -> DataFrame:
    """Hourly rates: resumes over the real hours, fragmentation over at least one hour."""
    frag = c("safe_to_notar") + c("safe_to_skip")
    return facts.select(
        "log_id",
        "resume_total",
        r6(F.when(hours() > 0, c("resume_total") / F.nullif(hours(), F.lit(0.0)))).alias("resumes_per_hour"),
        frag.alias("fragmentation"),
        r6(frag / hours_at_least_one()).alias("fragmentation_per_hour"),
    )


def fin_pcts(facts: DataFrame) -> DataFrame:
    """Outcome shares of slots; canonical skips against skipped slots and skip events."""
    return facts.select(
        "log_id",
        r6(pct(c("finalized_slots"), c("distinct_slots"))).alias("finalized_pct"),
        r6(pct(c("skipped_slots"), c("distinct_slots"))).alias("skipped_pct"),
        r6(pct(c("votes_skip"), c("distinct_slots"))).alias("vote_skip_events_pct"),
        r6(pct(_canonical(), c("skipped_slots"))).alias("canonical_pct_slots"),
        r6(pct(_canonical(), c("votes_skip"))).alias("canonical_pct_events"),
    )


def health_verdicts(facts: DataFrame) -> DataFrame:
    """``[log_id, metric, value, verdict, is_lower_bound]``.

    A canonical-skip share is a lower bound while some skips are undecided.
    """
    fast = pct(c("finalized_fast"), _final_total())
    canon_events = pct(_canonical(), c("votes_skip"))
    canon_slots = pct(_canonical(), c("skipped_slots"))
    fin = pct(c("finalized_slots"), c("distinct_slots"))
    skip = pct(c("skipped_slots"), c("distinct_slots"))
    skip_events = pct(c("votes_skip"), c("distinct_slots"))
    true_fb = pct(_true_fallbacks(), c("block_notar_fallback"))
    p95_ms = div(c("lifecycle_p95_us"), 1000)
    max_ms = div(c("lifecycle_max_us"), 1000)
    undecided = c("indeterminate") > 0
    rows = [
        (
            "fast_finalize_pct",
            fast,
            F.when(fast >= C.FAST_FIN_GOOD_PCT, "ok").when(fast >= C.FAST_FIN_WARN_PCT, "degraded").otherwise("critical"),
            F.lit(False),
        ),
        (
            "canonical_skip_pct",
            canon_events,
            F.when(canon_events < C.CANONICAL_SKIP_WARN_PCT, "ok")
            .when(canon_events < C.CANONICAL_SKIP_BAD_PCT, "degraded")
            .otherwise("critical"),
            undecided,
        ),
        (
            "standstills",
            c("standstill_events"),
            F.when(c("standstill_events") == 0, "none").otherwise("seen"),
            F.lit(False),
        ),
        (
            "refresh_votes",
            c("refreshing_votes"),
            F.when(c("refreshing_votes") == 0, "none").otherwise("seen"),
            F.lit(False),
        ),
        (
            "true_fallback_pct",
            true_fb,
            F.when(true_fb < C.TRUE_FB_ELEVATED_PCT, "rare").otherwise("elevated"),
            F.lit(False),
        ),
        ("finalized_pct", fin, C.band_higher_better(fin, C.FIN_GOOD_PCT, C.FIN_WARN_PCT), F.lit(False)),
        (
            "vote_skip_events_pct",
            skip_events,
            C.band_lower_better(skip_events, C.VOTE_SKIP_WARN_PCT, C.VOTE_SKIP_BAD_PCT),
            F.lit(False),
        ),
        (
            "vote_skip_slots_pct",
            skip,
            C.band_lower_better(skip, C.VOTE_SKIP_WARN_PCT, C.VOTE_SKIP_BAD_PCT),
            F.lit(False),
        ),
        (
            "canonical_skip_slots_pct",
            canon_slots,
            C.band_lower_better(canon_slots, C.CANONICAL_SKIP_WARN_PCT, C.CANONICAL_SKIP_BAD_PCT),
            undecided,
        ),
        ("lifecycle_p95_ms", p95_ms, F.when(p95_ms <= C.LIFECYCLE_WARN_MS, "good").otherwise("warn"), F.lit(False)),
        ("lifecycle_max_ms", max_ms, F.when(max_ms >= C.LIFECYCLE_BAD_MS, "bad").otherwise("warn"), F.lit(False)),
    ]
    structs = [
        F.struct(
            F.lit(name).alias("metric"),
            r6(value.cast("double")).alias("value"),
            verdict.alias("verdict"),
            bound.alias("is_lower_bound"),
        )
        for name, value, verdict, bound in rows
    ]
    return facts.select("log_id", F.inline(F.array(*structs)))
