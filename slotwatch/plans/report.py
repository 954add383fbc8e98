"""The text report as a long table, one row per metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.functions.text import commas, fixed, humanize_full, humanize_header


def _rows(df: DataFrame, section: str, items: list[tuple[str, Column]], keep: Column | None = None) -> DataFrame:
    """``[log_id, section, metric, value]`` from columns of a one-row-per-log table."""
    structs = [
        F.struct(F.lit(metric).alias("metric"), value.cast("string").alias("value")) for metric, value in items
    ]
    if keep is not None:
        df = df.where(keep)
    return df.select("log_id", F.lit(section).alias("section"), F.inline(F.array(*structs)))


def summary_report(t) -> DataFrame:
    """All report sections of every log; ``t`` is a :class:`LogTables`."""
    facts = t.facts()
    c = F.col
    secs = F.call_function("div", c("hi_ns") - c("lo_ns"), F.lit(1_000_000_000).cast("bigint"))
    header = _rows(
        facts,
        "header",
        [
            ("lines", commas(c("line_count"))),
            ("duration", humanize_full(secs)),
            ("duration_short", humanize_header(secs)),
            ("min_slot", commas(c("min_slot"))),
            ("max_slot", commas(c("max_slot"))),
            ("distinct_slots", commas(c("distinct_slots"))),
            ("ingested", commas(c("ingested"))),
            ("ignored", commas(c("ignored_lines"))),
            ("continuations", commas(c("continuation_lines"))),
            ("parse_errors", commas(c("parse_errors"))),
        ],
    )
    verdicts = t.health_verdicts().select(
        "log_id",
        F.lit("health").alias("section"),
        "metric",
        F.concat(F.when(c("is_lower_bound"), ">=").otherwise(""), fixed(c("value"), 2)).alias("value"),
        "verdict",
    )
    skips = _rows(
        facts,
        "health",
        [
            ("vote_skips", commas(c("votes_skip"))),
            ("canonical_skips", commas(c("canonical_direct") + c("canonical_ancestry"))),
            ("indeterminate_skips", commas(c("indeterminate"))),
            ("total_slots", commas(c("distinct_slots"))),
        ],
    )
    crashed = _rows(
        t.crashed_leader_pct(),
        "health",
        [
            ("crashed_leaders", commas(c("tcl_outside_standstill"))),
            ("crashed_leaders_raw", commas(c("tcl_events"))),
        ],
    )
    rate = _rows(
        t.rates(),
        "health",
        [
            ("fragmentation", commas(c("fragmentation"))),
            ("fragmentation_per_hour", fixed(c("fragmentation_per_hour"), 2)),
        ],
    )
    leadership = _rows(
        t.leadership_share(),
        "leadership",
        [
            ("leader_windows", commas(c("produce_windows"))),
            ("leader_slots", commas(c("leader_slots"))),
            ("leader_slot_pct", fixed(c("leader_slot_pct"), 2)),
        ],
        c("produce_windows") > 0,
    )

    def percentiles(df: DataFrame, section: str, unit: float, digits: int) -> DataFrame:
        items = [(p, fixed(c(p) / F.lit(unit), digits)) for p in ("p50", "p95", "p99", "max")]
        return _rows(df, section, [("count", commas(c("n"))), *items])

    lifecycle = percentiles(t.lifecycle_latency(), "lifecycle", 1000.0, 1)
    resume = percentiles(t.resume_percentiles(), "resume", 1_000_000.0, 2)
    gap_counts = facts.select("log_id").join(
        t.voting_gaps().groupBy("log_id").agg(F.count(F.lit(1)).alias("n")), "log_id", "left"
    )
    gaps = _rows(gap_counts, "gaps", [("count", commas(F.coalesce(c("n"), F.lit(0))))])

    def top(df: DataFrame, section: str, text: Column) -> DataFrame:
        metric = F.concat(F.lit("top_"), c("place").cast("string"))
        return df.select("log_id", F.lit(section).alias("section"), metric.alias("metric"), text.alias("value"))

    slowest = top(
        t.top_slowest_slots(),
        "lifecycle",
        F.concat(F.lit("slot "), commas(c("slot")), F.lit(" "), fixed(c("us") / F.lit(1000.0), 1), F.lit(" ms ("), c("path"), F.lit(")")),
    )
    longest = top(
        t.top_resumes(),
        "resume",
        F.concat(
            F.lit("TCL "),
            commas(c("tcl_slot")),
            F.lit(" -> "),
            commas(c("resume_slot")),
            F.lit(" "),
            fixed(c("resume_us") / F.lit(1e6), 2),
            F.lit(" s (+"),
            c("slot_gap").cast("string"),
            F.lit(" slots)"),
        ),
    )
    widest = top(
        t.top_gaps(),
        "gaps",
        F.concat(
            F.lit("slots "),
            commas(c("start_slot")),
            F.lit(" -> "),
            commas(c("end_slot")),
            F.lit(" ("),
            commas(c("gap_slots")),
            F.lit(" slots, "),
            c("wall_secs").cast("string"),
            F.lit(" s)"),
        ),
    )
    flow = _rows(
        t.vote_cert_flow(),
        "vote_cert_flow",
        [
            ("votes_notarize", commas(c("votes_notarize"))),
            ("notarize_without_finalize", commas(c("notarize_without_finalize"))),
            ("votes_finalize", commas(c("votes_finalize"))),
            ("block_notarized", commas(c("block_notarized"))),
            ("block_notar_fallback", commas(c("block_notar_fallback"))),
            ("true_fallbacks", commas(c("true_fallbacks"))),
            ("true_fallback_pct", fixed(c("true_fallback_pct"), 2)),
            ("finalized", commas(c("finalized_total"))),
            ("finalized_fast", commas(c("finalized_fast"))),
            ("fast_pct", fixed(c("fast_pct"), 2)),
            ("finalized_slow", commas(c("finalized_slow"))),
        ],
    )
    blocks = _rows(
        t.block_flow(),
        "block_flow",
        [
            (n, commas(c(n)))
            for n in (
                "first_shreds",
                "frozen_without_shred",
                "bank_frozen",
                "frozen_not_rooted",
                "setting_root",
                "pruning_in_flight",
                "new_root",
            )
        ],
    )
    cluster = _rows(
        t.cluster_slots_rate(),
        "cluster_slots",
        [
            ("no_epoch_metadata", commas(c("no_epoch_metadata"))),
            ("per_sec", fixed(c("per_sec"), 2)),
            ("service_stopped", F.when(c("cluster_slots_service_stopped"), "yes").otherwise("no")),
        ],
    )
    tag = F.when(c("severity") == "Critical", "[CRIT] ").when(c("severity") == "Warn", "[WARN] ").otherwise("[INFO] ")
    alerts = t.alerts().select(
        "log_id",
        F.lit("alerts").alias("section"),
        c("alert_rank").cast("string").alias("metric"),
        F.concat(tag, c("description")).alias("value"),
    )
    plain = [header, skips, crashed, rate, leadership, lifecycle, resume, gaps, slowest, longest, widest, flow, blocks, cluster, alerts]
    if {"file_path", "file_size"} <= set(t.lines.columns):
        files = [("path", c("path")), ("n_files", commas(c("n_files"))), ("size_bytes", commas(c("size_bytes")))]
        plain.append(_rows(t.log_files(), "header", files))
    out = verdicts
    for part in plain:
        out = out.unionByName(part, allowMissingColumns=True)
    return out

