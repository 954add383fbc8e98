"""The ordered alert list and its details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.functions.classify import div, severity_rank
from slotwatch.functions.text import PREVIEW_MAX_BYTES, humanize_full, truncate_utf8
from slotwatch.operators.issues import issue_group_lookup
from slotwatch.operators.ordered import rank_within
from slotwatch.operators.slots import valid_leader_window

# --- fixed values: alert kinds in tie-break order, and alert texts ------------------
ALERT_KINDS = (
    "LogPattern",
    "StandstillObserved",
    "ClusterSlotsShutdownObserved",
    "IdentityChanged",
    "LocalLeaderSummary",
)
SHORT_NAMES = {
    "StandstillObserved": "standstill",
    "ClusterSlotsShutdownObserved": "shutdown",
    "IdentityChanged": "identity-change",
    "LocalLeaderSummary": "local-leader",
}
IDENTITY_TEXT = "Operator rotated validator identity (Set identity event)"
SHUTDOWN_TEXT = "ClusterSlotsService has stopped — validator entered FullAlpenglowEpoch"
STANDSTILL_TEXT = "Standstill firing at finalized slot %d"
LEADER_TEXT = "Local validator was leader: %d slots = %d windows × 4 slots/window"
PATTERN_TEXT = "%s %s (%d occurrence%s): %s"
# ------------------------------------------------------------------------------------

# Columns every alert has; the ones a kind does not use are NULL. ``tie`` and ``module``
# order alerts of equal severity, time and kind.
_COLUMNS = (
    "log_id",
    "severity",
    "at_ns",
    "kind",
    "description",
    "module",
    "count",
    "at_slot",
    "last_ns",
    "slot_count",
    "window_count",
    "tie",
)


def _shape(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            F.col(c) if c in have else F.lit(None).cast("string" if c == "module" else "bigint").alias(c)
            for c in _COLUMNS
        ]
    )


def pattern_alerts(groups: DataFrame) -> DataFrame:
    label = F.when(F.col("severity") == "Critical", "ERROR").otherwise("WARN")
    plural = F.when(F.col("n") == 1, "").otherwise("s")
    return _shape(
        groups.select(
            "log_id",
            "severity",
            F.col("first_ns").alias("at_ns"),
            F.lit("LogPattern").alias("kind"),
            F.format_string(PATTERN_TEXT, label, F.col("module"), F.col("n"), plural, F.col("sample_body")).alias(
                "description"
            ),
            "module",
            F.col("n").alias("count"),
            (-F.col("n")).alias("tie"),
        )
    )


def standstill_alerts(firings: DataFrame) -> DataFrame:
    return _shape(
        firings.select(
            "log_id",
            F.lit("Warn").alias("severity"),
            F.col("first_ns").alias("at_ns"),
            F.lit("StandstillObserved").alias("kind"),
            F.format_string(STANDSTILL_TEXT, "slot").alias("description"),
            F.col("firings").alias("count"),
            F.col("slot").alias("at_slot"),
            "last_ns",
            F.col("seq").alias("tie"),
        )
    )


def inline_alerts(parsed: DataFrame) -> DataFrame:
    """Identity changes and service shutdowns, one alert per event."""
    identity = F.col("kind") == "SetIdentity"
    return _shape(
        parsed.where(F.col("kind").isin("SetIdentity", "ClusterSlotsStopped")).select(
            "log_id",
            F.lit("Info").alias("severity"),
            F.col("ts_ns").alias("at_ns"),
            F.when(identity, "IdentityChanged").otherwise("ClusterSlotsShutdownObserved").alias("kind"),
            F.when(identity, IDENTITY_TEXT).otherwise(SHUTDOWN_TEXT).alias("description"),
            F.lit(1).cast("bigint").alias("count"),
            F.col("seq").alias("tie"),
        )
    )


def leader_windows(parsed: DataFrame) -> DataFrame:
    """The accepted leader windows in arrival order, one row per event."""
    return parsed.where((F.col("kind") == "ProduceWindow") & valid_leader_window()).select(
        "log_id", "seq", "ts_ns", F.col("slot").alias("start_slot"), F.col("slot_end").alias("end_slot")
    )


def leader_summary(parsed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Accepted windows, unique leader slots and the first window's time.

    ``outcomes`` is the per-log table of slot counts. Logs without a window have no row.
    """
    windows = (
        leader_windows(parsed)
        .groupBy("log_id")
        .agg(F.count(F.lit(1)).alias("window_count"), F.min_by("ts_ns", "seq").alias("first_ns"))
    )
    return windows.join(outcomes.select("log_id", F.col("leader_slots").alias("slot_count")), "log_id", "left").select(
        "log_id", "window_count", F.coalesce("slot_count", F.lit(0)).alias("slot_count"), "first_ns"
    )


def leader_alerts(summary: DataFrame) -> DataFrame:
    return _shape(
        summary.select(
            "log_id",
            F.lit("Info").alias("severity"),
            F.col("first_ns").alias("at_ns"),
            F.lit("LocalLeaderSummary").alias("kind"),
            F.format_string(LEADER_TEXT, "slot_count", "window_count").alias("description"),
            F.col("slot_count").alias("count"),
            "slot_count",
            "window_count",
            F.lit(0).cast("bigint").alias("tie"),
        )
    )


def _kind_rank() -> Column:
    out = F.when(F.col("kind") == ALERT_KINDS[0], 0)
    for i, kind in enumerate(ALERT_KINDS[1:], 1):
        out = out.when(F.col("kind") == kind, i)
    return out


def order_alerts(union: DataFrame) -> DataFrame:
    """``alert_rank`` per log: severity down, then time, kind, and insertion order."""
    at, tie = F.col("at_ns"), F.col("tie")
    return rank_within(
        union.withColumn("_sev", -severity_rank(F.col("severity"))).withColumn("_kind", _kind_rank()),
        ["log_id"],
        # About a minute per first-level range; equal times are split by arrival.
        levels=[
            [F.col("_sev"), F.shiftright(at, 36)],
            [at, F.col("_kind"), F.shiftright(tie, 16)],
        ],
        leaf=[tie, F.coalesce("module", F.lit(""))],
        alias="alert_rank",
    ).select("log_id", "alert_rank", *_COLUMNS[1:-1])


def order_log_patterns(groups: DataFrame) -> DataFrame:
    """Groups with their ``place``: severity and count down, then module and time."""
    return rank_within(
        groups,
        ["log_id"],
        [[-severity_rank(F.col("severity")), -F.col("n")]],
        [F.col("module"), F.col("first_ns")],
        "place",
    )


def alerts(
    groups: DataFrame, firings: DataFrame, parsed: DataFrame, summary: DataFrame
) -> DataFrame:
    union = (
        pattern_alerts(groups)
        .unionByName(standstill_alerts(firings))
        .unionByName(inline_alerts(parsed))
        .unionByName(leader_alerts(summary))
    )
    return order_alerts(union)


def alert_detail(alert_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One detail record per alert, with span and rate for patterns and standstills.

    ``rate_per_min`` is NULL for a burst that lasts under a second.
    """
    found = issue_group_lookup(
        alert_rows.withColumnRenamed("last_ns", "_standstill_last"),
        groups.select("log_id", "severity", "module", "first_ns", "last_ns", "sample_body"),
    )
    merged = F.col("kind").isin("LogPattern", "StandstillObserved")
    first = F.when(merged, F.coalesce("first_ns", "at_ns"))
    last = F.coalesce("last_ns", "_standstill_last")
    span = F.greatest(div(last - first, 1_000_000_000), F.lit(0).cast("bigint"))
    short = F.col("kind")
    for kind, name in SHORT_NAMES.items():
        short = F.when(F.col("kind") == kind, name).otherwise(short)
    # A pattern's description repeats severity, module and count before the sample.
    body = F.when(
        F.col("kind") == "LogPattern",
        F.substring("description", F.instr("description", ": ") + 2, 2**31 - 1),
    ).otherwise(F.col("description"))
    preview = F.when(F.octet_length("_body") <= PREVIEW_MAX_BYTES, F.col("_body")).otherwise(
        F.concat(truncate_utf8(F.col("_body"), PREVIEW_MAX_BYTES), F.lit("…"))
    )
    return (
        found.withColumn("_body", body)
        .withColumn("_span", F.when(last.isNotNull(), span))
        .select(
            "log_id",
            "alert_rank",
            "severity",
            "kind",
            "at_ns",
            F.when(F.col("kind") == "LogPattern", F.substring_index("module", "::", -1))
            .otherwise(short)
            .alias("module_short"),
            "module",
            "count",
            first.alias("first_ns"),
            last.alias("last_ns"),
            F.col("_span").alias("span_secs"),
            humanize_full(F.col("_span")).alias("span_label"),
            F.when(F.col("_span") > 0, F.round(F.col("count") * 60.0 / F.col("_span"), 6)).alias("rate_per_min"),
            "sample_body",
            "at_slot",
            "slot_count",
            "window_count",
            preview.alias("preview"),
            "description",
        )
    )


def alert_rollup(alert_rows: DataFrame) -> DataFrame:
    sev = F.col("severity")
    return alert_rows.groupBy("log_id").agg(
        F.count_if(sev == "Critical").alias("critical"),
        F.count_if(sev == "Warn").alias("warn"),
        F.count_if(sev == "Info").alias("info"),
        F.count(F.lit(1)).alias("total"),
    )


def actionable_alerts(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.where(F.col("severity") != "Info")
