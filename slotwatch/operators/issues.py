"""Warnings and errors grouped by (severity, module), and event histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwatch.functions.text import issue_body
from slotwatch.operators.ordered import first_by
from slotwatch.operators.parse import CLUSTER_SLOTS_MODULE
from slotwatch.operators.sizing import join_small

MAX_GROUP_TIMESTAMPS = 1_000_000  # fixed value: timestamps kept per group

# --- fixed values: text of the grouped cluster-slots events -------------------------
NO_EPOCH_METADATA = "No epoch_metadata record for epoch %d"
NO_EPOCH_INFO = "No epoch info for slot %d"
INVALID_UPDATE = "Invalid update call to ClusterSlots, can not roll time backwards!"
# ------------------------------------------------------------------------------------

GROUP = ("log_id", "severity", "module")


def issue_events(parsed: DataFrame) -> DataFrame:
    """Every line that counts towards a group.

    Unparsed WARN/ERROR lines use their own level and module. Three kinds of
    cluster-slots events join them under a fixed module and severity.
    """
    kind = F.col("kind")
    structured = kind.isin("NoEpochMetadata", "NoEpochInfoForSlot", "InvalidClusterSlotsUpdate")
    severity = (
        F.when(kind.isin("NoEpochMetadata", "NoEpochInfoForSlot"), "Critical")
        .when(kind == "InvalidClusterSlotsUpdate", "Warn")
        .when(F.col("level") == "ERROR", "Critical")
        .otherwise("Warn")
    )
    body = (
        F.when(kind == "NoEpochMetadata", F.format_string(NO_EPOCH_METADATA, "epoch"))
        .when(kind == "NoEpochInfoForSlot", F.format_string(NO_EPOCH_INFO, "slot"))
        .when(structured, INVALID_UPDATE)
        .otherwise(issue_body(F.col("body")))
    )
    return parsed.where((F.col("outcome") == "issue") | structured).select(
        "log_id",
        "seq",
        "ts_ns",
        severity.alias("severity"),
        F.when(structured, CLUSTER_SLOTS_MODULE).otherwise(F.col("module")).alias("module"),
        body.alias("body"),
    )


def log_issue_groups(issues: DataFrame, cap: int = MAX_GROUP_TIMESTAMPS) -> DataFrame:
    """One row per (log, severity, module); first, last and sample by arrival.

    All aggregates are over numbers, so they hash and combine before the shuffle, and a
    module with most of the lines sends one row per task. The sample is then looked up
    by its arrival position.
    """
    n = F.count(F.lit(1))
    groups = issues.groupBy(*GROUP).agg(
        n.alias("n"),
        F.min_by("ts_ns", "seq").alias("first_ns"),
        F.max_by("ts_ns", "seq").alias("last_ns"),
        F.min("seq").alias("seq"),
        F.greatest(n - F.lit(cap), F.lit(0).cast("bigint")).alias("timestamps_dropped"),
    )
    bodies = issues.select(*GROUP, "seq", F.col("body").alias("sample_body"))
    found = join_small(bodies, groups, [*GROUP, "seq"])
    return found.select(*GROUP, "n", "first_ns", "last_ns", "sample_body", "timestamps_dropped")


def retained_timestamps(
    issues: DataFrame, groups: DataFrame, cap: int = MAX_GROUP_TIMESTAMPS
) -> DataFrame:
    """The timestamps a group keeps: its first ``cap`` by arrival.

    ``groups`` is the table of :func:`log_issue_groups`. Only groups above the cap are
    ranked; usually there are none, and then the rows pass without a shuffle.
    """
    rows = issues.select(*GROUP, "seq", "ts_ns")
    above = groups.where(F.col("n") > cap).select(*GROUP, F.lit(True).alias("_above"))
    if above.isEmpty():
        return rows
    marked = join_small(rows, above, list(GROUP), "left")
    within = marked.where(F.col("_above").isNull()).drop("_above")
    return within.unionByName(first_by(marked.where("_above").drop("_above"), GROUP, "seq", cap))


def issue_group_lookup(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Left join of rows with the group of their (log, severity, module)."""
    return rows.join(groups, list(GROUP), "left")


def event_histogram(
    rows: DataFrame, keys: Sequence[str], n: int, ts: str = "ts_ns", sized_by: DataFrame | None = None
) -> DataFrame:
    """``n`` equal bins between each group's first and last timestamp, empty ones too.

    ``sized_by`` is a stored table with a row per group, if there is one.
    """
    keys = list(keys)
    n = max(n, 1)
    span = rows.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    share = (F.col(ts) - F.col("_lo")).cast("double") / F.greatest(
        F.col("_hi") - F.col("_lo"), F.lit(1).cast("bigint")
    ).cast("double")
    counts = (
        join_small(rows, span, keys, sized_by=sized_by)
        .select(*keys, F.least((share * F.lit(float(n))).cast("bigint"), F.lit(n - 1)).alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    spine = span.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias("bin"))
    return spine.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", F.coalesce("_n", F.lit(0)).alias("n")
    )
