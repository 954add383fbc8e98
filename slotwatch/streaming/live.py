"""Standstill periods and grouped issues kept up to date from a stream of lines.

A micro-batch writes what it adds, as rows that combine in any order: the counts, the first
and the last arrival of every group, all ends of standstill periods, and the
extensions that may still open one. Nothing depends on which batch a line comes in,
so a line that arrives after later ones is placed by its position. A retried batch overwrites
its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwatch.operators.issues import GROUP, MAX_GROUP_TIMESTAMPS, issue_events
from slotwatch.operators.parse import parse_lines
from slotwatch.operators.sizing import join_small
from slotwatch.operators.slots import SLOT_KINDS, valid_leader_window
from slotwatch.operators.standstill import open_and_closed
from slotwatch.streaming.jobs import compact_parts, read_parts

FIRING, CLOSED, EXTENDING, TOP = "firing", "closed", "extending", "top"
STANDSTILL_KEY = ("log_id", "part", "at")
ARRIVALS = ("n", "first_seq", "first_ns", "last_seq", "last_ns")


def _arrivals() -> list[Column]:
    """Count, first and last arrival of a group of lines; numbers alone, so they hash."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("first_seq"),
        F.min_by("ts_ns", "seq").alias("first_ns"),
        F.max("seq").alias("last_seq"),
        F.max_by("ts_ns", "seq").alias("last_ns"),
    ]


def _combined() -> list[Column]:
    """The same of groups that were counted apart."""
    return [
        F.sum("n").alias("n"),
        F.min("first_seq").alias("first_seq"),
        F.min_by("first_ns", "first_seq").alias("first_ns"),
        F.max("last_seq").alias("last_seq"),
        F.max_by("last_ns", "last_seq").alias("last_ns"),
    ]


def _run(lines: DataFrame, out: str, checkpoint: str, parts: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    def save(batch: DataFrame, batch_id: int) -> None:
        parts(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        parse_lines(lines)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- standstill -----------------------------------------------------------------------
def standstill_parts(parsed: DataFrame) -> DataFrame:
    """``[log_id, part, at, slot, slot_end, *arrivals]`` from one pass over parsed lines.

    A firing is kept per anchor slot, an end and an extension per line (both are rare), and the
    highest slot of any slot record per log.
    """
    kind = F.col("kind")
    window = (kind == "ProduceWindow") & valid_leader_window()
    part = (
        F.when(kind == "Standstill", FIRING)
        .when(kind == "StandstillEnded", CLOSED)
        .when(kind == "StandstillExtending", EXTENDING)
        .when(kind.isin(*SLOT_KINDS) | window, TOP)
    )
    at = F.when(F.col("part") == FIRING, F.col("slot")).when(F.col("part") != TOP, F.col("seq")).otherwise(F.lit(0))
    rows = parsed.where("outcome = 'event'").withColumn("part", part).where("part is not null")
    top = F.when(F.col("part") == TOP, F.coalesce(F.when(window, F.col("slot_end")), F.col("slot"))).otherwise(F.col("slot"))
    return (
        rows.groupBy("log_id", "part", at.cast("bigint").alias("at"))
        .agg(F.max(top).alias("slot"), F.max("slot_end").alias("slot_end"), *_arrivals())
    )


def merge_standstill(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*STANDSTILL_KEY).agg(F.max("slot").alias("slot"), F.max("slot_end").alias("slot_end"), *_combined())


def _settled(parts: DataFrame) -> DataFrame:
    """Merged, without the extensions before the last known end: no line to come can make them open a period."""
    merged = merge_standstill(parts)
    ended = merged.where(F.col("part") == CLOSED).groupBy("log_id").agg(F.max("at").alias("_ended"))
    late = (F.col("part") != EXTENDING) | F.col("_ended").isNull() | (F.col("at") > F.col("_ended"))
    return join_small(merged, ended, ["log_id"], "left").where(late).drop("_ended")


def stream_standstill(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep firings, ended periods and the open period of every log up to date."""
    return _run(lines, out, checkpoint, standstill_parts)


def read_standstill_alerts(spark: SparkSession, out: str) -> DataFrame:
    """As :func:`standstill_firings` of the lines so far."""
    firings = merge_standstill(read_parts(spark, out).where(F.col("part") == FIRING))
    return firings.select("log_id", "slot", F.col("n").alias("firings"), "first_ns", "last_ns", F.col("first_seq").alias("seq"))


def read_standstill_ranges(spark: SparkSession, out: str) -> DataFrame:
    """As :func:`standstill_ranges` of the lines so far; the open period ends at the highest slot seen."""
    parts = read_parts(spark, out)
    of = lambda part: merge_standstill(parts.where(F.col("part") == part))
    closed = of(CLOSED).select("log_id", F.col("slot").alias("entry_slot"), F.col("slot_end").alias("exit_slot"), F.col("at").alias("seq"))
    extending = of(EXTENDING).select("log_id", F.col("at").alias("seq"), "slot")
    return open_and_closed(closed, extending, of(TOP).select("log_id", F.col("slot").alias("_top")))


def compact_standstill(spark: SparkSession, out: str) -> None:
    compact_parts(spark, out, _settled)


# --- issues ---------------------------------------------------------------------------
def issue_parts(parsed: DataFrame) -> DataFrame:
    """``[log_id, severity, module, *arrivals, sample_body]``: the groups of one batch, the sample by arrival."""
    return issue_events(parsed).groupBy(*GROUP).agg(*_arrivals(), F.min_by("body", "seq").alias("sample_body"))


def merge_issues(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*GROUP).agg(*_combined(), F.min_by("sample_body", "first_seq").alias("sample_body"))


def stream_issues(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the groups of warnings and errors of every log up to date."""
    return _run(lines, out, checkpoint, issue_parts)


def read_issues(spark: SparkSession, out: str, cap: int = MAX_GROUP_TIMESTAMPS) -> DataFrame:
    """As :func:`log_issue_groups` of the lines so far."""
    dropped = F.greatest(F.col("n") - F.lit(cap), F.lit(0).cast("bigint"))
    return merge_issues(read_parts(spark, out)).select(
        *GROUP, "n", "first_ns", "last_ns", "sample_body", dropped.alias("timestamps_dropped")
    )


def compact_issues(spark: SparkSession, out: str) -> None:
    compact_parts(spark, out, merge_issues)
