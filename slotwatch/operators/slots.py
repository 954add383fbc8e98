"""Events folded into one record per (log, slot): first arrival wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.schemas import SLOT_TIMESTAMPS, SLOTS

MAX_LEADER_WINDOW_SPAN = 16  # fixed value: wider leader windows are damaged lines

HASH_KINDS = (
    "Block",
    "VotingNotarize",
    "BlockNotarized",
    "BlockNotarFallback",
    "Finalized",
    "SafeToNotar",
)
SLOT_KINDS = (*SLOT_TIMESTAMPS.values(), "BankFrozen")


def valid_leader_window() -> Column:
    span = F.col("slot_end") - F.col("slot")
    return (span >= 0) & (span <= MAX_LEADER_WINDOW_SPAN)


def leader_slots(parsed: DataFrame) -> DataFrame:
    """Every slot of every accepted leader window (at most 17 rows per event)."""
    return parsed.where((F.col("kind") == "ProduceWindow") & valid_leader_window()).select(
        "log_id", "seq", F.explode(F.sequence("slot", "slot_end")).alias("slot")
    )


def line_class() -> Column:
    """Where a parsed line is stored: slot (events of a slot record), rare (all other events,
    leader windows among them), issue, or rest."""
    outcome = F.col("outcome")
    return (
        F.when((outcome == "event") & F.col("kind").isin(*SLOT_KINDS), "slot")
        .when(outcome == "event", "rare")
        .when(outcome == "issue", "issue")
        .otherwise("rest")
    )


# Each field of the record: the value and the events it may come from.
def _fields() -> list[tuple[str, Column, Column]]:
    kind = F.col("kind")
    out = [
        ("block_id", F.col("hash"), kind.isin(*HASH_KINDS)),
        ("parent_slot", F.col("parent_slot"), kind == "Block"),
        ("parent_hash", F.col("parent_hash"), kind == "Block"),
    ]
    out += [(name, F.col("ts_ns"), kind == k) for name, k in SLOT_TIMESTAMPS.items()]
    out += [
        ("fast_finalize", F.col("fast"), kind == "Finalized"),
        ("signature_count", F.col("n"), kind == "BankFrozen"),
    ]
    return out


def slot_input(parsed: DataFrame) -> DataFrame:
    """The rows that touch a slot record, leader windows expanded to their slots."""
    window = F.col("kind") == "ProduceWindow"
    # One generator for both: other events name one slot, a leader window names several.
    targets = F.when(window, F.sequence("slot", "slot_end")).otherwise(F.array("slot"))
    return (
        parsed.where(F.col("kind").isin(*SLOT_KINDS) | (window & valid_leader_window()))
        .withColumn("slot", F.explode(targets))
        .select("log_id", "slot", "seq", "ts_ns", "kind", "hash", "parent_slot", "parent_hash", "fast", "n")
    )


def fold_slots(rows: DataFrame, keep_seq: bool = False) -> DataFrame:
    """One row per (log, slot). With ``keep_seq`` each field also keeps its arrival
    position in ``<field>_seq``, which makes partial results mergeable."""
    aggs = []
    for name, value, test in _fields():
        seq = F.when(test, F.col("seq"))
        aggs.append(F.min_by(value, seq).alias(name))
        if keep_seq:
            aggs.append(F.min(seq).alias(f"{name}_seq"))
    leader = F.bool_or(F.col("kind") == "ProduceWindow").alias("we_are_leader")
    return rows.groupBy("log_id", "slot").agg(*aggs, leader)


def merge_slots(parts: DataFrame) -> DataFrame:
    """Combine partial records made with ``keep_seq``; associative and idempotent."""
    aggs = []
    for name, _, _ in _fields():
        aggs.append(F.min_by(name, f"{name}_seq").alias(name))
        aggs.append(F.min(f"{name}_seq").alias(f"{name}_seq"))
    return parts.groupBy("log_id", "slot").agg(*aggs, F.bool_or("we_are_leader").alias("we_are_leader"))


def slot_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name) for f in SLOTS.fields])


def build_slots(parsed: DataFrame) -> DataFrame:
    """The slot table (without skip classes, see :mod:`slotwatch.operators.ancestry`)."""
    return slot_columns(fold_slots(slot_input(parsed)))


# Counters of the whole log: name and the event kind it counts.
EVENT_COUNTERS = {
    "votes_notarize": "VotingNotarize",
    "votes_finalize": "VotingFinalize",
    "votes_skip": "VotingSkip",
    "block_notarized": "BlockNotarized",
    "block_notar_fallback": "BlockNotarFallback",
    "setting_root": "SettingRoot",
    "new_root": "NewRoot",
    "first_shreds": "FirstShred",
    "timeouts": "Timeout",
    "timeout_crashed_leaders": "TimeoutCrashedLeader",
    "safe_to_notar": "SafeToNotar",
    "safe_to_skip": "SafeToSkip",
    "standstill_events": "Standstill",
    "standstill_extending": "StandstillExtending",
    "standstill_ended": "StandstillEnded",
    "refreshing_votes": "RefreshingVote",
    "parent_ready_recoveries": "TriggeringParentReady",
    "bank_frozen": "BankFrozen",
    "no_epoch_metadata": "NoEpochMetadata",
    "no_epoch_info_for_slot": "NoEpochInfoForSlot",
    "updating_epoch_metadata": "UpdatingEpochMetadata",
    "evicting_epoch_metadata": "EvictingEpochMetadata",
    "invalid_cluster_slots_update": "InvalidClusterSlotsUpdate",
}


def counter_aggregates() -> list[Column]:
    """Event counters of a log; all zero without any event."""
    kind = F.col("kind")
    window = kind == "ProduceWindow"
    return [
        *[F.count_if(kind == k).alias(name) for name, k in EVENT_COUNTERS.items()],
        F.count_if((kind == "Finalized") & F.col("fast")).alias("finalized_fast"),
        F.count_if((kind == "Finalized") & ~F.col("fast")).alias("finalized_slow"),
        F.count_if(window & valid_leader_window()).alias("produce_windows"),
        F.count_if(window & ~valid_leader_window()).alias("malformed_produce_window"),
        F.coalesce(F.bool_or(kind == "ClusterSlotsStopped"), F.lit(False)).alias(
            "cluster_slots_service_stopped"
        ),
    ]


def overall_counters(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("log_id").agg(*counter_aggregates())


def slot_outcomes(slots: DataFrame) -> DataFrame:
    """Unique slots per outcome; canonical skips count as finalized and as skipped."""
    finalized = F.col("finalized_ns").isNotNull()
    skipped = F.col("voted_skip_ns").isNotNull()
    cls = F.col("skip_classification")
    return slots.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("distinct_slots"),
        F.min("slot").alias("min_slot"),
        F.max("slot").alias("max_slot"),
        F.count_if(finalized).alias("finalized_slots"),
        F.count_if(skipped).alias("skipped_slots"),
        F.count_if(~finalized & ~skipped).alias("pending_slots"),
        F.count_if(cls == "canonical_direct").alias("canonical_direct"),
        F.count_if(cls == "canonical_ancestry").alias("canonical_ancestry"),
        F.count_if(cls == "indeterminate").alias("indeterminate"),
        F.count_if(F.col("we_are_leader")).alias("leader_slots"),
        F.count_if(F.col("timeout_crashed_leader_ns").isNotNull()).alias("tcl_slots"),
        # Fallback certificates without a notarization, counted per slot.
        F.count_if(F.col("notar_fallback_ns").isNotNull() & F.col("block_notarized_ns").isNull()).alias(
            "fallback_only_slots"
        ),
    )


def skip_counts(slots: DataFrame) -> DataFrame:
    return slot_outcomes(slots).select("log_id", "canonical_direct", "canonical_ancestry", "indeterminate")

