"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

LINES = T.StructType(
    [
        T.StructField("log_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("line", T.StringType(), True),
    ]
)

PARSED = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("level", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("slot", T.LongType()),
        T.StructField("slot_end", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("parent_slot", T.LongType()),
        T.StructField("parent_hash", T.StringType()),
        T.StructField("fast", T.BooleanType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("body", T.StringType()),
    ]
)

# Timestamp columns of a slot record, each the first arrival of one event kind.
SLOT_TIMESTAMPS = {
    "first_shred_ns": "FirstShred",
    "block_emitted_ns": "Block",
    "voted_notarize_ns": "VotingNotarize",
    "block_notarized_ns": "BlockNotarized",
    "voted_finalize_ns": "VotingFinalize",
    "notar_fallback_ns": "BlockNotarFallback",
    "finalized_ns": "Finalized",
    "setting_root_ns": "SettingRoot",
    "new_root_ns": "NewRoot",
    "timeout_ns": "Timeout",
    "timeout_crashed_leader_ns": "TimeoutCrashedLeader",
    "voted_skip_ns": "VotingSkip",
    "safe_to_notar_ns": "SafeToNotar",
    "safe_to_skip_ns": "SafeToSkip",
}

SLOTS = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("slot", T.LongType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("parent_slot", T.LongType()),
        T.StructField("parent_hash", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in SLOT_TIMESTAMPS],
        T.StructField("fast_finalize", T.BooleanType()),
        T.StructField("signature_count", T.LongType()),
        T.StructField("we_are_leader", T.BooleanType()),
    ]
)

LOG_META = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("line_count", T.LongType()),
        T.StructField("lo_ns", T.LongType()),
        T.StructField("hi_ns", T.LongType()),
    ]
)
