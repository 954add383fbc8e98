"""Line in, typed row out."""

from __future__ import annotations

import re

import pytest
from conftest import HASH, HASH2, SF, other, votor
from pyspark.sql import functions as F

from slotwatch.operators import parse as P
from slotwatch.operators import slots as S
from slotwatch.sources.fixture_log import fixture_log

TS = "2026-05-01T00:00:00.000000000Z"
CLUSTER = P.CLUSTER_SLOTS_MODULE

# name -> (line, expected subset of the parsed row)
CASES = {
    "info_two_spaces": (other("app::x", "hello"), {"outcome": "ignored"}),
    "error_one_space": (
        "[2026-05-01T10:11:12.123456789Z ERROR app::x] bad thing",
        {"outcome": "issue", "level": "ERROR", "module": "app::x", "body": "bad thing", "ts_ns": 1777630272123456789},
    ),
    "offset": ("[2026-05-01T12:11:12.5+02:00 WARN app::x] b", {"outcome": "issue", "ts_ns": 1777630272500000000}),
    "negative_offset": ("[2026-05-01T09:41:12-00:30 WARN app::x] b", {"outcome": "issue", "ts_ns": 1777630272000000000}),
    "lowercase": ("[2026-05-01t10:11:12.25z WARN app::x] b", {"outcome": "issue", "ts_ns": 1777630272250000000}),
    "ten_digits": ("[2026-05-01T10:11:12.1234567891Z WARN app::x] b", {"outcome": "issue", "ts_ns": 1777630272123456789}),
    "continuation": ("    1: 2,", {"outcome": "continuation"}),
    "empty": ("", {"outcome": "continuation"}),
    "panic_banner": ("[ panic ]", {"outcome": "continuation"}),
    "broken_bracket": ("[broken", {"outcome": "continuation"}),
    "bom": ("﻿" + other("app::x", "b"), {"outcome": "continuation"}),
    "bad_month": ("[2026-13-01T00:00:00Z WARN a] b", {"outcome": "parse_error"}),
    "leap_second": ("[2026-06-30T23:59:60Z WARN a] b", {"outcome": "parse_error"}),
    "no_offset": ("[2026-05-01T00:00:00 WARN a] b", {"outcome": "parse_error"}),
    "unknown_level": (f"[{TS} LOUD  a] b", {"outcome": "parse_error"}),
    "no_close": (f"[{TS} INFO  a b", {"outcome": "parse_error"}),
    "close_without_space": (f"[{TS} INFO  a]", {"outcome": "parse_error"}),
    "no_space": (f"[{TS}", {"outcome": "parse_error"}),
    "spaces_before_module": (f"[{TS} WARN     a::b] x", {"outcome": "issue", "module": "a::b"}),
    "bracket_in_body": (f"[{TS} WARN  a::b] x] y", {"outcome": "issue", "body": "x] y"}),
    "debug_ignored": (f"[{TS} DEBUG a::b] x", {"outcome": "ignored"}),
    "metrics_info": (other("solana_metrics::metrics", "datapoint: x"), {"outcome": "ignored"}),
    "metrics_warn": (other("solana_metrics::metrics", "datapoint: x", level="WARN"), {"outcome": "issue"}),
    # events
    "block": (
        votor(f"Block (7, {HASH}) parent (6, {HASH2})"),
        {"outcome": "event", "kind": "Block", "slot": 7, "hash": HASH, "parent_slot": 6, "parent_hash": HASH2},
    ),
    "block_trailing": (votor(f"Block (7, {HASH}) parent (6, {HASH2}) x"), {"outcome": "ignored"}),
    "block_plus": (votor(f"Block (+7, {HASH}) parent (6, {HASH2})"), {"outcome": "ignored"}),
    "block_21_digits": (votor(f"Block ({'0' * 20}7, {HASH}) parent (6, {HASH2})"), {"outcome": "ignored"}),
    "notarized": (votor(f"Block Notarized (8, {HASH})"), {"kind": "BlockNotarized", "slot": 8, "hash": HASH}),
    "notarized_tail_blank": (votor(f"Block Notarized (8, {HASH}) \t"), {"kind": "BlockNotarized"}),
    "notarized_tail_text": (votor(f"Block Notarized (8, {HASH}) (forced)"), {"outcome": "ignored"}),
    "notarized_tail_nbsp": (votor(f"Block Notarized (8, {HASH}) "), {"outcome": "ignored"}),
    "notarized_many_zeros": (votor(f"Block Notarized ({'0' * 30}8, {HASH})"), {"kind": "BlockNotarized", "slot": 8}),
    "fallback": (votor(f"Block notar-fallback (9, {HASH})"), {"kind": "BlockNotarFallback", "slot": 9, "hash": HASH}),
    "vote_notarize": (votor(f"Voting notarize for 10 {HASH}"), {"kind": "VotingNotarize", "slot": 10, "hash": HASH}),
    "vote_notarize_forced": (votor(f"Voting notarize for 10 {HASH} (forced)"), {"outcome": "ignored"}),
    "vote_notarize_short_hash": (votor("Voting notarize for 10 " + HASH[:31]), {"outcome": "ignored"}),
    "hash_32": (votor("Voting notarize for 10 " + HASH[:32]), {"kind": "VotingNotarize", "hash": HASH[:32]}),
    "hash_48": (votor("Voting notarize for 10 " + "A" * 48), {"kind": "VotingNotarize", "hash": "A" * 48}),
    "hash_49": (votor("Voting notarize for 10 " + "A" * 49), {"outcome": "ignored"}),
    "hash_bad_letter": (votor("Voting notarize for 10 " + HASH[:40] + "0"), {"outcome": "ignored"}),
    "vote_finalize": (votor("Voting finalize for 11"), {"kind": "VotingFinalize", "slot": 11}),
    "vote_finalize_plus": (votor("Voting finalize for +11"), {"kind": "VotingFinalize", "slot": 11}),
    "vote_finalize_space": (votor("Voting finalize for 11 "), {"outcome": "ignored"}),
    "vote_finalize_newlineish": (votor("Voting finalize for 11\r"), {"outcome": "ignored"}),
    "vote_skip": (votor("Voting skip for 12"), {"kind": "VotingSkip", "slot": 12}),
    "vote_other": (votor("Voting maybe for 12"), {"outcome": "ignored"}),
    "first_shred": (votor("First shred 13"), {"kind": "FirstShred", "slot": 13}),
    "slot_max_bigint": (votor("First shred 9223372036854775807"), {"kind": "FirstShred", "slot": 9223372036854775807}),
    # Deviation: slots above 2^63-1 are rejected although the format has unsigned 64 bits.
    "slot_above_bigint": (votor("First shred 9223372036854775808"), {"outcome": "ignored"}),
    "slot_above_u64": (votor("First shred 18446744073709551616", level="WARN"), {"outcome": "issue"}),
    "slot_negative": (votor("First shred -1"), {"outcome": "ignored"}),
    "timeout": (votor("Timeout 14"), {"kind": "Timeout", "slot": 14}),
    "tcl": (votor("TimeoutCrashedLeader 15"), {"kind": "TimeoutCrashedLeader", "slot": 15}),
    "safe_to_notar": (votor(f"SafeToNotar (16, {HASH})"), {"kind": "SafeToNotar", "slot": 16, "hash": HASH}),
    "safe_to_skip": (votor("SafeToSkip 17"), {"kind": "SafeToSkip", "slot": 17}),
    "produce_window": (
        votor(f"ProduceWindow LeaderWindowInfo {{ start_slot: 20, end_slot: 23, parent_block: (19, {HASH}), skip: x }}"),
        {"kind": "ProduceWindow", "slot": 20, "slot_end": 23, "parent_slot": 19, "parent_hash": HASH},
    ),
    "finalized_fast": (votor(f"Finalized (18, {HASH}) fast: true"), {"kind": "Finalized", "slot": 18, "fast": True}),
    "finalized_slow": (votor(f"Finalized (18, {HASH}) fast: false"), {"kind": "Finalized", "fast": False, "hash": HASH}),
    "finalized_maybe": (votor(f"Finalized (18, {HASH}) fast: maybe"), {"outcome": "ignored"}),
    "standstill": (votor("Standstill 30"), {"kind": "Standstill", "slot": 30}),
    "standstill_ended": (
        votor("Standstill initially detected at slot=30 has ended at slot=40. Ending timeout extension"),
        {"kind": "StandstillEnded", "slot": 30, "slot_end": 40},
    ),
    "extending": (votor("Extending timeouts starting at slot 31"), {"kind": "StandstillExtending", "slot": 31}),
    "set_identity": (votor("SetIdentity anything"), {"kind": "SetIdentity", "slot": None}),
    "set_identity_glued": (votor("SetIdentityX"), {"outcome": "ignored"}),
    "refreshing": (votor("Refreshing vote Vote { x }"), {"kind": "RefreshingVote"}),
    "refreshing_other": (votor("Refreshing cache"), {"outcome": "ignored"}),
    "parent_ready": (
        votor(f"Triggering parent ready for slot 33 with parent 32 {HASH}"),
        {"kind": "TriggeringParentReady", "slot": 33, "parent_slot": 32, "parent_hash": HASH},
    ),
    "no_pubkey": (f"[{TS} INFO  agave_votor::event_handler] First shred 13", {"outcome": "ignored"}),
    "votor_warn_miss": (votor("Something odd", level="WARN"), {"outcome": "issue", "body": "NodeKey: Something odd"}),
    "setting_root": (other(P.ROOT_MODULE, "K: setting root 40"), {"kind": "SettingRoot", "slot": 40}),
    "new_root": (other(P.ROOT_MODULE, "K: new root 41"), {"kind": "NewRoot", "slot": 41}),
    "bank_frozen": (
        other(P.BANK_MODULE, f"bank frozen: 42 hash: {HASH} signature_count: 99 last_blockhash: y"),
        {"kind": "BankFrozen", "slot": 42, "hash": HASH, "n": 99},
    ),
    "bank_other": (other(P.BANK_MODULE, "bank thawed"), {"outcome": "ignored"}),
    "no_epoch_metadata": (other(CLUSTER, "No epoch_metadata record for epoch 5", level="ERROR"), {"kind": "NoEpochMetadata", "epoch": 5, "slot": None}),
    "no_epoch_info": (other(CLUSTER, "No epoch info for slot 6"), {"kind": "NoEpochInfoForSlot", "slot": 6}),
    "updating_parent_module": (
        other(P.CLUSTER_SLOTS_PARENT_MODULE, "Updating epoch_metadata for epoch 7"),
        {"kind": "UpdatingEpochMetadata", "epoch": 7},
    ),
    "evicting": (other(CLUSTER, "Evicting epoch_metadata for epoch 8"), {"kind": "EvictingEpochMetadata", "epoch": 8}),
    "invalid_update": (other(CLUSTER, "Invalid update call to ClusterSlots, x"), {"kind": "InvalidClusterSlotsUpdate"}),
    "stopped": (
        other(CLUSTER, "ClusterSlotsService has stopped because we have finished the alpenglow migration epoch 3"),
        {"kind": "ClusterSlotsStopped"},
    ),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(name, i, line) for i, (name, (line, _)) in enumerate(CASES.items())]
    lines = spark.createDataFrame(rows, "log_id string, seq bigint, line string")
    return {r["log_id"]: r.asDict() for r in P.parse_lines(lines).collect()}


@pytest.mark.parametrize("name", CASES)
def test_line(parsed, name):
    want = CASES[name][1]
    got = parsed[name]
    if "kind" in want:
        assert got["outcome"] == "event"
    assert {k: got[k] for k in want} == want
    if got["outcome"] != "event":
        assert got["kind"] is None and got["slot"] is None


def test_every_kind_has_a_case(parsed):
    assert {r["kind"] for r in parsed.values() if r["kind"]} == set(P.EVENT_KINDS)


def test_invalid_utf8_is_a_parse_error(spark):
    raw = spark.createDataFrame([("a", 0, bytearray(b"[2\xff"))], "log_id string, seq bigint, raw binary")
    lines = raw.select("log_id", "seq", F.col("raw").cast("string").alias("line"))
    assert P.parse_lines(lines).first()["outcome"] == "parse_error"


def test_parse_has_no_shuffle_and_filters_stay_above(spark, sample_lines):
    events = P.parse_events(P.parse_lines(sample_lines))
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    # A filter rewritten into the raw line would repeat the parser many times over.
    assert len(events._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_outcomes_add_up(sample_lines):
    counts = P.ingest_counts(P.parse_lines(sample_lines)).withColumn(
        "total", F.col("continuation_lines") + F.col("ignored_lines") + F.col("parse_errors") + F.col("ingested")
    )
    assert counts.where("total <> lines").count() == 0
    assert counts.agg(F.sum("lines")).first()[0] == sample_lines.count()


def test_words_decide_only_in_their_module(make_lines):
    """One pattern holds the words of all modules; a kind counts only where its own module logs it."""
    lines = {
        votor("Refreshing vote \t\t\t\t\t"): "RefreshingVote",
        votor("SetIdentity"): "SetIdentity",
        votor("SetIdentity\tx"): None,
        votor("First shred 13 (forced)"): None,
        votor("First shred (13, " + HASH + ")"): None,
        votor("setting root 13"): None,
        other(P.ROOT_MODULE, "K: First shred 13"): None,
        other(P.BANK_MODULE, "First shred 13"): None,
        other(P.BANK_MODULE, "No epoch info for slot 6"): None,
        other(CLUSTER, f"bank frozen: 42 hash: {HASH} signature_count: 99"): None,
        other(P.CLUSTER_SLOTS_PARENT_MODULE, "No epoch info for slot 6"): "NoEpochInfoForSlot",
        votor(f"Block (7, {HASH}) parent (9223372036854775808, {HASH2})"): None,
        other(P.BANK_MODULE, f"bank frozen: 42 hash: {HASH} signature_count: 9223372036854775808 x"): None,
    }
    got = P.parse_lines(make_lines(list(lines))).orderBy("seq").collect()
    assert [r["kind"] for r in got] == list(lines.values())


def test_parser_is_compiled_as_a_whole(spark, capsys):
    """The JVM compiles no method above 8000 bytes, and Spark then runs each projection on its own, which copies
    every row, texts included, as often as there are projections."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        P.parse_lines(fixture_log(spark, SF)).withColumn("class", S.line_class()).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stages = [s for s in capsys.readouterr().out.split("== Subtree ") if "inline(array(struct(outcome" in s]
    sizes = [int(re.search(r"maxMethodCodeSize:(\d+)", s)[1]) for s in stages]
    assert sizes and max(sizes) < 8000
