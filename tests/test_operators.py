"""Slot records, standstills, issues, alerts, latencies, gaps, windows and buckets."""

from __future__ import annotations

import random

import pytest
from conftest import HASH, HASH2, other, votor
from pyspark.sql import functions as F

from slotwatch.functions import classify as C
from slotwatch.operators import alerts as A
from slotwatch.operators import ancestry, buckets, gaps, issues, latency, ordered, parse, ranks, standstill
from slotwatch.operators import slots as S
from slotwatch.operators import view as V
from slotwatch.operators import windows as W

S_NS = 1_000_000_000


def rows(df, *cols, order=None):
    return [tuple(r) for r in df.select(*cols).orderBy(*(order or cols)).collect()]


def at(second: float) -> str:
    return f"2026-05-01T00:00:{second:012.9f}Z"


# --- slot records -----------------------------------------------------------------------
def test_lifecycle_of_one_slot(make_lines):
    lines = [
        votor("First shred 5", at(1)),
        votor(f"Block (5, {HASH}) parent (4, {HASH2})", at(1.4)),
        votor(f"Voting notarize for 5 {HASH}", at(1.5)),
        votor(f"Block Notarized (5, {HASH})", at(1.6)),
        votor("Voting finalize for 5", at(1.7)),
        votor(f"Finalized (5, {HASH}) fast: true", at(1.8)),
        other(parse.ROOT_MODULE, "K: setting root 5", at(1.9)),
        other(parse.ROOT_MODULE, "K: new root 5", at(2)),
        # Second arrivals do not change the record, whatever time they carry.
        votor("First shred 5", at(0.5)),
        votor(f"Finalized (5, {HASH2}) fast: false", at(9)),
        other(parse.BANK_MODULE, f"bank frozen: 5 hash: {HASH2} signature_count: 7", at(3)),
    ]
    parsed = parse.parse_lines(make_lines(lines)).cache()
    r = S.build_slots(parsed).first()
    assert (r.slot, r.block_id, r.parent_slot, r.parent_hash, r.fast_finalize) == (5, HASH, 4, HASH2, True)
    assert r.signature_count == 7 and not r.we_are_leader
    assert r.finalized_ns - r.first_shred_ns == 800_000_000
    o = S.overall_counters(parsed).first()
    assert (o.first_shreds, o.votes_notarize, o.finalized_fast, o.finalized_slow, o.new_root) == (2, 1, 1, 1, 1)


def test_leader_windows(make_lines):
    def window(a, b):
        return votor(f"ProduceWindow LeaderWindowInfo {{ start_slot: {a}, end_slot: {b}, parent_block: (1, {HASH}) }}")

    parsed = parse.parse_lines(make_lines([window(10, 13), window(20, 36), window(40, 57), window(60, 59)])).cache()
    slots = S.build_slots(parsed)
    assert [r[0] for r in rows(slots, "slot")] == [*range(10, 14), *range(20, 37)]
    assert slots.where(~F.col("we_are_leader")).count() == 0
    o = S.overall_counters(parsed).first()
    assert (o.produce_windows, o.malformed_produce_window) == (2, 2)


def test_merge_of_parts_equals_one_fold(sample_lines):
    whole = S.slot_input(parse.parse_lines(sample_lines)).cache()
    parts = [S.fold_slots(whole.where(F.pmod(F.hash("seq"), F.lit(3)) == i), keep_seq=True) for i in range(3)]
    merged = S.slot_columns(S.merge_slots(parts[2].unionByName(parts[0]).unionByName(parts[1])))
    direct = S.slot_columns(S.fold_slots(whole))
    assert merged.exceptAll(direct).count() == 0 and direct.exceptAll(merged).count() == 0


def test_partitioning_does_not_change_slots(sample_lines):
    direct = S.build_slots(parse.parse_lines(sample_lines))
    mixed = S.build_slots(parse.parse_lines(sample_lines.repartition(7, F.rand(3))))
    assert mixed.exceptAll(direct).count() == 0 and direct.exceptAll(mixed).count() == 0


def test_skip_classes_long_chain_and_cycle(make_slots):
    fin, skip = {"finalized_ns": 1}, {"voted_skip_ns": 1}
    chain = [{"slot": s, "parent_slot": s - 1} for s in range(5001, 5040)]
    table = make_slots(
        {"slot": 1000, **skip, **fin},
        {"slot": 2000, **skip},
        {"slot": 2001, "parent_slot": 2000, **fin},
        {"slot": 3000, **skip},
        {"slot": 4000, **fin},
        {"slot": 5000, **skip},
        *chain,
        {"slot": 5040, "parent_slot": 5039, **fin},
        # A parent cycle reached from a finalized slot.
        {"slot": 6000, "parent_slot": 6001, **skip},
        {"slot": 6001, "parent_slot": 6000},
        {"slot": 6002, "parent_slot": 6001, **fin},
        # A parent that has no record.
        {"slot": 7000, "parent_slot": 6999, **fin},
        # Another log does not matter.
        {"log_id": "b", "slot": 2000, **skip},
    ).drop("skip_classification")
    out = ancestry.classify_skips(table, ancestry.canonical_ancestors(table))
    got = {(r.log_id, r.slot): r.skip_classification for r in out.collect()}
    want = {1000: "canonical_direct", 2000: "canonical_ancestry", 3000: "indeterminate", 4000: "not_skipped",
            5000: "canonical_ancestry", 6000: "canonical_ancestry"}
    assert {s: got[("log", s)] for s in want} == want
    assert got[("b", 2000)] == "indeterminate"


@pytest.mark.parametrize("steps", [1, 4])
def test_ancestors_are_those_of_a_plain_walk(spark, monkeypatch, steps):
    """Random parents, cycles and missing ones among them, walked slot by slot."""
    monkeypatch.setattr(ancestry, "STEP_ROUNDS", steps)
    dice = random.Random(steps)
    final = {s: dice.random() < 0.03 for s in range(600)}
    parent = {s: dice.choice([None, s - 1, s - 1, s - 1, dice.randrange(650)]) for s in final}
    want = set()
    for s in final:
        at = parent[s] if final[s] else None
        while at in final and not final[at] and at not in want:
            want.add(at)
            at = parent[at]
    table = spark.createDataFrame(
        [("log", s, parent[s], 1 if final[s] else None) for s in final], "log_id string, slot bigint, parent_slot bigint, finalized_ns bigint"
    )
    assert want and rows(ancestry.canonical_ancestors(table), "slot") == [(s,) for s in sorted(want)]
    assert ancestry.canonical_ancestors(table.limit(0)).count() == 0


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, written, plain = 20_000, [], ancestry._written
    monkeypatch.setattr(ancestry, "_written", lambda df, label, count: written.append(label) or plain(df, label, count))
    table = spark.range(n).select(
        F.lit("log").alias("log_id"), F.col("id").alias("slot"), (F.col("id") - 1).alias("parent_slot"), F.when(F.col("id") == n - 1, 1).alias("finalized_ns")
    )
    assert ancestry.canonical_ancestors(table).count() == n - 1
    assert len(written) <= 2 + ancestry.STEP_ROUNDS + 1 + 16


# --- standstill -------------------------------------------------------------------------
def _standstill(make_lines, texts):
    parsed = parse.parse_lines(make_lines([votor(t) for t in texts])).cache()
    slots = S.build_slots(parsed).cache()
    ranges = standstill.standstill_ranges(parsed, slots).cache()
    tcl = standstill.tcl_outside_standstill(slots, ranges, S.overall_counters(parsed))
    return rows(ranges, "entry_slot", "exit_slot"), tcl.first().tcl_outside_standstill


ENDED = "Standstill initially detected at slot=%d has ended at slot=%d. x"
EXT = "Extending timeouts starting at slot %d"
TCL = "TimeoutCrashedLeader %d"


@pytest.mark.parametrize(
    "texts,ranges,outside",
    [
        ([EXT % 10, TCL % 12, EXT % 14, ENDED % (10, 20), TCL % 25], [(10, 20)], 1),
        ([EXT % 10, TCL % 12, EXT % 14, "First shred 30"], [(10, 30)], 0),
        ([TCL % 12, TCL % 13, TCL % 12], [], 3),
        ([ENDED % (10, 20), TCL % 10, TCL % 20], [(10, 20)], 0),
        ([ENDED % (10, 20), TCL % 9, TCL % 21, TCL % 15], [(10, 20)], 2),
        ([ENDED % (10, 90), ENDED % (15, 20), TCL % 50], [(10, 90), (15, 20)], 0),
    ],
)
def test_standstill_ranges(make_lines, texts, ranges, outside):
    assert _standstill(make_lines, texts) == (ranges, outside)


# --- issues and alerts ------------------------------------------------------------------
def test_groups_and_alert_order(make_lines):
    lines = (
        [votor("SetIdentity", at(0)), votor("Standstill 9", at(1)), votor("Standstill 9", at(3)), votor("Standstill 8", at(2))]
        + [other("app::a", f"bad {i}", at(5), "ERROR") for i in range(5)]
        + [other("app::b", "late then early", at(5), "ERROR"), other("app::b", "x", at(4), "ERROR")]
        + [other("app::b", "slow", at(6), "WARN")]
        + [other(parse.CLUSTER_SLOTS_MODULE, "No epoch_metadata record for epoch 3", at(7))]
        + [other(parse.CLUSTER_SLOTS_MODULE, "odd", at(8), "ERROR")]
    )
    parsed = parse.parse_lines(make_lines(lines)).cache()
    groups = issues.log_issue_groups(issues.issue_events(parsed), cap=3).cache()
    got = {(r.severity, r.module.split("::")[-1]): (r.n, r.sample_body, r.timestamps_dropped, r.last_ns - r.first_ns) for r in groups.collect()}
    assert got == {
        ("Critical", "a"): (5, "bad 0", 2, 0),
        ("Critical", "b"): (2, "late then early", 0, -S_NS),
        ("Warn", "b"): (1, "slow", 0, 0),
        ("Critical", "cluster_slots"): (2, "No epoch_metadata record for epoch 3", 0, S_NS),
    }
    outcomes = S.slot_outcomes(S.build_slots(parsed).withColumn("skip_classification", F.lit("not_skipped")))
    alerts = A.alerts(groups, standstill.standstill_firings(parsed), parsed, A.leader_summary(parsed, outcomes)).cache()
    order = [(r.severity, r.kind, r.description[:24]) for r in alerts.orderBy("alert_rank").collect()]
    assert order == [
        ("Critical", "LogPattern", "ERROR app::a (5 occurren"),
        ("Critical", "LogPattern", "ERROR app::b (2 occurren"),
        ("Critical", "LogPattern", "ERROR solana_core::clust"),
        ("Warn", "StandstillObserved", "Standstill firing at fin"),
        ("Warn", "StandstillObserved", "Standstill firing at fin"),
        ("Warn", "LogPattern", "WARN app::b (1 occurrenc"),
        ("Info", "IdentityChanged", "Operator rotated validat"),
    ]
    detail = {r.alert_rank: r for r in A.alert_detail(alerts, groups).collect()}
    assert (detail[4]["count"], detail[4].span_secs, detail[4].rate_per_min, detail[4].module_short) == (2, 2, 60.0, "standstill")
    assert detail[1].rate_per_min is None and detail[1].preview == "bad 0" and detail[1].module_short == "a"
    assert detail[7].span_secs is None
    roll = A.alert_rollup(alerts).first()
    assert (roll.critical, roll.warn, roll.info, roll.total) == (3, 3, 1, 7)


def test_histogram(spark):
    data = [("a", t * S_NS) for t in (10, 0, 20)] + [("ties", 5)] * 5
    df = spark.createDataFrame(data, "g string, ts_ns bigint")
    got = rows(issues.event_histogram(df, ["g"], 4), "g", "bin", "n")
    assert [n for g, _, n in got if g == "a"] == [1, 0, 1, 1]
    assert [n for g, _, n in got if g == "ties"] == [5, 0, 0, 0]


# --- order statistics and ordered passes ------------------------------------------------
def test_ranks_against_sorting(spark):
    rng = random.Random(1)
    groups = {
        "ten": list(range(1, 11)),
        "one": [42],
        "neg": [-5, -5, 0, 7, -100000],
        "hot": [rng.choice([3, 3, 3, 900, 10**9]) for _ in range(500)],
        "wide": [int(10 ** rng.uniform(0, 15)) for _ in range(800)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v bigint")
    rules = {"p0": ranks.rank_floor(-1), "p50": ranks.rank_floor(0.5), "p95": ranks.rank_floor(0.95),
             "p100": ranks.rank_floor(7), "nan": ranks.rank_floor(float("nan")), "base": ranks.rank_tenth}
    for r in ranks.exact_ranks(df, ["g"], "v", rules).collect():
        xs = sorted(groups[r.g])
        n = len(xs)
        pick = lambda p: xs[int((n - 1) * p)]
        assert (r.n, r.max_value, r.p0, r.p50, r.p95, r.p100, r["nan"], r.base) == (
            n, xs[-1], xs[0], pick(0.5), pick(0.95), xs[-1], xs[0], xs[n // 10])


def test_ordered_passes_across_chunks(spark):
    rng = random.Random(2)
    data = sorted((g, s, rng.choice([None, None, s * 10])) for g in "ab" for s in rng.sample(range(300), 120))
    df = spark.createDataFrame(data, "log_id string, slot bigint, v bigint")
    nxt = ordered.neighbour(df, F.col("v"), "x", forward=True, size=16)
    prev = ordered.neighbour(df, F.col("v"), "x", forward=False, size=16)
    top = ordered.running_max(df.withColumn("v", -F.col("v")), "v", "x", size=16)
    after = {(r.log_id, r.slot): r.x for r in nxt.collect()}
    before = {(r.log_id, r.slot): r.x for r in prev.collect()}
    best = {(r.log_id, r.slot): r.x for r in top.collect()}
    for g, s, _ in data:
        later = [v for h, t, v in data if h == g and t > s and v is not None]
        earlier = [v for h, t, v in data if h == g and t < s and v is not None]
        upto = [-v for h, t, v in data if h == g and t <= s and v is not None]
        assert after[(g, s)] == (later[0] if later else None)
        assert before[(g, s)] == (earlier[-1] if earlier else None)
        assert best[(g, s)] == (max(upto) if upto else None)


def test_rank_within_and_cap(spark):
    rng = random.Random(3)
    data = [(g, rng.randrange(3), rng.randrange(40), i) for i, g in enumerate("ab" * 150)]
    df = spark.createDataFrame(data, "g string, a int, b int, i bigint")
    got = ordered.rank_within(df, ["g"], [[F.col("a")], [F.col("b")]], [F.col("i")], "rank")
    for g in "ab":
        want = sorted((a, b, i) for h, a, b, i in data if h == g)
        assert [tuple(r)[:3] for r in got.where(F.col("g") == g).orderBy("rank").select("a", "b", "i").collect()] == want
        assert [r[0] for r in rows(got.where(F.col("g") == g), "rank")] == list(range(1, len(want) + 1))
    kept = ordered.first_by(df, ["g"], "i", 70, bits=5)
    for g in "ab":
        assert [r[0] for r in rows(kept.where(F.col("g") == g), "i")] == sorted(i for h, _, _, i in data if h == g)[:70]


# --- latency, gaps ----------------------------------------------------------------------
def test_delta_truncates_toward_zero(spark):
    df = spark.createDataFrame([(0, 0), (1000, 1), (1000, 0), (2000, 0), (0, 2999), (None, 5)], "a bigint, b bigint")
    assert [r[0] for r in df.select(C.delta_us("a", "b")).collect()] == [0, 0, None, None, 2, None]


def test_resumes(make_slots):
    crash, vote = "timeout_crashed_leader_ns", "voted_notarize_ns"
    t = make_slots(
        # Two crashed leaders in a row resume with the same vote.
        {"slot": 7, crash: S_NS},
        {"slot": 8, crash: 2 * S_NS},
        {"slot": 12, vote: 6 * S_NS},
        # The next vote is earlier in time: dropped, without trying the one after.
        {"slot": 30, crash: 9 * S_NS},
        {"slot": 31, vote: 8 * S_NS},
        {"slot": 32, vote: 10 * S_NS},
        # A slot does not resume itself, and nothing votes after it.
        {"slot": 40, crash: 20 * S_NS, vote: 21 * S_NS},
    )
    got = latency.vote_resumes(t)
    want = [(7, 12, 5_000_000, 5, "severe"), (8, 12, 4_000_000, 4, "severe")]
    assert rows(got, "tcl_slot", "resume_slot", "resume_us", "slot_gap", "severity") == want


def test_severity_bounds(spark):
    us = [-1, 0, 1_499_999, 1_500_000, 2_999_999, 3_000_000]
    df = spark.createDataFrame([(u,) for u in us], "u bigint")
    assert [r[0] for r in df.select(C.resume_severity(F.col("u"))).collect()] == [
        "severe", "normal", "normal", "elevated", "elevated", "severe"]


def test_gaps(make_slots):
    # Votes of either kind at 3, 4, 9 and 11: nothing before the first or after the last is a gap.
    t = make_slots(
        {"slot": 1}, {"slot": 3, "voted_skip_ns": 30}, {"slot": 4, "voted_notarize_ns": 41}, {"slot": 5},
        {"slot": 9, "voted_notarize_ns": 93, "voted_skip_ns": 94}, {"slot": 11, "voted_skip_ns": 117}, {"slot": 50},
    )
    got = {r.start_slot: (r.end_slot, r.gap_slots) for r in gaps.voting_gaps(t, 1).collect()}
    assert got == {5: (8, 4), 10: (10, 1)}
    assert [r.start_slot for r in gaps.voting_gaps(t, 2).collect()] == [5]


def test_top_k_is_pruned_before_the_shuffle(make_slots):
    t = make_slots({"slot": 1, "first_shred_ns": 0, "finalized_ns": 5000})
    plan = latency.top_slowest_slots(t)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- windows and buckets ----------------------------------------------------------------
def _meta(spark, lo, hi):
    return spark.createDataFrame([("log", 1, lo, hi)], "log_id string, line_count bigint, lo_ns bigint, hi_ns bigint")


def test_windows(spark, make_slots):
    hour = 3600 * S_NS
    t = make_slots(
        {"slot": 1, "first_shred_ns": hour // 2},
        {"slot": 2, "first_shred_ns": 3 * hour // 2},
        {"slot": 3, "first_shred_ns": 2 * hour},  # exactly at the end: outside
    )
    no_resumes = latency.vote_resumes(t)
    got = {r.label: r for r in W.window_stats(t, no_resumes, _meta(spark, 0, 2 * hour)).collect()}
    assert {k: r.slot_count for k, r in got.items()} == {"all": 2, "24h": 2, "12h": 2, "6h": 2, "3h": 2, "1h": 1}
    assert got["all"].slot_duration_p50_us == 3_600_000_000 and got["1h"].slot_duration_p50_us == 0
    assert got["24h"].start_ns == 0 and got["1h"].start_ns == hour
    assert got["24h"].slot_rate_per_sec == round(2 / 86400, 6)


def test_only_adjacent_slots_have_a_duration(make_slots):
    t = make_slots(*[{"slot": s, "first_shred_ns": s * 400_000_000} for s in (1, 2, 100)])
    assert rows(V.slot_durations(t), "slot", "duration_us") == [(1, 400_000)]


def test_bucket_index_and_count(spark):
    lo = 1000 * S_NS
    ts = [lo, lo + 59 * S_NS, lo + 60 * S_NS, lo + 599 * S_NS, lo + 10**6 * S_NS, lo - S_NS]
    df = spark.createDataFrame([(t, lo, lo + 600 * S_NS) for t in ts], "t bigint, lo_ns bigint, hi_ns bigint")
    assert [r[0] for r in df.select(buckets.bucket_index(F.col("t"), 60)).collect()] == [0, 0, 1, 9, 9, 0]
    for hi, width, n in ((7 * 3600 + 1, 900, 29), (2700, 180, 15), (1, 600, 1), (61, 60, 2)):
        one = spark.createDataFrame([(0, hi * S_NS)], "lo_ns bigint, hi_ns bigint")
        assert one.select(buckets.bucket_count(width)).first()[0] == n


def test_buckets_shares(spark, make_slots):
    t = make_slots(
        *[{"slot": i, "first_shred_ns": i, "finalized_ns": i + 1000 * i, "fast_finalize": i == 1} for i in (1, 2, 3)]
    )
    b = buckets.time_buckets(t, latency.vote_resumes(t), _meta(spark, 0, 1200 * S_NS), 600)
    s = buckets.bucket_series(b, 600)
    assert rows(s, "bucket", "fast_pct", "slow_pct", "finalized_total_count") == [(0, 33, 67, 3), (1, 0, 0, 0)]


def test_resample(spark):
    def run(n, width):
        df = spark.createDataFrame([("s", i, i * 10) for i in range(n)], "s string, i bigint, v bigint")
        out = buckets.resample_nearest(df, ["s"], "i", "v", width)
        return [r.v for r in out.orderBy("point").collect()]

    assert run(3, 9) == [0, 0, 0, 10, 10, 10, 20, 20, 20]
    assert run(10, 5) == [0, 20, 40, 60, 80]
    assert run(4, 0) == []


# --- view -------------------------------------------------------------------------------
def test_view_labels_and_filters(make_slots):
    one = {"first_shred_ns": 0, "block_emitted_ns": 550_000_000}
    view = V.slot_view(
        make_slots(
            {"slot": 1},
            {"slot": 2, "finalized_ns": 700_000_000, "fast_finalize": True, **one},
            {"slot": 3, "finalized_ns": 1, "fast_finalize": False, "block_emitted_ns": 2},
            {"slot": 4, "voted_skip_ns": 1, "finalized_ns": 1, "fast_finalize": True, "skip_classification": "canonical_direct"},
            {"slot": 5, "voted_skip_ns": 1, "skip_classification": "indeterminate", "timeout_crashed_leader_ns": 1, "safe_to_skip_ns": 1},
            {"slot": 6, "voted_notarize_ns": 1, "voted_finalize_ns": 1, "voted_skip_ns": 1, "skip_classification": "indeterminate"},
            {"slot": 7, "voted_finalize_ns": 1, "finalized_ns": 5},
        )
    ).cache()
    got = rows(view, "slot", "status", "status_label", "path", "vote_pattern", "event_tags", "consensus_inverted")
    assert got == [
        (1, "pending", "PEND", " ", "-", "", False),
        (2, "fast", "FIN", "F", "-", "", False),
        (3, "slow", "FIN", "S", "-", "", True),
        (4, "skipped", "CSKIP", "F", "S", "", False),
        (5, "skipped", "VSKIP", " ", "S", "TCL S2S", False),
        (6, "skipped", "VSKIP", " ", "N+F+S", "", False),
        (7, "slow", "FIN", "S", "-", "", False),
    ]
    band = view.where("slot = 2").select("assembly_ms", "assembly_band", "lifecycle_band").first()
    assert tuple(band) == (550.0, "warn", "warn")

    def slots(**flags):
        return [r[0] for r in rows(V.filter_slots(view, **flags), "slot")]

    assert slots() == [1, 2, 3, 4, 5, 6, 7]
    assert slots(vskip_only=True) == [5, 6]
    assert slots(vskip_only=True, canonical_skip_only=True) == [4, 5, 6]
    assert slots(vskip_only=True, tcl=True) == [5]
    assert slots(fast_only=True) == [2] and slots(slow_only=True) == [3, 7]
    got = V.page(view, 2, 3, [[F.shiftright("slot", 1)]], [F.col("slot")])
    assert sorted(r.slot for r in got.collect()) == [3, 4, 5]
