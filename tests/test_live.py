"""Standstill periods and issue groups from a stream, against the batch operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from slotwatch.operators import issues, standstill
from slotwatch.operators.parse import parse_lines
from slotwatch.operators.slots import build_slots
from slotwatch.streaming import jobs, live
from tests.conftest import other, votor

LINES = "log_id string, seq bigint, line string"
CLUSTER = "solana_core::cluster_slots_service::cluster_slots"


def made(seed, n=90):
    """Lines of two logs with many ends, extensions and firings, some of them damaged."""
    rng = random.Random(seed)
    rows = []
    for log in ("a", "b"):
        for i in range(n):
            s = rng.randint(10, 40)
            text = rng.choice(
                [
                    votor(f"Standstill {s}"),
                    votor(f"Extending timeouts starting at slot {s}"),
                    votor(f"Extending timeouts starting at slot {s}"),
                    votor(f"Standstill initially detected at slot={s} has ended at slot={s + 3}."),
                    votor(f"First shred {s}"),
                    votor(f"ProduceWindow LeaderWindowInfo {{ start_slot: {s}, end_slot: {s + rng.choice((3, 40))}, parent_block: ({s}, {'A' * 40}) }}"),
                    votor("First shred x"),
                    other(f"app::m{s % 3}", f"failed {i} é", level=rng.choice(["WARN", "ERROR"])),
                    other(CLUSTER, f"No epoch info for slot {s}", level="ERROR"),
                    "not a record",
                ]
            )
            at = f"2026-05-01T00:{rng.randint(0, 59):02d}:00.{i:09d}Z"
            rows.append((log, i, text.replace("2026-05-01T00:00:00.000000000Z", at)))
    return rows


def stream_of(spark, tmp_path, rows, seed):
    """Every file is a batch; lines are dealt to them at random."""
    rng = random.Random(seed)
    source = str(tmp_path / "in")
    rows = list(rows)
    rng.shuffle(rows)
    for k in range(0, len(rows), 45):
        spark.createDataFrame(rows[k : k + 45], LINES).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(source)


def same(got, want):
    got = got.select(*want.columns)
    return sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_standstill_equals_batch_in_any_order(spark, tmp_path, seed):
    rows = made(seed)
    parsed = parse_lines(spark.createDataFrame(rows, LINES))
    firings = standstill.standstill_firings(parsed)
    ranges = standstill.standstill_ranges(parsed, build_slots(parsed))
    out = str(tmp_path / "out")
    live.stream_standstill(stream_of(spark, tmp_path, rows, seed), out, str(tmp_path / "state")).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 4
    for _ in range(2):  # as written, then compacted
        assert same(live.read_standstill_alerts(spark, out), firings)
        assert same(live.read_standstill_ranges(spark, out), ranges)
        live.compact_standstill(spark, out)


def test_an_end_that_comes_late_moves_the_open_period(spark, tmp_path):
    """The last end is in the last batch, although its line stands before lines of earlier batches."""
    rows = [
        ("a", 0, votor("First shred 90")),
        ("a", 1, votor("Extending timeouts starting at slot 10")),
        ("a", 3, votor("Extending timeouts starting at slot 30")),
        ("a", 4, votor("Extending timeouts starting at slot 40")),
    ]
    late = [("a", 2, votor("Standstill initially detected at slot=5 has ended at slot=20."))]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1)

    def run(some):
        spark.createDataFrame(some, LINES).coalesce(1).write.mode("append").parquet(source)
        live.stream_standstill(stream.parquet(source), out, str(tmp_path / "state")).awaitTermination()
        return sorted((r.entry_slot, r.exit_slot, r.seq) for r in live.read_standstill_ranges(spark, out).collect())

    assert run(rows) == [(10, 90, None)]
    live.compact_standstill(spark, out)
    assert sorted(run(late), key=repr) == [(30, 90, None), (5, 20, 2)]


def test_issue_groups_equal_batch_in_any_order(spark, tmp_path):
    rows = made(3)
    want = issues.log_issue_groups(issues.issue_events(parse_lines(spark.createDataFrame(rows, LINES))), cap=5)
    out = str(tmp_path / "out")
    live.stream_issues(stream_of(spark, tmp_path, rows, 4), out, str(tmp_path / "state")).awaitTermination()
    for _ in range(2):
        assert same(live.read_issues(spark, out, cap=5), want)
        live.compact_issues(spark, out)
    assert want.where(F.col("timestamps_dropped") > 0).count() > 0


def test_nothing_arrives(spark, tmp_path):
    out = str(tmp_path / "out")
    live.stream_issues(stream_of(spark, tmp_path, [("a", 0, "not a record")], 0), out, str(tmp_path / "state")).awaitTermination()
    assert live.read_issues(spark, out).count() == 0


def test_a_reader_outlives_a_compaction(spark, tmp_path):
    """What a reader listed before a compaction is still there after it, and goes with the next one."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1)

    def more(i):
        spark.createDataFrame([("a", i, other("app", f"failed {i}", level="WARN"))], LINES).coalesce(1).write.mode("append").parquet(source)
        live.stream_issues(stream.parquet(source), out, str(tmp_path / "state")).awaitTermination()

    for i in range(3):
        more(i)
    early = jobs.read_parts(spark, out)
    live.compact_issues(spark, out)
    assert early.count() == 3
    assert [r.n for r in live.read_issues(spark, out).collect()] == [3]
    more(3)
    held = live.read_issues(spark, out)
    live.compact_issues(spark, out)
    assert [r.n for r in held.collect()] == [4] == [r.n for r in live.read_issues(spark, out).collect()]
    assert not list((tmp_path / "out").glob("batch=[012]"))
