"""Damaged lines, late logs and odd names: counted or refused, never lost, never the job's end."""

from __future__ import annotations

import pytest
from conftest import HASH, other, votor
from pyspark.sql import functions as F

from slotwatch import LogTables, read_log_lines, session
from slotwatch.functions import text as X
from slotwatch.operators import buckets, issues
from slotwatch.operators import parse as P
from slotwatch.sources import lines as L
from slotwatch.streaming import jobs

LINES = "log_id string, seq bigint, line string"


@pytest.mark.parametrize("year", ["9999", "1600", "0001"])
def test_years_beyond_nanoseconds_are_parse_errors(spark, make_lines, year):
    df = make_lines([votor("First shred 1", f"{year}-01-01T00:00:00.5Z"), votor("First shred 2")])
    assert [r.outcome for r in P.parse_lines(df).orderBy("seq").collect()] == ["parse_error", "event"]


def test_sums_stop_at_the_largest_number(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([("a", big), ("a", big), ("b", 5), ("b", None), ("c", None)], "k string, v bigint")
    got = {r.k: r.s for r in df.groupBy("k").agg(X.saturating_sum(F.col("v")).alias("s")).collect()}
    assert got == {"a": big, "b": 5, "c": None}
    b = spark.createDataFrame([("a", big, 1), ("a", big, 1)], "log_id string, signature_sum bigint, signature_sample_count bigint")
    assert buckets.tx_per_block(b).first().avg_tx_per_block == big // 2


@pytest.mark.parametrize("name", ["", "p" * 400])
def test_any_log_id_keeps_its_rows(spark, tmp_path, name):
    df = spark.createDataFrame([(name, 0, votor("First shred 7")), ("a", 0, votor("First shred 8"))], LINES)
    t = LogTables(df, str(tmp_path / "store"))
    assert {r.log_id: r.lines for r in t.ingest_counts().collect()} == {name: 1, "a": 1}
    assert {r.log_id for r in t.facts().collect()} == {name, "a"}


def test_whole_bodies_are_stored_and_cut_where_shown(spark, make_lines, tmp_path):
    body = "b" * 5000
    t = LogTables(make_lines([other("x::y", body, level="WARN")]), str(tmp_path / "store"))
    assert t.parsed.first().body == body
    assert t.issue_events().first().body == t.log_issue_groups().first().sample_body == "b" * 200


def test_histogram_counts_every_row(spark, make_lines, tmp_path, monkeypatch):
    lines = [other("x::y", "w", f"2026-05-01T00:00:{i % 60:02d}Z", "WARN") for i in range(90)]
    t = LogTables(make_lines(lines), str(tmp_path / "store"))
    monkeypatch.setattr(issues, "MAX_GROUP_TIMESTAMPS", 10)
    total = lambda df: df.agg(F.sum("n")).first()[0]
    assert total(t.issue_histogram(6)) == 90
    assert total(t.issue_histogram(6, cap=40)) == 40


def test_issue_groups_hash_without_a_sort(spark, make_lines):
    df = issues.log_issue_groups(issues.issue_events(P.parse_lines(make_lines([other("x::y", "w", level="WARN")]))))
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_counters_take_a_log_that_comes_last(spark, tmp_path):
    source = tmp_path / "in"
    days = {"new1": "2026-05-03", "new2": "2026-05-03", "old": "2026-05-01"}
    for log, day in days.items():
        rows = [(log, i, votor(f"First shred {i}", f"{day}T0{i}:00:00Z")) for i in range(7)]
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = str(tmp_path / "counters")
    jobs.stream_counters(stream, out, str(tmp_path / "state"), 3600).awaitTermination()
    assert spark.read.parquet(out).select("batch").distinct().count() == 3
    want = {(log, i) for log in days for i in range(7)}

    def seen():
        got = jobs.read_counters(spark, out).collect()
        assert all(r.n == 1 for r in got)
        return {(r.log_id, r.start.hour) for r in got}

    assert seen() == want
    jobs.compact_counters(spark, out)
    assert seen() == want
    spark.createDataFrame([("more", 0, votor("First shred 1"))], LINES).write.mode("append").parquet(str(source))
    jobs.stream_counters(stream, out, str(tmp_path / "state"), 3600).awaitTermination()
    assert len(jobs.read_counters(spark, out).collect()) == 22


def test_slots_compact_in_place(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "slots")
    for i in range(3):
        spark.createDataFrame([("a", i, votor(f"First shred {i}"))], LINES).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_slots(stream, out, str(tmp_path / "state")).awaitTermination()
    before = jobs.read_slots(spark, out).collect()
    jobs.compact_slots(spark, out)
    assert sorted(jobs.read_slots(spark, out).collect()) == sorted(before) and len(before) == 3


def test_positions_are_checked(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text("x\n")
    (tmp_path / "b.log").write_text("y\n")
    monkeypatch.setattr(L, "MAX_FILES", 1)
    with pytest.raises(Exception, match="too many files"):
        read_log_lines(spark, f"{tmp_path}/*.log", log_id=lambda p: F.lit("one")).collect()
    monkeypatch.setattr(L, "MAX_FILE_BYTES", 1)
    with pytest.raises(Exception, match="too large"):
        read_log_lines(spark, f"{tmp_path}/a.log").collect()


def test_stream_over_files_equals_batch(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for part in range(4):
        lines = [votor(f"Finalized ({part * 10 + i}, {HASH}) fast: true") for i in range(5)] + ["not a record"]
        (folder / f"v.{part}.log").write_text("\r\n".join(lines) + "\n")
    number = lambda p: F.regexp_extract(p, r"\.(\d+)\.log$", 1).cast("int")
    name = lambda p: F.lit("v")
    out = str(tmp_path / "out")
    jobs.stream_parse_files(spark, str(folder), out, str(tmp_path / "state"), name, number, max_files=1).awaitTermination()
    got = jobs.read_parts(spark, out)
    want = P.parse_lines(read_log_lines(spark, f"{folder}/*.log", name, number))
    got = got.select(*want.columns)
    assert want.count() == 24 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_results_do_not_overwrite_stages(spark, make_lines, tmp_path):
    t = LogTables(make_lines([votor("First shred 1")]), str(tmp_path / "store"))
    for out in ("store", "store/x", ""):
        with pytest.raises(ValueError):
            t.write_all(str(tmp_path / out))
    assert t.parsed.count() == 1
    t.discard()
    assert not (tmp_path / "store").exists()


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_places_and_pages_per_log(spark, tmp_path):
    lines = [(log, i, votor(f"First shred {i}")) for log in ("a", "b") for i in range(6)]
    t = LogTables(spark.createDataFrame(lines, LINES), str(tmp_path / "store"))
    got = sorted((r.log_id, r.place, r.slot) for r in t.slot_page(2, 2).collect())
    assert got == [("a", 3, 2), ("a", 4, 3), ("b", 3, 2), ("b", 4, 3)]


def test_long_spine_comes_in_blocks(spark):
    meta = spark.createDataFrame([("a", 0, 200_000 * 60 * 10**9)], "log_id string, lo_ns bigint, hi_ns bigint")
    spine = buckets.bucket_spine(meta, 60)
    assert spine.agg(F.count(F.lit(1)), F.countDistinct("bucket"), F.max("bucket")).first()[:] == (200_000, 200_000, 199_999)


def test_report_has_files_and_skip_events(spark, tmp_path):
    (tmp_path / "v.log").write_text(votor("First shred 1") + "\n" + votor("Voting skip for slot 1") + "\n")
    t = LogTables(read_log_lines(spark, f"{tmp_path}/v.log"), str(tmp_path / "store"))
    report = {r.metric: r.value for r in t.summary_report().collect()}
    assert report["path"].endswith("/v.log") and report["n_files"] == "1"
    assert report["size_bytes"] == str((tmp_path / "v.log").stat().st_size)
    assert {"vote_skips", "canonical_skips", "indeterminate_skips", "total_slots", "vote_skip_events_pct", "vote_skip_slots_pct"} <= set(report)
