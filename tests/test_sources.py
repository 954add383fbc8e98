"""Text files in, tables out: arrival order, files of one log, staging and streams."""

from __future__ import annotations

import gzip
from datetime import datetime, timedelta

import pytest
from conftest import HASH, SF, votor
from pyspark.sql import functions as F

from slotwatch import LogTables, read_log_lines
from slotwatch.operators import parse as P
from slotwatch.operators import slots as S
from slotwatch.operators.sizing import join_small
from slotwatch.sources import fixture_log as fixture
from slotwatch.sources.lines import file_meta
from slotwatch.streaming import checks as streamed
from slotwatch.streaming import jobs


def test_order_over_splits_and_files(spark, tmp_path):
    want = {}
    for log in ("x", "y"):
        for part, n in ((1, 3000), (2, 10), (10, 800)):
            lines = [f"{log} {part} {i} " + "p" * (i % 90) for i in range(n)]
            (tmp_path / f"{log}.{part}.log").write_text("\n".join(lines) + "\n")
            want.setdefault(log, []).extend(lines)
    size = "spark.sql.files.maxPartitionBytes"
    before = (spark.conf.get(size), spark.conf.get("spark.sql.files.openCostInBytes"))
    spark.conf.set(size, "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = read_log_lines(
            spark,
            f"{tmp_path}/*.log",
            log_id=lambda p: F.regexp_extract(p, r"([xy])\.\d+\.log$", 1),
            file_order=lambda p: F.regexp_extract(p, r"\.(\d+)\.log$", 1).cast("int"),
        )
        assert lines.rdd.getNumPartitions() > 20
        got = lines.select("log_id", "seq", "line").orderBy("log_id", "seq").collect()
    finally:
        spark.conf.set(size, before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len({(r.log_id, r.seq) for r in got}) == len(got)
    for log, lines in want.items():
        assert [r.line for r in got if r.log_id == log] == lines


def test_splits_of_empty_lines_stay_unique(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n" * 5000)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "100")
    try:
        lines = read_log_lines(spark, str(tmp_path / "a.log"))
        row = lines.agg(F.count(F.lit(1)), F.countDistinct("seq")).first()
    finally:
        spark.conf.set(size, before)
    assert tuple(row) == (5000, 5000)


def test_line_ends_and_bad_bytes(spark, tmp_path):
    good = votor("First shred 1")
    (tmp_path / "a.log").write_bytes(good.encode() + b"\r\n" + b"one\rline\n" + b"[2026-\xff bad\n" + b"last")
    lines = read_log_lines(spark, str(tmp_path / "a.log"))
    got = P.parse_lines(lines).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["event", "continuation", "parse_error", "continuation"]
    assert got[0].slot == 1


def test_gzip_and_file_meta(spark, tmp_path):
    (tmp_path / "a.1.log").write_text("a\nb\n")
    with gzip.open(tmp_path / "a.2.log.gz", "wt") as f:
        f.write("c\nd\ne\n")
    lines = read_log_lines(spark, f"{tmp_path}/*", log_id=lambda p: F.lit("a"))
    assert [r.line for r in lines.orderBy("seq").collect()] == list("abcde")
    meta = file_meta(lines).first()
    sizes = sum(p.stat().st_size for p in tmp_path.iterdir())
    assert (meta.n_files, meta.size_bytes, meta.line_count) == (2, sizes, 5)


def test_join_small_salted_equals_broadcast(spark):
    big = spark.range(2000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k bigint, v string")
    for how in ("inner", "left"):
        a = join_small(big, small, ["k"], how).select("k", "id", "v")
        b = join_small(big, small, ["k"], how, max_rows=2).select("k", "id", "v")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()


def test_salted_copies_are_never_broadcast(spark):
    big = spark.range(2000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k bigint, v string")
    for how in ("inner", "left"):
        joined = join_small(big, small, ["k"], how, max_rows=2)
        joined.collect()
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_staged_tables_and_report(spark, tmp_path):
    lines = [votor("First shred 7"), votor(f"Finalized (7, {HASH}) fast: true", "2026-05-01T00:00:00.5Z")]
    df = spark.createDataFrame([("solo", i, line) for i, line in enumerate(lines)], "log_id string, seq bigint, line string")
    t = LogTables(df, str(tmp_path / "store"))
    assert t.lifecycle_latency().first().p50 == 500_000
    report = {(r.section, r.metric): r.value for r in t.summary_report().collect()}
    assert report[("header", "lines")] == "2" and report[("lifecycle", "p50")] == "500.0"
    assert report[("gaps", "count")] == "0"
    assert "PushedFilters: [IsNotNull(kind)" in t.events.where("kind = 'Finalized'")._jdf.queryExecution().executedPlan().toString() or (
        "EqualTo(kind,Finalized)" in t.events.where("kind = 'Finalized'")._jdf.queryExecution().executedPlan().toString()
    )
    written = t.write_all(str(tmp_path / "out"))
    assert "alerts" in written
    assert spark.read.parquet(str(tmp_path / "out" / "slots")).count() == 1


def test_empty_log_has_no_range(spark, tmp_path):
    df = spark.createDataFrame([("solo", 0, "nothing here")], "log_id string, seq bigint, line string")
    t = LogTables(df, str(tmp_path / "store"))
    assert t.window_stats().count() == 0 and t.time_buckets().count() == 0
    assert t.rates().first().resumes_per_hour is None
    assert t.alerts().count() == 0


def test_streamed_slots_over_many_batches(spark, sample_lines, tmp_path):
    source = str(tmp_path / "in")
    sample_lines.select("log_id", "seq", "line").repartition(4, "seq").write.parquet(source)
    stream = spark.readStream.schema(sample_lines.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "slots")
    jobs.stream_slots(stream, out, str(tmp_path / "state")).awaitTermination()
    got = jobs.read_slots(spark, out)
    want = S.build_slots(P.parse_lines(sample_lines))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    jobs.compact_slots(spark, out, str(tmp_path / "small"))
    assert jobs.read_slots(spark, str(tmp_path / "small")).exceptAll(want).count() == 0
    assert spark.read.parquet(out).select("batch").distinct().count() >= 4


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert SF == entry.SMOKE_DIR


@pytest.fixture
def events_dir(spark, tmp_path):
    """Writes an events table of one row group in ever so many splits."""

    def write(rows):
        path = str(tmp_path / "events.parquet")
        kinds = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(path)
        return str(tmp_path)

    return write


def made_events(ids):
    kinds = ["view", "click", "purchase", "signup", "error"]
    start = datetime(2024, 1, 1)
    return [(i, start + timedelta(seconds=i), k % 90, kinds[k * 7 % 5], 1.0, f'{{"k": {k}}}') for k, i in enumerate(ids)]


def rows_by_task(df):
    return [n for _, n in df.groupBy(F.spark_partition_id()).count().collect()]


def test_one_row_group_is_rendered_by_many_tasks(spark, events_dir, monkeypatch):
    """A file may have more splits than row groups; its events are dealt out all the same, equal ones too."""
    folder = events_dir(made_events(range(400)) + made_events([7])[:1] * 400)
    monkeypatch.setattr(fixture, "EVENTS_PER_TASK", 50, raising=False)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "512")
        assert spark.read.parquet(f"{folder}/events.parquet").rdd.getNumPartitions() > 4
        lines = fixture.fixture_log(spark, folder)
        n = rows_by_task(lines)
        assert len(n) >= 14 and max(n) < 0.2 * sum(n)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lines_of_a_file_come_in_order_from_sorted_events(spark, events_dir):
    """Also those of ids that repeat; no line is sorted."""
    ids = [*range(60), *[5] * 7, 5, 8, 8, 21, *range(-30, 0)]
    folder = events_dir(made_events(ids))
    files = streamed.file_lines(spark, folder)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Sort [")  # the plan is printed from its end
    lines = fixture.fixture_log(spark, folder).collect()
    found = [(r.log_id, r.part, r.value) for r in files.collect()]
    assert len({(r.log_id, r.part) for r in files.select("log_id", "part").distinct().collect()}) == 9
    for log in {r.log_id for r in lines}:
        of = sorted((r.seq, r.line) for r in lines if r.log_id == log)
        lo, hi = of[0][0], of[-1][0]
        part = [min((seq - lo) * 3 // (hi - lo + 1), 2) for seq, _ in of]
        # Lines at one position come in any order.
        place = {}
        for (seq, line), p in zip(of, part):
            place.setdefault((p, line), []).append(seq)
        for p in range(3):
            mine = [value for lg, q, value in found if (lg, q) == (log, p)]
            assert sorted(mine) == sorted(line for (_, line), q in zip(of, part) if q == p)
            at = -(2**63)
            for value in mine:
                at = min(x for x in place[p, value] if x >= at)
                place[p, value].remove(at)
    written = streamed.rendered_files(spark, folder)
    read = streamed._read_files(spark, written)
    assert read.count() == len(lines)
    paths = spark.read.text(written).select("log_id", "part", F.input_file_name().alias("path")).distinct()
    assert sorted(r[:2] for r in paths.collect()) == [(log, p) for log in ("log-1", "log0", "log1") for p in range(3)]


def test_shuffled_stream_reads_small_files_in_four_batches(spark, monkeypatch, sample_lines, tmp_path):
    monkeypatch.setattr(fixture, "EVENTS_PER_TASK", 50, raising=False)
    stream = streamed._shuffled_stream(spark, SF)
    sizes = []

    def save(batch, _):
        sizes.append([n for _, n in batch.groupBy(F.input_file_name()).count().collect()])

    stream.writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    total = sum(map(sum, sizes))
    assert total == sample_lines.count()
    assert len(sizes) == 4 and all(0.2 * total < sum(s) < 0.3 * total for s in sizes)
    assert max(map(max, sizes)) < 0.1 * total


def test_records_and_events_are_made_by_compiled_code(spark):
    """A generator interprets its expressions, so rendering and parsing give theirs plain columns."""
    plan = P.parse_lines(fixture.fixture_log(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate " in line]
    assert len(made) == 2 and not any("CASE WHEN" in line for line in made)
