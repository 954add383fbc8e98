"""The store of parsed lines by class."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwatch import LogTables
from slotwatch.operators import parse, standstill
from slotwatch.operators import slots as S
from slotwatch.operators import view as V
from slotwatch.operators.issues import issue_events, log_issue_groups


def classes_read(df) -> set[str]:
    """The classes of the store's folders that a plan would open."""
    return {f.split("/class=")[1].split("/")[0] for f in df.inputFiles() if "/class=" in f}


def test_readers_open_only_their_classes(spark, sample_lines, tmp_path):
    t = LogTables(sample_lines, str(tmp_path / "store"))
    assert classes_read(t.parsed) == {"slot", "rare", "issue", "rest"}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df, names in ((t.rare_events, "[rare]"), (t.standstill_alerts(), "[rare]"), (t.leader_slots(), "[rare]")):
        assert f"class#" in plan(df) and "PartitionFilters" in plan(df) and "rare" in plan(df).split("PartitionFilters")[1]
        assert "slot,rare" not in plan(df).replace(" ", "")
    files = spark.read.parquet(f"{tmp_path}/store/parsed").select("class").distinct()
    assert {r[0] for r in files.collect()} == {"slot", "rare", "issue", "rest"}


def test_alerts_read_rare_and_issue_files_only(spark, sample_lines, tmp_path):
    t = LogTables(sample_lines, str(tmp_path / "store"))
    t.outcomes, t.issue_groups  # staged before
    union = t.alert_rows
    for df in (t.issue_events(), t.rare_events):
        text = df._jdf.queryExecution().executedPlan().toString()
        filters = text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
        assert "rare" in filters and "slot" not in filters and "rest" not in filters
    assert union.count() > 0


def test_same_rows_as_unclassed(spark, sample_lines, tmp_path):
    t = LogTables(sample_lines, str(tmp_path / "store"))
    parsed = parse.parse_lines(sample_lines)
    same = lambda a, b: a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()
    assert same(t.parsed, parsed)
    assert same(t.parse_events(), parse.parse_events(parsed))
    assert same(t.log_issue_groups(), log_issue_groups(issue_events(parsed)))
    assert same(t.standstill_alerts(), standstill.standstill_firings(parsed).drop("seq"))
    assert same(t.leader_slots(), S.leader_slots(parsed).select("log_id", "slot").distinct())
    assert "Sort [class" not in parsed.withColumn("class", S.line_class())._jdf.queryExecution().executedPlan().toString()


def files_opened(df) -> int:
    """Files that the scan of a plan has read, by its own metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numFiles").value()


def test_deep_page_opens_the_files_of_its_places(spark, tmp_path):
    placed = spark.range(600_000).select(F.lit("log").alias("log_id"), F.col("id").alias("slot"), (F.col("id") + 1).alias("place"))
    V.place_index(placed).write.partitionBy("place_block").parquet(f"{tmp_path}/places")
    index = spark.read.parquet(f"{tmp_path}/places").select("log_id", "slot", "place", "place_block")
    assert len(index.inputFiles()) == 5
    for offset, limit, files in ((500_000, 50, 1), (0, 10, 1), (V.PLACE_BLOCK - 5, 10, 2), (599_990, 50, 1)):
        got = V.indexed_page(index, offset, limit)
        assert sorted(r.slot for r in got.collect()) == list(range(offset, min(offset + limit, 600_000)))
        assert files_opened(got) == files
    assert V.indexed_page(index, 0, 0).count() == 0 and V.indexed_page(index, 10**9, 5).count() == 0


def test_pages_of_filtered_lists(spark, sample_lines, tmp_path):
    t = LogTables(sample_lines, str(tmp_path / "store"))
    for flags in ({}, {"fast_only": True}, {"vskip_only": True, "tcl": True}):
        want = sorted((r.log_id, r.slot) for r in t.filtered_view(**flags).collect())
        for log in {w[0] for w in want}:
            mine = [s for l, s in want if l == log]
            for offset, limit in ((0, 3), (2, 5), (len(mine) - 1, 4), (len(mine), 2)):
                page = t.slot_page(offset, limit, **flags).where(F.col("log_id") == log)
                assert sorted(r.slot for r in page.collect()) == mine[offset : offset + limit]
    want = sorted(tuple(r) for r in t.incidents().where("place IN (2, 3)").collect())
    assert sorted(tuple(r) for r in t.incident_page(1, 2).collect()) == want
