"""The streaming jobs run to completion over the rendered log of a test-data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwatch.operators.ordered import rank_within
from slotwatch.operators.parse import PAYLOAD, parse_lines
from slotwatch.operators.sizing import join_small
from slotwatch.session import fresh_path, prepare
from slotwatch.sources.fixture_log import (
    EVENT_COLUMNS,
    FIRST_SLOT,
    LINES_PER_ID,
    fixture_log,
    log_of,
    read_events,
    render,
    render_tasks,
)
from slotwatch.sources.lines import file_meta, read_log_lines
from slotwatch.streaming import jobs, live

LOGS = 3  # of a rendered log at most: ids are even, odd, or odd and negative
FILES_PER_LOG = 3


def _line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered log as a stream over the ``events`` file."""
    prepare(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENT_COLUMNS)
    # One number about the whole table; a stream cannot look ahead for it.
    last_id = events.where(F.col("event_id") % 2 == 1).agg(F.max("event_id")).first()[0]
    stream = (
        spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .select(*EVENT_COLUMNS)
    )
    # One file may be one task; its compact rows are spread before they become lines.
    stream = stream.repartition(render_tasks(events), *EVENT_COLUMNS)
    return render(stream, F.lit(FIRST_SLOT + last_id // 2).cast("bigint"))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(prepare(spark), "stream-parsed")
    jobs.stream_parse(_line_stream(spark, sf_dir), f"{out}/data", f"{out}/state").awaitTermination()
    return (
        spark.read.parquet(f"{out}/data")
        .groupBy("log_id", "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``[log_id, part, value]``: the rendered log with the file of each line, a file in one task and in arrival order.

    A file is written by one task, but its lines are not sorted there: the compact events are, and their lines are
    rendered in that order while they are written. Of an id that comes more than once every event is sorted once
    for each place that its lines may take, so that lines of equal ids mix as their positions ask. An
    event whose lines lie in two files goes to both, and each keeps its own.
    """
    events, last_slot = read_events(spark, sf_dir)
    log, seq = Window.orderBy("log_id"), F.col("event_id") * LINES_PER_ID
    cuts = fixture_log(spark, sf_dir).groupBy("log_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    cuts = cuts.where("log_id is not null").withColumn("log", (F.row_number().over(log) - 1).cast("int"))

    def part(seq: Column) -> Column:
        share = ((seq - F.col("lo")) * FILES_PER_LOG / (F.col("hi") - F.col("lo") + 1)).cast("int")
        return F.least(F.greatest(share, F.lit(0)), F.lit(FILES_PER_LOG - 1))

    several = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("event_id", F.lit(True).alias("several"))
    places = F.when(F.col("several"), F.sequence(F.lit(0), F.lit(LINES_PER_ID - 1))).otherwise(F.array(F.lit(None).cast("int")))
    placed = (
        join_small(events, several, ["event_id"], "left")
        .withColumn("log_id", log_of(F.col("event_id")))
        .join(F.broadcast(cuts), "log_id")
        .withColumn("part", F.explode(F.sequence(part(seq), part(seq + LINES_PER_ID - 1))))
        .withColumn("place", F.explode(places))
    )
    ordered = placed.repartitionById(LOGS * FILES_PER_LOG, F.col("log") * FILES_PER_LOG + F.col("part")).sortWithinPartitions(
        "log_id", "part", "event_id", "place", *EVENT_COLUMNS[1:]
    )
    here = F.coalesce(F.pmod("seq", F.lit(LINES_PER_ID)) == F.col("place"), F.lit(True)) & (part(F.col("seq")) == F.col("part"))
    lines = render(ordered.drop("log_id"), last_slot, "part", "place", "lo", "hi").where(here)
    return lines.select("log_id", "part", F.col("line").alias("value"))


def rendered_files(spark: SparkSession, sf_dir: str) -> str:
    """The rendered log as text files, several for each log, in arrival order by name."""
    out = fresh_path(prepare(spark), "text-logs")
    file_lines(spark, sf_dir).write.partitionBy("log_id", "part").text(out)
    return out


def _of_path(name: str):
    return lambda path: F.regexp_extract(path, rf"/{name}=([^/]*)/", 1)


def _read_files(spark: SparkSession, folder: str) -> DataFrame:
    number = lambda p: _of_path("part")(p).cast("int")
    return read_log_lines(spark, f"{folder}/*/*/*.txt", log_id=_of_path("log_id"), file_order=number)


def _placed_events(parsed: DataFrame) -> DataFrame:
    """Events with their place in the log's arrival order."""
    events = parsed.where("outcome = 'event'")
    placed = rank_within(events, ["log_id"], [[F.shiftright("seq", 16)]], [F.col("seq")], "place")
    return placed.select("log_id", "place", "ts_ns", "kind", *PAYLOAD)


def text_source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in arrival order, read from text files."""
    lines = _read_files(spark, rendered_files(spark, sf_dir))
    out = fresh_path(spark, "text-parsed")
    parse_lines(lines).write.parquet(out)
    return _placed_events(spark.read.parquet(out))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines per log, read from text files."""
    return file_meta(_read_files(spark, rendered_files(spark, sf_dir))).select("log_id", "n_files", "line_count")


def streamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed events from a stream over text files, two files a batch."""
    folder, out = rendered_files(spark, sf_dir), fresh_path(prepare(spark), "stream-files")
    jobs.stream_parse_files(
        spark, f"{folder}/*/*", f"{out}/data", f"{out}/state", _of_path("log_id"), lambda p: _of_path("part")(p).cast("int"), max_files=2
    ).awaitTermination()
    return _placed_events(jobs.read_parts(spark, f"{out}/data"))


def streamed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(prepare(spark), "stream-counters")
    jobs.stream_counters(_line_stream(spark, sf_dir), f"{out}/data", f"{out}/state").awaitTermination()
    return jobs.read_counters(spark, f"{out}/data").select(
        "log_id", "kind", F.unix_seconds("start").alias("start_secs"), "n"
    )


def streamed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(prepare(spark), "stream-slots")
    jobs.stream_slots(_line_stream(spark, sf_dir), f"{out}/data", f"{out}/state").awaitTermination()
    return jobs.read_slots(spark, f"{out}/data")


def _shuffled_stream(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """The rendered log as a stream of several batches, each with lines from all over the log."""
    out = fresh_path(prepare(spark), "stream-lines")
    # A batch has as many files as it takes to keep them small.
    files = -(-render_tasks(read_events(spark, sf_dir)[0]) // batches)
    fixture_log(spark, sf_dir).repartition(batches * files, "log_id", "seq").write.parquet(out)
    return spark.readStream.schema("log_id string, seq bigint, line string").option("maxFilesPerTrigger", files).parquet(out)


def streamed_standstill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and firings as of the last batch, after a compaction."""
    out = fresh_path(prepare(spark), "stream-standstill")
    live.stream_standstill(_shuffled_stream(spark, sf_dir), f"{out}/data", f"{out}/state").awaitTermination()
    live.compact_standstill(spark, f"{out}/data")
    none = F.lit(None).cast("bigint")
    ranges = live.read_standstill_ranges(spark, f"{out}/data").select(
        "log_id", F.lit("range").alias("what"), F.col("entry_slot").alias("slot"), F.col("exit_slot").alias("slot_end"), "seq",
        none.alias("firings"), none.alias("first_ns"), none.alias("last_ns"),
    )
    firings = live.read_standstill_alerts(spark, f"{out}/data").select(
        "log_id", F.lit("firing").alias("what"), "slot", none.alias("slot_end"), none.alias("seq"), "firings", "first_ns", "last_ns"
    )
    return ranges.unionByName(firings)


def streamed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(prepare(spark), "stream-issues")
    live.stream_issues(_shuffled_stream(spark, sf_dir), f"{out}/data", f"{out}/state").awaitTermination()
    return live.read_issues(spark, f"{out}/data")
