"""Structured Streaming jobs that keep the batch tables up to date.

They read a stream of ``lines[log_id, seq, line]``, or a folder of text logs, and share
the batch parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwatch.functions.text import DEFAULT_BUCKET_SECS
from slotwatch.operators.parse import parse_lines
from slotwatch.operators.slots import fold_slots, merge_slots, slot_columns, slot_input
from slotwatch.sources.lines import file_columns, numbered_lines


def stream_parse(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse the stream into a Parquet table of parsed rows (stateless, append only)."""
    return (
        parse_lines(lines)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_parse_files(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    log_id: Callable[[Column], Column] | None = None,
    file_number: Callable[[Column], Column] | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Parse a growing folder of text logs, ``max_files`` new files a batch.

    A line gets the same ``seq`` as from :func:`read_log_lines`, as far as that is known
    before all files are: ``file_number`` maps a path to the file's place in its log (by default
    every file is a log of its own). Each batch writes a folder of its own, so a retried
    batch replaces what it wrote.
    """
    stream = (
        spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(path).select("value", *file_columns())
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        lines = numbered_lines(batch, log_id, file_number)
        parse_lines(lines).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_counters(
    lines: DataFrame, out: str, checkpoint: str, bucket_secs: int = DEFAULT_BUCKET_SECS
) -> StreamingQuery:
    """Events per log, kind and tumbling window, whatever order logs and lines come in.

    Windows are aligned to the epoch, not to the log's start, so they are not the batch
    time buckets. Counts add up, so a micro-batch only writes its own and keeps no state:
    nothing is too late to be counted. :func:`read_counters` adds the batches.
    """
    width = F.lit(bucket_secs * 1_000_000_000).cast("bigint")
    start = F.col("ts_ns") - F.pmod(F.col("ts_ns"), width)

    def save(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy("log_id", "kind", start.alias("start_ns")).agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        parse_lines(lines)
        .where(F.col("outcome") == "event")
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("log_id", "kind", "start_ns").agg(F.sum("n").alias("n"))


def read_counters(spark: SparkSession, out: str) -> DataFrame:
    return _added(read_parts(spark, out)).select(
        "log_id", "kind", F.timestamp_micros(F.call_function("div", F.col("start_ns"), F.lit(1000).cast("bigint"))).alias("start"), "n"
    )


def compact_counters(spark: SparkSession, out: str) -> None:
    """Add up all finished batches in place; the stream may go on meanwhile."""
    compact_parts(spark, out, _added)


def stream_slots(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep slot records up to date, first arrival wins across micro-batches.

    A micro-batch only writes its own partial records, with the arrival position of
    every field, so its cost does not depend on what was seen before. A batch that is
    retried overwrites its own folder. :func:`read_slots` merges the parts.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        parts = fold_slots(slot_input(batch), keep_seq=True)
        parts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        parse_lines(lines)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_slots(spark: SparkSession, out: str) -> DataFrame:
    """The slot table as of the last finished micro-batch."""
    return slot_columns(merge_slots(read_parts(spark, out)))


def compact_slots(spark: SparkSession, out: str, target: str | None = None) -> None:
    """Merge all parts into one: in place, while the stream goes on, or as a copy in ``target``."""
    if target is None:
        compact_parts(spark, out, merge_slots)
    else:
        merge_slots(read_parts(spark, out)).write.mode("overwrite").parquet(f"{target}/batch=0")


def _folders(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Finished folders ``<prefix>=<n>`` under ``path`` by their number."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place(path)):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(place(path))]
    found = {int(n.split("=")[1]): f"{path}/{n}" for n in names if n.startswith(f"{prefix}=")}
    return {n: p for n, p in found.items() if fs.exists(place(f"{p}/_SUCCESS"))}


def _live(spark: SparkSession, out: str) -> tuple[int, list[str]]:
    """The last batch that the newest compaction holds, and the folders that make up the table."""
    merged, batches = _folders(spark, f"{out}/_compact", "upto"), _folders(spark, out, "batch")
    upto = max(merged, default=-1)
    return upto, [merged[n] for n in merged if n == upto] + [p for n, p in sorted(batches.items()) if n > upto]


def read_parts(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all finished batches, compacted or not."""
    return spark.read.parquet(*_live(spark, out)[1])


def compact_parts(spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge all finished batches into one folder, in place.

    The merged folder counts from the moment its success marker is there. What it
    replaces is kept until the next compaction, so a reader that listed the folders
    before still finds every file; only what the compaction before had replaced goes now.
    A batch that is retried later is one the merged folder holds already.
    """
    batches, merged = _folders(spark, out, "batch"), _folders(spark, f"{out}/_compact", "upto")
    upto, paths = _live(spark, out)
    last = max(batches, default=-1)
    if last <= upto:
        return
    merge(spark.read.parquet(*paths)).write.mode("overwrite").parquet(f"{out}/_compact/upto={last}")
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(out).getFileSystem(spark._jsc.hadoopConfiguration())
    for path in [p for n, p in batches.items() if n <= upto] + [p for n, p in merged.items() if n < upto]:
        fs.delete(place(path), True)
