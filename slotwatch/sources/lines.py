"""Log files as ``lines[log_id, seq, line]`` with an explicit arrival order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwatch.operators.sizing import join_small
from slotwatch.session import prepare

# A position is 40 bits inside a file and 23 bits of the file's rank; both are checked.
FILE_BITS = 40
MAX_FILE_BYTES = 1 << 38
MAX_FILES = 1 << 23  # of one log


def position_in_file() -> Column:
    """Arrival position of a line inside its file, from the scan alone.

    ``monotonically_increasing_id`` numbers the lines of one scan task. Twice the byte
    offset of the split leaves more room than the split has lines (a line has at least
    one byte), so positions of later splits are always higher. Only a file's last
    split can share a task with other files, and there a larger number is harmless.
    """
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") * 2 + row_in_task


def read_log_lines(
    spark: SparkSession,
    paths: str | list[str],
    log_id: Callable[[Column], Column] | None = None,
    file_order: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Read text logs: ``[log_id, seq, line, file_path, file_size]``.

    ``log_id`` maps a file path (as a URI) to its log; by default every file is a log of its own.
    Where a log spans several files, ``file_order`` maps a path to its place in the log
    (default: the path). Lines end with a newline; one carriage return before it is
    dropped, and lone carriage returns stay in the line.
    """
    prepare(spark)
    raw = (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            F.when(F.endswith(F.col("value"), F.lit("\r")), F.expr("left(value, length(value) - 1)"))
            .otherwise(F.col("value"))
            .alias("line"),
            # The same spelling of a path as in the driver's file listing below.
            F.input_file_name().alias("file_path"),
            F.col("_metadata.file_size").alias("file_size"),
            F.when(F.col("_metadata.file_size") <= MAX_FILE_BYTES, position_in_file())
            .otherwise(F.raise_error(F.concat(F.lit("log file too large, split it: "), F.col("_metadata.file_path"))))
            .alias("_pos"),
        )
    )
    if log_id is None:
        return raw.select(F.col("file_path").alias("log_id"), F.col("_pos").alias("seq"), "line", "file_path", "file_size")
    # The file listing is what the driver planned the scan from; it gives each file a
    # place in its log before any line is read.
    path = F.col("file_path")
    listing = spark.createDataFrame([(f,) for f in raw.inputFiles()], "file_path string")
    order = file_order(path) if file_order is not None else path
    place = F.row_number().over(Window.partitionBy("log_id").orderBy(order, path)) - 1
    ranks = listing.select("file_path", log_id(path).alias("log_id"), order.alias("_order")).select(
        "file_path", "log_id", place.cast("bigint").alias("_rank")
    )
    # A file that the listing does not name, or one too many for the position, is an
    # error and never a lost file or a position that wraps around.
    rank = (
        F.when(F.col("_rank").isNull(), F.raise_error(F.concat(F.lit("file not in the listing: "), path)))
        .when(F.col("_rank") >= MAX_FILES, F.raise_error(F.concat(F.lit("too many files in one log: "), F.col("log_id"))))
        .otherwise(F.col("_rank"))
    )
    return join_small(raw, ranks, ["file_path"], "left").select(
        F.coalesce("log_id", F.lit("")).alias("log_id"),
        (F.shiftleft(rank, FILE_BITS) + F.col("_pos")).alias("seq"),
        "line",
        "file_path",
        "file_size",
    )


def file_columns() -> list[Column]:
    """What a text scan must carry along for :func:`numbered_lines`."""
    return [
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("_start"),
    ]


def numbered_lines(
    batch: DataFrame,
    log_id: Callable[[Column], Column] | None = None,
    file_number: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``lines[log_id, seq, line]`` of one micro-batch of a text stream, straight from its scan."""
    path = F.col("file_path")
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    number = file_number(path).cast("bigint") if file_number is not None else F.lit(0).cast("bigint")
    number = F.when((number >= 0) & (number < MAX_FILES) & (F.col("file_size") <= MAX_FILE_BYTES), number).otherwise(
        F.raise_error(F.concat(F.lit("file number or size out of range: "), path))
    )
    value = F.col("value")
    return batch.select(
        (log_id(path) if log_id is not None else path).alias("log_id"),
        (F.shiftleft(number, FILE_BITS) + F.col("_start") * 2 + row_in_task).alias("seq"),
        F.when(F.endswith(value, F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(value).alias("line"),
    )


def file_meta(lines: DataFrame) -> DataFrame:
    """Files, bytes and lines per log, for lines that came from files."""
    files = lines.groupBy("log_id", "file_path").agg(
        F.max("file_size").alias("_size"), F.count(F.lit(1)).alias("_lines")
    )
    return files.groupBy("log_id").agg(
        F.min("file_path").alias("path"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("_size").alias("size_bytes"),
        F.sum("_lines").alias("line_count"),
    )
