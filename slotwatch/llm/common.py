"""Helpers shared by the corpus operators: tables, words, staging, ordered sums."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwatch.session import fresh_path, prepare

WORD = r"[^\x20\x09-\x0D]+"  # a word is a run of anything but ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: losing an executor later costs a file read, not a recomputation,
    and every reader sees the same rows whatever was retried.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """``df`` as one column ``row`` beside ``extra`` ones, so that no name of its can clash with them."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(row, *[c.alias(name) for name, c in extra.items()])


def id_key(column: str) -> Column:
    """An id as text for joins, null included."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def sums_before(df: DataFrame, order: list[Column], sums: Mapping[str, Column], label: str) -> DataFrame:
    """Add ``pos`` (rank from 0 in ``order``) and, for each name, the sum over all earlier rows.

    Rows are range-partitioned and each range is summed on its own; one row of totals
    per range is carried forward, so no task sees more than its range.
    """
    part, keep = "_part", list(df.columns)
    ranged = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    names = [f"_o{i}" for i in range(len(order))]
    ranged = ranged.withColumns(dict(zip(names, order)))
    ranged = stage(ranged.repartitionByRange(*names).withColumn(part, F.spark_partition_id()), label)
    totals = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # One row per range: at most the number of shuffle partitions.
    over_parts = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        part,
        F.coalesce(F.sum("_n").over(over_parts), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_t_{n}").over(over_parts), F.lit(0)).alias(f"_t_{n}") for n in sums],
    )
    inside = Window.partitionBy(part).orderBy(*names)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns(
        {
            "_r": F.row_number().over(inside) - 1,
            **{f"_b_{n}": F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)) for n in sums},
        }
    )
    joined = local.join(F.broadcast(carried), part)
    return joined.select(
        *keep,
        (F.col("_n") + F.col("_r")).cast("bigint").alias("pos"),
        *[(F.col(f"_b_{n}") + F.col(f"_t_{n}")).alias(n) for n in sums],
    )
