"""Joins against a small side whose size is checked, not assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20
MIN_SALTS, MAX_SALTS = 8, 256


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes; text and nested columns by their length."""
    total = F.lit(16)
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind == "string" or kind == "binary":
            total = total + F.coalesce(F.octet_length(col), F.lit(0)) + 8
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0))
        else:
            total = total + 16
    return total


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether ``small`` has at most ``max_rows`` rows and ``max_bytes`` bytes; reads no more rows than that."""
    head = small.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(small)).alias("b")).first()
    return head["n"] <= max_rows and (head["b"] or 0) <= max_bytes


def salts(df: DataFrame) -> int:
    """As many as there are shuffle partitions, within bounds: a key may hold most rows."""
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MIN_SALTS), MAX_SALTS)


def join_small(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_MAX_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Join ``big`` (left) with a per-key table that is usually small.

    Up to ``max_rows`` rows the small side is broadcast and ``big`` is not shuffled.
    Beyond that both sides are shuffled on the keys plus a salt, so that a key holding
    a large share of ``big`` is spread over many tasks. ``how`` is inner or left.
    ``sized_by`` is a table with at least as many rows, of at least their size, that is cheaper to
    count (a stored one), so that checking the size does not compute ``small`` twice.
    """
    if fits_broadcast(small if sized_by is None else sized_by, max_rows):
        return big.join(F.broadcast(small), keys, how)
    # A hash of the whole row, not a row number: a retried task must salt alike.
    n = salts(big)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(n)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    # Spark's estimate does not see the copies and may take them for a table to broadcast: never do.
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")
