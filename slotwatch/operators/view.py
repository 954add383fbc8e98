"""Display projection of the slot table, its filters and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.functions import classify as C
from slotwatch.operators.ordered import rank_within

PLACE_BLOCK = 1 << 17  # places of a log that lie in one folder of a place index


def _band(start: str, end: str, warn: float, bad: float) -> Column:
    ms = C.delta_us(start, end) / F.lit(1000.0)
    return F.when(ms.isNotNull(), C.band_lower_better(ms, warn, bad))


def slot_view(slots: DataFrame) -> DataFrame:
    """Status, votes, path and latencies of each slot, ready for display."""
    status = C.slot_status()

    def ms(a: str, b: str) -> Column:
        return C.delta_us(a, b) / F.lit(1000.0)

    return slots.select(
        "log_id",
        "slot",
        status.alias("status"),
        C.status_label(status).alias("status_label"),
        "skip_classification",
        C.path_label(status).alias("path"),
        "fast_finalize",
        "we_are_leader",
        ms("first_shred_ns", "block_emitted_ns").alias("assembly_ms"),
        ms("block_emitted_ns", "finalized_ns").alias("consensus_ms"),
        C.consensus_inverted().alias("consensus_inverted"),
        ms("first_shred_ns", "finalized_ns").alias("lifecycle_ms"),
        C.delta_us("setting_root_ns", "new_root_ns").alias("root_pruning_us"),
        _band("first_shred_ns", "block_emitted_ns", C.ASSEMBLY_WARN_MS, C.ASSEMBLY_BAD_MS).alias("assembly_band"),
        _band("first_shred_ns", "finalized_ns", C.LIFECYCLE_WARN_MS, C.LIFECYCLE_BAD_MS).alias("lifecycle_band"),
        C.vote_pattern().alias("vote_pattern"),
        C.event_tags().alias("event_tags"),
        F.col("timeout_crashed_leader_ns").isNotNull().alias("crashed_leader"),
        F.col("safe_to_notar_ns").isNotNull().alias("safe_to_notar"),
        F.col("safe_to_skip_ns").isNotNull().alias("safe_to_skip"),
    )


def filter_slots(
    view: DataFrame,
    tcl: bool = False,
    s2n: bool = False,
    s2s: bool = False,
    leader: bool = False,
    fast_only: bool = False,
    slow_only: bool = False,
    vskip_only: bool = False,
    canonical_skip_only: bool = False,
) -> DataFrame:
    """Rows that satisfy every flag set; the two skip flags are alternatives."""
    keep: list[Column] = []
    if tcl:
        keep.append(F.col("crashed_leader"))
    if s2n:
        keep.append(F.col("safe_to_notar"))
    if s2s:
        keep.append(F.col("safe_to_skip"))
    if leader:
        keep.append(F.col("we_are_leader"))
    if fast_only:
        keep.append(F.col("status") == "fast")
    if slow_only:
        keep.append(F.col("status") == "slow")
    labels = [l for on, l in ((vskip_only, "VSKIP"), (canonical_skip_only, "CSKIP")) if on]
    if labels:
        keep.append(F.col("status_label").isin(*labels))
    for test in keep:
        view = view.where(test)
    return view


def page_at(placed: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows at places ``offset`` + 1 to ``offset`` + ``limit`` of each log."""
    return placed.where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def page(df: DataFrame, offset: int, limit: int, levels: list[list[Column]], leaf: list[Column]) -> DataFrame:
    """The visible slice of each log's list. Places are counted range by range, so a deep
    page skips nothing through one task (see :func:`rank_within`)."""
    return page_at(rank_within(df, ["log_id"], levels, leaf, "place"), offset, limit)


def place_index(placed: DataFrame, block: int = PLACE_BLOCK) -> DataFrame:
    """``placed`` laid out for pages: to be written in folders by ``place_block``, each with its places in order.

    A block of one log is a file of its own unless blocks are small, and its row groups carry
    the bounds of their places.
    """
    blocks = placed.withColumn("place_block", F.call_function("div", F.col("place") - 1, F.lit(block).cast("bigint")))
    return blocks.repartition("place_block", "log_id").sortWithinPartitions("place_block", "log_id", "place")


def indexed_page(index: DataFrame, offset: int, limit: int, block: int = PLACE_BLOCK) -> DataFrame:
    """A page from a stored place index: only the folders that hold its places are opened."""
    first, last = offset // block, (offset + max(limit, 1) - 1) // block
    return page_at(index.where(F.col("place_block").between(first, last)), offset, limit).drop("place_block")


def slot_durations(slots: DataFrame) -> DataFrame:
    """First-shred to first-shred time of directly adjacent slots.

    Slot n meets slot n+1 by an equi join on (log, slot), so nothing is sorted per log.
    """
    shreds = slots.where(F.col("first_shred_ns").isNotNull()).select("log_id", "slot", "first_shred_ns")
    after = shreds.select(
        "log_id", (F.col("slot") - 1).alias("slot"), F.col("first_shred_ns").alias("_next_ns")
    )
    # The first shred is also what places a slot in time, so the pair lies inside a
    # time window exactly when both of these do.
    return (
        shreds.join(after, ["log_id", "slot"])
        .select(
            "log_id",
            "slot",
            C.delta_us("first_shred_ns", "_next_ns").alias("duration_us"),
            F.least("first_shred_ns", "_next_ns").alias("from_ns"),
            F.greatest("first_shred_ns", "_next_ns").alias("to_ns"),
        )
        .where(F.col("duration_us").isNotNull())
    )
