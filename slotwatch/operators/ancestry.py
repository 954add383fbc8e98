"""Skip votes that landed on canonical slots, proven by the parent chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from slotwatch.session import fresh_path

STEP_ROUNDS = 4  # hops walked one by one before hops are doubled


def _written(df: DataFrame, label: str, count: Column) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder and read back, and a count taken while it was written."""
    spark, seen = df.sparkSession, Observation()
    path = fresh_path(spark, f"ancestry-{label}")
    df.observe(seen, count.alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get.get("n") or 0


def canonical_ancestors(slots: DataFrame) -> DataFrame:
    """``[log_id, slot]``: slots not finalized themselves but on a finalized chain.

    Every finalized slot starts a walk, so only the hops between slots that are not
    finalized need a loop. Each of the first rounds steps from what the round before
    reached, less what was reached already, so it costs what is new. Runs longer than
    ``STEP_ROUNDS`` go on by doubled hops over the slots that are still open, N slots in about
    log2(N) rounds. A round is one write, which also counts what it marks; one that
    marks nothing new ends the loop, so parent cycles are harmless. Marks are distinct:
    a parent with very many children is carried once.
    """
    key, each = ["log_id", "slot"], F.count(F.lit(1))
    is_final = F.col("finalized_ns").isNotNull()
    open_slots = slots.where(~is_final).select(*key, "parent_slot")
    keys = open_slots.select(*key)
    starts = slots.where(is_final & F.col("parent_slot").isNotNull()).select("log_id", F.col("parent_slot").alias("slot"))
    front, fresh = _written(starts.distinct().join(keys, key), "front", each)
    if not fresh:
        return front
    hops, n_hops = _written(
        open_slots.where(F.col("parent_slot").isNotNull())
        .select(*key, F.col("parent_slot").alias("target"))
        .join(keys.withColumnRenamed("slot", "target"), ["log_id", "target"])
        .select(*key, "target"),
        "hops",
        each,
    )
    if not n_hops:
        return front
    seen = before = front
    for _ in range(STEP_ROUNDS):
        before = seen
        reached = front.join(hops, key).select("log_id", F.col("target").alias("slot")).distinct()
        front, fresh = _written(reached.join(seen, key, "left_anti"), "front", each)
        if not fresh:
            return seen
        seen = seen.unionByName(front)
    # ``before`` has been stepped from; what is left starts at the front.
    state = (
        keys.join(before, key, "left_anti")
        .join(hops, key, "left")
        .join(front.withColumn("_front", F.lit(True)), key, "left")
        .select(*key, "target", F.col("_front").isNotNull().alias("marked"))
    )
    state, _ = _written(state, "state", each)
    while fresh:
        targets = F.col("target").isNotNull()
        met = state.where(F.col("marked") & targets).select("log_id", F.col("target").alias("slot")).distinct()
        onward = state.where(targets).select("log_id", F.col("slot").alias("target"), F.col("target").alias("_far"))
        doubled = (
            state.join(met.withColumn("_met", F.lit(True)), key, "left")
            .join(onward, ["log_id", "target"], "left")
            .select(*key, F.col("_far").alias("target"), F.col("marked"), (~F.col("marked") & F.col("_met").isNotNull()).alias("_new"))
        )
        state, fresh = _written(doubled, "state", F.count_if("_new"))
        state = state.select(*key, "target", (F.col("marked") | F.col("_new")).alias("marked"))
    return before.unionByName(state.where("marked").select(*key))


def classify_skips(slots: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Slot table with ``skip_classification``."""
    marks = ancestors.select("log_id", "slot", F.lit(True).alias("_marked"))
    cls = (
        F.when(F.col("voted_skip_ns").isNull(), "not_skipped")
        .when(F.col("finalized_ns").isNotNull(), "canonical_direct")
        .when(F.col("_marked"), "canonical_ancestry")
        .otherwise("indeterminate")
    )
    return (
        slots.join(marks, ["log_id", "slot"], "left")
        .withColumn("skip_classification", cls)
        .drop("_marked")
    )
