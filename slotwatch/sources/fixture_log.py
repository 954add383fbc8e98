"""A validator log rendered from the ``events`` table.

There is no validator log among the given tables, so the lines are derived from their
rows: every event row becomes one slot's worth of log lines. The rules are integer
arithmetic on the row's columns, so an SQL engine can compute the expected analytics
from the columns alone, without ever seeing the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwatch.operators import parse as P

FIRST_SLOT = 1_000_000
COMPRESSED_START_US = 1_704_067_200_000_000
NODE_KEY = "NodeKey"
LINES_PER_ID = 32  # places in the arrival order that an event's lines may take
EVENTS_PER_TASK = 50_000  # about 350,000 lines


def slot_hash(slot: Column) -> Column:
    """A 44-character Base58 text that depends on the slot."""
    letters = F.translate(slot.cast("string"), "0123456789", "ABCDEFGHJK")
    return F.rpad(F.concat(F.lit("H"), letters), 44, "z")


def log_of(event_id: Column) -> Column:
    """The log that an event's lines are in."""
    return F.concat(F.lit("log"), (event_id % 2).cast("string"))


def _base(events: DataFrame, last_slot: Column, *keep: str) -> DataFrame:
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    step = events.select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 2).alias("ln"),
        (F.lit(FIRST_SLOT) + div(F.col("event_id"), 2)).alias("slot"),
        ((F.col("event_id") * 7919 + F.col("user_id") * 31) % 997).alias("k"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("real_us"),
        F.col("user_id"),
        F.col("event_type").alias("et"),
        F.col("props"),
        *keep,
    )
    compressed = F.lit(COMPRESSED_START_US) + (F.col("slot") - FIRST_SLOT) * 1_200_000 + F.col("k") * 500
    return step.select(
        "id",
        "ln",
        "slot",
        "k",
        "user_id",
        "et",
        "props",
        *keep,
        log_of(F.col("id")).alias("log_id"),
        F.when(F.col("ln") == 0, compressed).otherwise(F.col("real_us")).alias("t"),
        (F.lit(300_000) + F.col("k") * 300).alias("a"),
        (F.lit(100_000) + F.col("k") * 600).alias("c"),
        (
            (div(F.col("slot"), 10) % 13 == 0)
            & (F.col("slot") % 10).between(F.lit(3), 3 + div(F.col("slot"), 130) % 4)
        ).alias("mute"),
        F.when(F.col("id") % 3 == 0, F.col("slot") - 2).otherwise(F.col("slot") - 1).alias("parent"),
        last_slot.alias("last_slot"),
    )


def render(events: DataFrame, last_slot: Column, *keep: str) -> DataFrame:
    """``lines[log_id, seq, line]`` for the given event rows (narrow, no shuffle), with the columns ``keep`` of
    the event. An event's lines come in the order of their ``seq``."""
    base = _base(events, last_slot, *keep)
    c = F.col
    txt = lambda x: x.cast("string")
    slot, parent = txt(c("slot")), txt(c("parent"))
    tup = F.concat(F.lit("("), slot, F.lit(", "), c("h"), F.lit(")"))
    ptup = F.concat(F.lit("("), parent, F.lit(", "), c("ph"), F.lit(")"))
    epoch = txt(c("id") % 7 + 900)
    is_block = c("et").isin("view", "click", "purchase")
    purchase, signup, error = c("et") == "purchase", c("et") == "signup", c("et") == "error"
    t, a, cc = c("t"), c("a"), c("c")
    block_fin = is_block & (c("id") % 41 != 0)
    fin_at = F.when((c("et") == "click") & (c("id") % 11 == 0), t + a - 50_000).otherwise(t + a + cc)
    stand = c("slot") % 500

    def votor(*parts: Column | str) -> Column:
        return F.concat(F.lit(f"{NODE_KEY}: "), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def cluster(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    spec: list[tuple[int, Column, Column, str | Column, str | Column, Column]] = []

    def add(order, when, at, body, module=P.VOTOR_MODULE, level="INFO"):
        spec.append((order, when, at, level, module, body))

    add(1, (is_block & (c("id") % 37 != 0)), t, votor("First shred ", slot))
    add(1, signup, t, votor("Timeout ", slot))
    add(1, error, t, votor("TimeoutCrashedLeader ", slot))
    add(
        2,
        is_block,
        t + a - 40,
        cluster("bank frozen: ", slot, " hash: ", c("h"), " signature_count: ", txt(c("k") * 11 + 2000), " last_blockhash: x"),
        P.BANK_MODULE,
    )
    add(2, (signup | error) & ~c("mute"), t + 100, votor("Voting skip for ", slot))
    add(
        3,
        is_block | (signup & (c("id") % 4 == 0)),
        t + a,
        votor("Block ", tup, " parent ", ptup),
    )
    add(4, is_block & ~c("mute"), t + a + 7, votor("Voting notarize for ", slot, " ", c("h")))
    add(5, is_block & ~(purchase & (c("k") % 5 == 0)), t + a + 40_000, votor("Block Notarized ", tup))
    add(6, is_block, t + a + 40_002, votor("Block notar-fallback ", tup))
    add(7, is_block & ~purchase & ~c("mute"), t + a + 40_010, votor("Voting finalize for ", slot))
    add(
        8,
        block_fin | (signup & (c("id") % 5 == 0)),
        F.when(is_block, fin_at).otherwise(t + a + cc),
        votor("Finalized ", tup, " fast: ", F.when(purchase, "false").otherwise("true")),
    )
    add(9, block_fin, fin_at + 12, votor("setting root ", slot), P.ROOT_MODULE)
    add(10, block_fin, fin_at + 7_012, votor("new root ", slot), P.ROOT_MODULE)
    add(11, purchase & (c("k") % 7 == 0), t + a + 40_020, votor("SafeToNotar ", tup))
    add(11, signup & (c("k") % 6 == 0), t + a + 40_020, votor("SafeToSkip ", slot))
    add(
        12,
        error,
        t + 200,
        F.concat(
            F.when(c("k") % 4 == 0, F.lit("request failed\x1b[31m: ")).otherwise(F.lit("request failed: ")),
            c("props"),
            F.lit(" "),
            F.repeat(F.lit("é"), (c("k") % 150).cast("int")),
        ),
        F.concat(F.lit("app::mod_"), txt(c("user_id") % 5)),
        F.when(c("k") % 3 == 0, "WARN").otherwise("ERROR"),
    )
    window_end = (
        F.when(c("slot") % 64 == 0, c("slot") + 3).when(c("slot") % 320 == 5, c("slot") + 20)
    )
    add(
        13,
        window_end.isNotNull(),
        t,
        votor("ProduceWindow LeaderWindowInfo { start_slot: ", slot, ", end_slot: ", txt(window_end), ", parent_block: ", ptup, ", skip_timer: Instant }"),
    )
    add(14, stand == 100, t, votor("Extending timeouts starting at slot ", slot))
    add(14, stand.between(101, 109), t, votor("Standstill ", txt(c("slot") - stand + 100)))
    add(
        14,
        stand == 110,
        t,
        votor("Standstill initially detected at slot=", txt(c("slot") - 10), " has ended at slot=", slot, ". Ending timeout extension"),
    )
    add(15, c("id") % 53 == 0, t, cluster("No epoch_metadata record for epoch ", epoch), P.CLUSTER_SLOTS_MODULE, "ERROR")
    add(16, c("id") % 211 == 0, t, cluster("Updating epoch_metadata for epoch ", epoch), P.CLUSTER_SLOTS_PARENT_MODULE)
    add(17, c("id") % 499 == 0, t, votor("SetIdentity"))
    add(
        18,
        c("id") % 503 == 5,
        t,
        cluster("ClusterSlotsService has stopped because we have finished the alpenglow migration epoch"),
        P.CLUSTER_SLOTS_PARENT_MODULE,
    )
    add(19, c("id") % 101 == 0, t, votor("Refreshing vote Vote { slot: ", slot, " }"))
    add(20, c("id") % 61 == 0, t, votor("Triggering parent ready for slot ", slot, " with parent ", parent, " ", c("ph")))
    add(21, c("id") % 43 == 0, t + 900_000, votor("First shred ", slot))
    add(24, c("id") % 31 == 0, t, cluster("report ready"), "app::idle")
    add(25, c("id") % 223 == 0, t, cluster("Evicting epoch_metadata for epoch ", epoch), P.CLUSTER_SLOTS_PARENT_MODULE)
    add(26, c("id") % 227 == 0, t, cluster("No epoch info for slot ", slot), P.CLUSTER_SLOTS_MODULE, "ERROR")
    add(
        27,
        c("id") % 229 == 0,
        t,
        cluster("Invalid update call to ClusterSlots, can not roll time backwards!"),
        P.CLUSTER_SLOTS_MODULE,
        "WARN",
    )
    add(28, (c("ln") == 1) & (c("slot") == c("last_slot") - 20), t, votor("Extending timeouts starting at slot ", slot))

    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    # Lines that are not well-formed records: a continuation line and a bad level.
    add(22, c("id") % 50 == 0, t, F.lit("  wrapped: {1: 2}"), "app::idle", "")
    add(23, c("id") % 97 == 0, t, F.lit("  wrapped: {1: 2}"), "app::idle", "LOUD")
    records = [
        F.when(
            when,
            F.struct(
                F.lit(order).alias("ord"),
                at.alias("us"),
                lit(level).alias("level"),
                lit(module).alias("module"),
                body.alias("body"),
            ),
        )
        for order, when, at, level, module, body in sorted(spec, key=lambda s: s[0])
    ]

    rows = base.select(
        "*", slot_hash(c("slot")).alias("h"), slot_hash(c("parent")).alias("ph")
    ).select("id", "log_id", *keep, F.array(*records).alias("records"))
    # A generator interprets what it is given: the records are made before it, by compiled code.
    rows = rows.select("id", "log_id", *keep, F.inline(F.array_compact("records")))
    # Nine digits: six of the microsecond plus three that depend on the row.
    stamp = F.concat(
        F.date_format(F.timestamp_micros(c("us")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lpad(txt(c("id") % 1000), 3, "0"),
        F.lit("Z"),
    )
    gap = F.when(c("level") == "ERROR", " ").otherwise("  ")
    line = F.when(c("level") == "", c("body")).otherwise(
        F.concat(F.lit("["), stamp, F.lit(" "), c("level"), gap, c("module"), F.lit("] "), c("body"))
    )
    return rows.select("log_id", (c("id") * LINES_PER_ID + c("ord")).cast("bigint").alias("seq"), line.alias("line"), *keep)


EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "props")


def read_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """The event rows of one test-data folder, and the last slot of the second log."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENT_COLUMNS)
    # The highest odd id names the last slot of the second log.
    last = events.agg(F.max(F.when(F.col("event_id") % 2 == 1, F.col("event_id"))).alias("m")).select(
        (F.lit(FIRST_SLOT) + F.call_function("div", F.col("m"), F.lit(2))).alias("last_slot")
    )
    return events, last.scalar()


def render_tasks(events: DataFrame) -> int:
    """Tasks to render by: a core each, and more where one would get more than ``EVENTS_PER_TASK``.
    The rows are counted from the file's footer."""
    return max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // EVENTS_PER_TASK))


def fixture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered log of one test-data folder."""
    events, last_slot = read_events(spark, sf_dir)
    # A file may have fewer row groups than splits, so how many tasks get rows does not show in the plan. The compact
    # rows are spread by their place in the scan, which needs no sort and deals out equal rows as well.
    spread = events.withColumn("_row", F.monotonically_increasing_id()).repartition(render_tasks(events), "_row").drop("_row")
    return render(spread, last_slot)
