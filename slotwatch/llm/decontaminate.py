"""Benchmark decontamination: SimHash over item-sized windows of documents.

A window is as long as a benchmark item. Its place is set by a shared five-word shingle
near the item's start: windows at similarity 0.75 share all but a seventh of the item's
shingles, so one of the first ``slack`` shingles is always among the shared ones, and
windows a few words to either side are taken as well. Windows and items of one length meet
by multi-index SimHash: two independent fingerprints of 64 bits, each in four blocks of 16. Of two
fingerprints at most ``RADIUS`` bits apart some block differs in at most ``FLIPS``, and the index holds
every item under all such changes of each block, so none within the radius is missed. A window
at similarity 0.75 shares six sevenths of the item's words, each repetition a word of its
own; one fingerprint of it is beyond the radius in up to 4 % of cases, both are in 0.2 %.
What is found is verified by the exact similarity of shingles weighted by how often they occur.

Only what comes from the benchmark alone is broadcast, and bit maps of a fixed size. What grows with the
documents is shuffled: texts are screened by a bit map of the documents that have windows, or are
contaminated, so that few others are shuffled with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.llm.common import id_key, packed, stage, table, text_of, words
from slotwatch.llm.merkle import numbered
from slotwatch.operators.sizing import fits_broadcast, join_small

SHINGLE = 5
SIMILAR = 0.75
RADIUS = 15
SHIFTS = 2  # words to either side of the place the shared shingle gives
PRINTS = ("fp0", "fp1")
BLOCKS, BLOCK_BITS = 4, 16
FLIPS = RADIUS // BLOCKS
CHANGES = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= FLIPS]  # of one block
MAP_BITS, PIECE_BITS = 25, 15  # a bit map of keys is 4 MB in pieces of 4 KB, the size of bitmap_construct_agg
SHINGLES_MAX_BYTES = 8 << 20  # of the items' shingles, to be broadcast


def tokens(text: Column) -> Column:
    return words(F.lower(text))


def _gram_hashes(w: Column, k: int) -> Column:
    """Hash of every run of ``k`` words."""
    at = F.sequence(F.lit(1), F.size(w) - (k - 1))
    grams = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(k)]))
    return F.when(F.size(w) >= k, grams)


def weighted_shingles(w: Column) -> Column:
    """Five-word shingles, each with its number of occurrence, so that sets of them compare as
    weighted sets do; fewer words are one shingle, no words none."""
    grams = F.when(
        F.size(w) > SHINGLE,
        F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")),
    ).otherwise(F.array(F.array_join(w, " ")))
    return numbered(grams, lambda g, i: F.concat_ws("#", g, i))


def similarity(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def simhash(rows: DataFrame, keys: list[str], w: str) -> DataFrame:
    """``keys`` plus two fingerprints: each bit by the majority of the hashes of all words in ``w``, repeated ones numbered."""
    first = F.explode(numbered(F.transform(w, lambda x: F.xxhash64(x)))).alias("_h0")
    hashed = rows.select(*keys, first).withColumn("_h1", F.xxhash64("_h0"))
    # A sum counts two bits at once, 32 places apart; no array has more words than 32 bits count.
    pair = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftright(f"_h{i}", b).bitwiseAND(pair)).alias(f"_s{i}_{b}") for i in range(len(PRINTS)) for b in range(32)]
    votes = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums)

    def majority(i: int) -> Column:
        fp = F.lit(0).cast("bigint")
        for b in range(64):
            s = F.col(f"_s{i}_{b % 32}")
            count = F.shiftright(s, 32) if b >= 32 else s.bitwiseAND(F.lit((1 << 32) - 1))
            bit = F.shiftleft(F.lit(1).cast("bigint"), b)
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("_n"), bit).otherwise(F.lit(0).cast("bigint")))
        return fp

    return votes.select(*keys, *[majority(i).alias(fp) for i, fp in enumerate(PRINTS)])


def _blocks() -> Column:
    part = lambda fp, b: F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(i * BLOCKS + b).alias("block"), part(fp, b).alias("bits"))
                for i, fp in enumerate(PRINTS)
                for b in range(BLOCKS)
            ]
        )
    )


def near_items(prints: DataFrame, items: DataFrame) -> DataFrame:
    """``[n, fp0, fp1, item_id]``: all items of length ``n`` of which a fingerprint is within ``RADIUS``.

    ``prints`` are distinct ``[n, fp0, fp1]``; ``items`` have item_id besides.
    """
    index = items.select("item_id", "n", *[F.col(fp).alias(f"item_{fp}") for fp in PRINTS], _blocks())
    index = index.withColumn("change", F.explode(F.lit(CHANGES))).withColumn("bits", F.col("bits").bitwiseXOR(F.col("change")))
    # The index has thousands of rows an item, which Spark's estimate does not see: never broadcast.
    found = prints.select("n", *PRINTS, _blocks()).hint("merge").join(index.drop("change"), ["n", "block", "bits"])
    within = [F.bit_count(F.col(fp).bitwiseXOR(F.col(f"item_{fp}"))) <= RADIUS for fp in PRINTS]
    return found.where(within[0] | within[1]).select("n", *PRINTS, "item_id").distinct()


def screened(rows: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` plus ``_maybe``: false only where ``marked`` has no row of the same ``keys`` (none of them null).

    Keys are looked up in a bit map of their hashes, which is broadcast and never larger than
    2^``MAP_BITS`` bits, however many there are.
    """
    place = F.shiftrightunsigned(F.xxhash64(*keys), 64 - MAP_BITS)
    piece = F.shiftright(place, PIECE_BITS).alias("_piece")
    bit = place.bitwiseAND(F.lit((1 << PIECE_BITS) - 1)).alias("_bit")
    bits = marked.select(piece, bit).repartition("_piece").groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.col("_bit").bitwiseAND(F.lit(7)).cast("int")) == 1
    found = rows.withColumns({"_piece": piece, "_bit": bit}).join(F.broadcast(stage(bits, "bench-bits")), "_piece", "left")
    return found.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias("_maybe"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``[doc_id, h, item_id, start, n, similarity]``: all windows that are similar to an item, ``h``
    being a hash of the document's text."""
    spark = docs.sparkSession
    item = stage(
        items.select("item_id", tokens(text_of()).alias("w"))
        .where(F.size("w") > 0)
        .distinct()
        .withColumns({"n": F.size("w"), "k": F.least(F.size("w"), F.lit(SHINGLE))}),
        "bench-items",
    )
    lengths = [r["k"] for r in item.select("k").distinct().collect()]  # at most five values
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), tokens(F.col("text")).alias("w"))
    hits = None
    for k in sorted(lengths):
        slack = F.floor((F.col("n") - (k - 1)) * (1 - 2 * SIMILAR / (1 + SIMILAR))).cast("int")
        seeds = (
            item.where(F.col("k") == k)
            .select("n", slack.alias("slack"), F.posexplode(_gram_hashes(F.col("w"), k)).alias("offset", "gram"))
            .where("offset <= slack")
            .select("gram", "offset", "n")
            .distinct()
        )
        grams = rows.select("doc_id", "h", F.size("w").alias("size"), F.posexplode(_gram_hashes(F.col("w"), k)).alias("at", "gram"))
        found = join_small(grams, stage(seeds, "bench-seeds"), ["gram"])
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], "doc_id bigint, h bigint, item_id bigint, start int, n int, similarity double")
    shift = F.explode(F.sequence(F.lit(-SHIFTS), F.lit(SHIFTS))).alias("shift")
    placed = hits.select("doc_id", "h", "size", "n", (F.col("at") - F.col("offset")).alias("start"), shift)
    last = F.greatest(F.col("size") - F.col("n"), F.lit(0))
    windows = stage(
        placed.select("doc_id", "h", "n", F.least(F.greatest(F.col("start") + F.col("shift"), F.lit(0)), last).alias("start")).distinct(),
        "bench-windows",
    )
    # Few documents have windows; their texts are read again rather than carried along.
    wanted = windows.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "n")).alias("windows"))
    wanted = stage(wanted.select(id_key("doc_id").alias("_k"), "h", "windows"), "bench-wanted")
    texts = docs.select("doc_id", text_of().alias("text"), id_key("doc_id").alias("_k")).withColumn("h", F.xxhash64("text"))
    texts = screened(texts, wanted, ["_k", "h"]).where("_maybe").hint("merge").join(wanted, ["_k", "h"])
    texts = texts.select("doc_id", "_k", "h", tokens(F.col("text")).alias("w"), F.explode("windows").alias("x"))
    cut = stage(
        texts.select("doc_id", "_k", "h", F.col("x.start").alias("start"), F.col("x.n").alias("n"), F.slice("w", F.col("x.start") + 1, F.col("x.n")).alias("w"))
        .dropDuplicates(["_k", "h", "start", "n"]),
        "bench-cut",
    )
    ids = ["_k", "h", "start", "n"]
    prints = stage(simhash(cut, ids, "w"), "bench-prints")
    near = stage(near_items(prints.select("n", *PRINTS).distinct(), simhash(item, ["item_id", "n"], "w")), "bench-near")
    # A print that many windows share makes a skewed partition, which adaptive execution splits.
    pairs = prints.hint("merge").join(near, ["n", *PRINTS]).select(*ids, "item_id")
    shingled = stage(item.select("item_id", "n", weighted_shingles(F.col("w")).alias("item_shingles")), "bench-shingles")
    both = pairs.hint("merge").join(cut, ids)
    if fits_broadcast(shingled, max_bytes=SHINGLES_MAX_BYTES):
        both = both.join(F.broadcast(shingled), ["item_id", "n"])
    else:
        both = both.hint("merge").join(shingled, ["item_id", "n"])
    scored = both.select(
        "doc_id", "h", "item_id", "start", "n", similarity(weighted_shingles(F.col("w")), F.col("item_shingles")).alias("similarity")
    )
    return scored.where(F.col("similarity") >= SIMILAR)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``[doc_id, item_id, similarity, first_word, n_words]``: the best window of each pair.

    Pairs at similarity ``SIMILAR`` or more between a benchmark item and an item-sized
    window anywhere in the text. Null and empty texts, of documents and items, match
    nothing. Repeated document rows give their pairs once; items with equal texts are
    all named. Ties take the earliest window. Other columns are ignored; empty tables
    give no pairs.
    """
    best = F.max_by(F.struct("similarity", "start", "n"), F.struct("similarity", -F.col("start"), -F.col("n"))).alias("best")
    return matches(docs, items).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        F.col("best.similarity").alias("similarity"),
        F.col("best.start").alias("first_word"),
        F.col("best.n").alias("n_words"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item, told by doc_id (also null) and text."""
    bad = matches(docs, items).select(id_key("doc_id").alias("k"), "h").distinct()
    bad = stage(bad, "bench-bad")
    rows = screened(packed(docs, k=id_key("doc_id"), h=F.xxhash64(text_of())), bad, ["k", "h"])
    doubted = rows.where("_maybe").hint("merge").join(bad, ["k", "h"], "left_anti")
    return rows.where("not _maybe").select("row.*").unionByName(doubted.select("row.*"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
