"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

Sections end at blank lines, paragraphs at line ends; a paragraph is cut into pieces, at
sentence ends or after ``PIECE`` code points, so that an edit inside a long paragraph
changes few leaves. Equal roots mean equal texts; where roots differ, the branches that
differ locate the edit. A fingerprint is written as ``root|tree``: sections parted by
``;``, paragraphs by ``/``, leaves by ``,`` (the low ``LEAF_HEX`` hex digits of each).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.llm.common import stage, sums_before, table, text_of

PIECE = 64
LEAF_HEX = 12
LEAVES = rf"[^\n.!?]{{1,{PIECE}}}[.!?]*|[.!?]{{1,{PIECE}}}"


def tree(text: Column) -> Column:
    """``array<array<array<bigint>>>``: leaf hashes by section and paragraph."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAVES), F.lit(0)), lambda x: F.xxhash64(x))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def _written(tree_: Column, leaf) -> Column:
    paragraph = lambda p: F.array_join(F.transform(p, leaf), ",")
    return F.array_join(
        F.transform(tree_, lambda s: F.array_join(F.transform(s, paragraph), "/")), ";"
    )


def root(tree_: Column) -> Column:
    """Hash of the section hashes, each a hash of its paragraph hashes."""
    paragraph = lambda p: F.coalesce(F.xxhash64(p), F.lit(0))
    sections = F.transform(tree_, lambda s: F.md5(F.array_join(F.transform(s, lambda p: F.hex(paragraph(p))), "/")))
    return F.sha2(F.array_join(sections, ";"), 256)


def fingerprint(tree_: Column) -> Column:
    short = lambda x: F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(LEAF_HEX)))
    return F.concat(root(tree_), F.lit("|"), _written(tree_, short))


def all_leaves(tree_: Column) -> Column:
    """The leaves as a fingerprint shows them, in order."""
    low = F.lit((1 << 4 * LEAF_HEX) - 1).cast("bigint")
    return F.transform(F.flatten(F.flatten(tree_)), lambda x: x.bitwiseAND(low))


def numbered(leaves: Column, label: Callable[[Column, Column], Column] = F.xxhash64) -> Column:
    """A hash (or ``label``) of each leaf and its number of occurrence, so that sets of them compare as all leaves do."""
    # Arrays of one element bind what is used for every leaf, so that it is computed once.
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    opens = lambda s: F.filter(
        F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull()
    )
    run = lambda s, at, end: F.transform(F.sequence(at, end - 1), lambda i: label(F.get(s, at), i - at))
    runs = lambda s: bound(
        opens(s), lambda o: F.flatten(F.transform(o, lambda at, j: run(s, at, F.coalesce(F.get(o, j + 1), F.size(s)))))
    )
    return bound(F.array_sort(leaves), runs)


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots, else the Dice share of common leaves: distinct ones or, if numbered, all."""
    both = F.size(leaves_a) + F.size(leaves_b)
    dice = 2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / both
    return F.when(root_a == root_b, 1.0).when(both == 0, 0.0).otherwise(dice)


def changed_sections(tree_a: Column, tree_b: Column) -> Column:
    """Numbers (from 0) of the sections of ``tree_b`` that ``tree_a`` has nowhere."""
    at = F.transform(tree_b, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    return F.transform(F.filter(at, lambda x: ~F.array_contains(tree_a, x["s"])), lambda x: x["i"])


def _key(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("k"),
        F.xxhash64(text).alias("h"),
        F.length(text).cast("bigint").alias("n_chars"),
        text.alias("text"),
    )


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` rows with the start and the leaves of the next document's text.

    Next is by ascending doc_id (null first), then a hash of the text; after the last
    comes the first. Rows with equal doc_id and text are one document and share a
    successor. Order is found on narrow rows, range by range; a successor sends only
    the part of its text that is asked for and its leaf hashes.
    """
    rows = _key(docs)
    narrow = rows.groupBy("k", "h", "n_chars").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    order = [F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("h"), F.col("n_chars")]
    placed = stage(sums_before(narrow, order, {}, "merkle-order"), "merkle-placed")
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("copies")).first()
    a = placed.select(
        "doc_id",
        F.col("k").alias("for_k"),
        F.col("h").alias("for_h"),
        (F.col("n_chars") / 2).cast("bigint").alias("want"),
        ((F.col("pos") + 1) % max(size["n"], 1)).alias("pos"),
    )
    links = stage(a.join(placed.select("pos", "k", "h"), "pos").drop("pos"), "merkle-links")
    # Repeated rows, where there are any, must send only once.
    texts = rows.select("k", "h", "text")
    senders = texts if (size["copies"] or 0) <= 1 else texts.dropDuplicates(["k", "h"])
    sent = senders.join(links, ["k", "h"])
    t = tree(F.col("text"))
    sent = sent.select(
        F.col("for_k").alias("k"),
        F.col("for_h").alias("h"),
        "doc_id",
        F.substr("text", F.lit(1), F.col("want").cast("int")).alias("next_start"),
        root(t).alias("next_root"),
        all_leaves(t).alias("next_leaves"),
    )
    # Both joins take the same columns of the texts, so that one shuffle of them serves both.
    return texts.join(sent, ["k", "h"]).withColumn("n_chars", F.length("text").cast("bigint"))


def op7_merkle(spark, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    half = F.floor(F.col("n_chars") / 2)
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("next_start"))
    trees = rows.withColumn("edited", edited).withColumns({"t": tree(F.col("text")), "e": tree(F.col("edited"))})
    printed = trees.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("t")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"),
        all_leaves(F.col("t")).alias("l"),
        all_leaves(F.col("e")).alias("el"),
        "next_root",
        "next_leaves",
    )
    root_of = lambda c: F.substring_index(c, "|", 1)
    shares = lambda leaves, root_b: likeness(root_of("fingerprint"), numbered(F.col("l")), root_b, numbered(F.col(leaves)))
    return printed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        shares("el", root_of("edited_fingerprint")).alias("near_edited"),
        shares("next_leaves", F.col("next_root")).alias("near_next"),
    )
