"""MinHash near-duplicate detection with tensored banding.

Each text's distinct five-word shingles get ``HALVES`` small collections of
``HALF_SIZE`` minhashes. Every pair of collections is a table key, so 20 collections of 2 give 190
tables of 4 minhashes from 40 minhashes instead of 760. Texts with equal
sets are one class from the start. A collection value that no other class shares cannot
make a shared key and is left out before keys are formed. Candidates are verified on full sets;
classes linked by verified pairs form components.

Within a table bucket classes are first compared with a centre, so a large group of copies
costs about as many comparisons as it has members. Where a bucket still holds different
components, its members are put in the frame of the bucket's centre: each is compared with
that centre and described by its differences from it, the shingles it lost or won. What two
members have in common follows from how many differences they share, and two that are not both linked
with the centre must share some. So the rest is decided by a join on differences, which near misses of
one original hardly share, and no pair that a table brings together is left undecided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwatch.llm import hashing
from slotwatch.llm.common import WORD, id_key, packed, stage, table, text_of
from slotwatch.llm.components import components
from slotwatch.operators.sizing import join_small

HALVES = 20
HALF_SIZE = 2
STAR_ROUNDS, STARS = 2, 4


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for t in batch.column("text"):
        yield (t.as_py() or "").encode().lower()


def class_keys(every: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set in ``every`` (starting ``at``), an order-free hash of it and its size."""
    mixed = hashing.mixed(every * hashing.salts(1, 22)[0])
    return hashing.mixed(np.add.reduceat(mixed, at) + sizes.astype(np.uint64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salts = hashing.salts(HALVES * HALF_SIZE, 21)
    for batch in batches:
        for first, texts in hashing.slices(_texts(batch)):
            sets = hashing.shingle_sets(texts)
            full = [i for i, s in enumerate(sets) if len(s)]
            sizes = np.array([len(sets[i]) for i in full], np.int64)
            halves = np.zeros((len(full), HALVES), np.uint64)
            keys = np.zeros(len(full), np.uint64)
            if full:
                every = np.concatenate([sets[i] for i in full])
                at = np.cumsum(sizes) - sizes
                for j, salt in enumerate(salts):
                    low = np.minimum.reduceat(hashing.mixed(every ^ salt) if j % HALF_SIZE == 0 else (every ^ salt) * salt, at)
                    halves[:, j // HALF_SIZE] = hashing.mixed(halves[:, j // HALF_SIZE] + low * salts[0])
                keys = class_keys(every, at, sizes)
            rows: list = [None] * len(texts)
            for i, k, h in zip(full, keys.view(np.int64), halves.view(np.int64)):
                rows[i] = (int(k), h)
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(first, len(texts)),
                    batch.column("h").slice(first, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([r and r[0] for r in rows], pa.int64()),
                    pa.array([r and r[1] for r in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "h", "n_shingles", "c", "halves"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the texts that are of the class they were chosen for."""
    for batch in batches:
        wanted = batch.column("c").to_pylist()
        for first, texts in hashing.slices(_texts(batch)):
            found = [
                (c, s.tobytes())
                for c, s in zip(wanted[first : first + len(texts)], hashing.shingle_sets(texts))
                if len(s) and int(class_keys(s, np.array([0]), np.array([len(s)])).view(np.int64)[0]) == c
            ]
            yield pa.record_batch(
                [pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["c", "set"]
            )


@F.pandas_udf(T.BooleanType())
def _linked(a, b):
    def one(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= 75 * (len(x) + len(y) - common)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)


def _verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs ``[a, b]`` whose full sets are similar enough; sizes are compared first."""
    sized = pairs.join(sizes.select(F.col("c").alias("a"), F.col("n_shingles").alias("na")), "a").join(
        sizes.select(F.col("c").alias("b"), F.col("n_shingles").alias("nb")), "b"
    )
    likely = sized.where(100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb")).select("a", "b")
    left = likely.join(sets.select(F.col("c").alias("a"), F.col("set").alias("sa")), "a")
    return left.join(sets.select(F.col("c").alias("b"), F.col("set").alias("sb")), "b").where(_linked("sa", "sb")).select("a", "b")


FRAMED = "c bigint, comp bigint, f bigint, n bigint, nf bigint, o bigint, diff array<bigint>"


def _in_frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each member: its size, its centre's, what both share, and the shingles that only one of them has."""
    for batch in batches:
        n, nf, o, diff = [], [], [], []
        for mine, centre in zip(batch.column("set"), batch.column("fset")):
            mine, centre = (np.frombuffer(x.as_py(), np.uint64) for x in (mine, centre))
            apart = np.setxor1d(mine, centre, assume_unique=True)
            n.append(len(mine))
            nf.append(len(centre))
            o.append((len(mine) + len(centre) - len(apart)) // 2)
            diff.append(apart.view(np.int64))
        values = [pa.array(x, pa.int64()) for x in (n, nf, o)]
        yield pa.record_batch(
            [*[batch.column(name) for name in ("c", "comp", "f")], *values, pa.array(diff, pa.list_(pa.int64()))],
            names=["c", "comp", "f", "n", "nf", "o", "diff"],
        )


def _frame_pairs(members: DataFrame) -> DataFrame:
    """Every pair ``[a, b, shared]`` of a frame's members in different components that may be linked.

    ``members`` are ``[c, comp, f, n, nf, o, diff]``; those linked with the centre f have its component. Two
    members x and y have ox + oy - nf shingles in common and one more for each difference from the centre that both
    have, so they are linked if they share at least 3/7 (nx + ny) + nf - ox - oy differences. That is never less than
    3/7 (nx + nf) - ox, which is above zero for an x not linked with the centre, and of two members in different components one is not. Of the
    differences only the rarest are joined, as many as may hold the first common one. Classes of
    a difference's commonest component are not paired with each other.
    """
    spread = members.groupBy("f").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("f")
    mixed = stage(members.join(spread, "f").withColumn("d", F.size("diff").cast("bigint")), "dups-frames")
    fields = ("c", "comp", "n", "nf", "o", "d")
    rows = mixed.select("f", *fields, F.explode("diff").alias("s"))
    common = rows.groupBy("f", "s").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    shared = rows.join(common.where("df > 1").select("f", "s", "df"), ["f", "s"])
    rare_first, whole = Window.partitionBy("f", "c").orderBy("df", "s"), Window.partitionBy("f", "c")
    shared = shared.withColumns({"_at": F.row_number().over(rare_first), "_kept": F.count(F.lit(1)).over(whole)})
    shared = shared.withColumn("at", F.col("d") - F.col("_kept") + F.col("_at"))
    needed = F.greatest(F.floor((3 * (F.col("n") + F.col("nf")) + 6) / 7) - F.col("o"), F.lit(1))
    prefix = stage(shared.where(F.col("at") <= F.col("d") - needed + 1).select("f", "s", *fields, "at"), "dups-prefix")
    by_comp = prefix.groupBy("f", "s", "comp").agg(F.count(F.lit(1)).alias("k"))
    top = by_comp.groupBy("f", "s").agg(F.max_by("comp", "k").alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    met = stage(prefix.join(top, ["f", "s"]), "dups-prefix-mixed")
    a = met.where("comp <> top").select("f", "s", *[F.col(x).alias(f"{x}_a") for x in (*fields, "at")])
    b = met.select("f", "s", "top", *[F.col(x).alias(f"{x}_b") for x in (*fields, "at")])
    total = F.col("n_a") + F.col("n_b")
    sized = 100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b")
    most = 1 + F.least(F.col("d_a") - F.col("at_a"), F.col("d_b") - F.col("at_b"))
    enough = 7 * (most + F.col("o_a") + F.col("o_b") - F.col("nf_a")) >= 3 * total
    once = (F.col("comp_b") == F.col("top")) | (F.col("c_a") < F.col("c_b"))
    found = a.alias("l").join(
        b.alias("r"),
        (F.col("l.f") == F.col("r.f")) & (F.col("l.s") == F.col("r.s")) & (F.col("comp_a") != F.col("comp_b")) & once & sized & enough,
    )
    ends = found.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b"))
    return ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def link(docs: DataFrame) -> DataFrame:
    """``[doc_id, h, n_shingles, comp, component_id]`` for every row of ``docs`` (doc_id, text).

    Words are lower-cased in A-Z; a text of one to four words is one shingle. Null texts
    and texts without words have no shingles and are linked with nothing. Repeated rows
    and equal texts share a component; component_id is its smallest doc_id that is not
    null. Other columns are ignored; an empty table gives an empty result. Classes are told apart by 64-bit
    hashes of their sets. ``h`` is a hash of the text and ``comp`` names the component.
    """
    spark = docs.sparkSession
    rows = stage(
        docs.select("doc_id", F.xxhash64(text_of()).alias("h"), "text").mapInArrow(_sketches, "doc_id bigint, h bigint, n_shingles bigint, c bigint, halves array<bigint>"),
        "dups-rows",
    )
    classes = stage(
        rows.where("c is not null").groupBy("c", "n_shingles", "halves").agg(
            F.min("doc_id").alias("rep"),
            F.min_by("h", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("rep_h"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "dups-classes",
    )
    half = classes.select("c", F.posexplode("halves").alias("i", "half"))
    shared = half.groupBy("i", "half").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("i", "half")
    mine = half.join(shared, ["i", "half"]).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("i", "half"))).alias("hs"))
    pairs_of = F.flatten(
        F.transform(
            "hs",
            lambda x, at: F.transform(
                F.slice("hs", at + 2, F.size("hs")), lambda y: F.xxhash64(x["i"], y["i"], x["half"], y["half"])
            ),
        )
    )
    keyed = mine.where(F.size("hs") >= 2).select("c", F.explode(pairs_of).alias("key"))
    keyed = stage(keyed, "dups-keyed")
    bucket = keyed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("met")).where("lo <> hi").select("key", "lo", "met")
    met = stage(keyed.join(bucket, "key"), "dups-keys")
    involved = stage(met.select("c").distinct().join(classes.select("c", "rep", "rep_h", "n_shingles", "copies"), "c"), "dups-involved")

    # Full sets of the classes that have candidates, from one document of each. A row with the class's
    # smallest doc_id and its class is that document; repeated rows are dropped.
    want = involved.select("c", id_key("rep").alias("k"), F.col("rep_h").alias("h"))
    texts = docs.select("text", id_key("doc_id").alias("k"), F.xxhash64(text_of()).alias("h"))
    sets = join_small(texts, want, ["k", "h"]).select("c", "text").mapInArrow(_sets, "c bigint, set binary")
    if not rows.groupBy("doc_id", "c").count().where("count > 1 and c is not null").isEmpty():
        sets = sets.dropDuplicates(["c"])
    sets = stage(sets, "dups-sets")

    tested = spark.createDataFrame([], "a bigint, b bigint")
    links = tested
    comps = involved.select(F.col("c").alias("node"), F.col("c").alias("comp"))
    # The star rounds look at the likeliest centres of each class; what they leave apart is joined exactly below.
    likely = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    stars = met.where("c <> lo").groupBy(F.col("lo").alias("a"), F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    stars = stage(stars.withColumn("_place", F.row_number().over(likely)).where(F.col("_place") <= STARS).drop("_place"), "dups-stars")

    def joined(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links so far with the new ones, and the component of every class."""
        every = stage(links.unionByName(found), "dups-all-links")
        labels = components(every)
        nodes = involved.select(F.col("c").alias("node")).join(labels, "node", "left")
        return every, stage(nodes.select("node", F.coalesce("comp", "node").alias("comp")), "dups-comps")

    def compared(pairs: DataFrame, rounds: int, rest: bool) -> None:
        """Verify ``pairs`` ``[a, b, shared]``, in each round the likeliest of every class whose
        ends are still apart; with ``rest`` then all that are left."""
        nonlocal tested, links, comps
        for step in range(rounds + rest):
            open_ = _apart(pairs.join(tested, ["a", "b"], "left_anti"), comps)
            if step < rounds:
                ends = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
                best = ends.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
                open_ = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            open_ = stage(open_.select("a", "b"), "dups-open")
            if open_.isEmpty():
                return
            found = stage(_verified(open_, sets, involved), "dups-links")
            tested = stage(tested.unionByName(open_), "dups-tested")
            if not found.isEmpty():
                links, comps = joined(found)

    compared(stars, STAR_ROUNDS, rest=False)
    # What is still apart is decided within the frame of each mixed bucket's largest component.
    # The centre is the class that meets most others, which of an original and its copies is the one nearest to all.
    seen = met.groupBy(F.col("c").alias("node")).agg(F.sum("met").alias("met"))
    centre_of = comps.join(seen, "node").groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.max_by("node", F.struct("met", "node")).alias("f"))
    placed = stage(comps.join(centre_of, "comp").select(F.col("node").alias("c"), "comp", "size", "f"), "dups-centres")
    member = met.select("key", "c").join(placed, "c")
    frames = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("size", "comp", "f")).alias("top"))
    frames = frames.where("lo <> hi").select("key", F.col("top.f").alias("f"))
    framed = stage(member.select("key", "c", "comp").join(frames, "key").select("c", "comp", "f").distinct(), "dups-framed")
    if not framed.isEmpty():
        both = framed.join(sets, "c").join(sets.select(F.col("c").alias("f"), F.col("set").alias("fset")), "f")
        members = stage(both.select("c", "comp", "f", "set", "fset").mapInArrow(_in_frame, FRAMED), "dups-members")
        to_centre = members.where("c <> f").where(7 * F.col("o") >= 3 * (F.col("n") + F.col("nf")))
        found = to_centre.select(F.least("c", "f").alias("a"), F.greatest("c", "f").alias("b")).distinct()
        links, comps = joined(found)
        members = members.drop("comp").join(comps.select(F.col("node").alias("c"), "comp"), "c")
        compared(stage(_frame_pairs(members), "dups-pairs"), STAR_ROUNDS, rest=True)
    named = classes.select("c", "rep").join(comps.select(F.col("node").alias("c"), "comp"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = stage(named.join(smallest, "comp").select("c", "comp", "component_id"), "dups-named")
    # Hot classes (many copies) are on the rows' side alone, which the join may split.
    joined = rows.select("doc_id", "h", "n_shingles", "c").join(by_class, "c", "left")
    return joined.select(
        "doc_id", "h", "n_shingles", "comp", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    left = pairs.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
    return left.join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb").drop("ca", "cb")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: that with the smallest doc_id (then text hash).

    Of rows repeated with that doc_id and text one stays. Texts without words stay.
    """
    head = link(docs).where("comp is not null").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    head = head.groupBy("comp").agg(F.min(F.struct("doc_id", "h")).alias("head"))
    head = stage(head.select(id_key("head.doc_id").alias("k"), F.col("head.h").alias("h")), "dups-heads")
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = packed(docs, k=id_key("doc_id"), h=F.xxhash64(text_of()), words=has_words)
    kept = rows.where("words").join(head, ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
    return kept.select("row.*").unionByName(rows.where("not words").select("row.*"))


def op8_near_dups(spark, sf_dir: str) -> DataFrame:
    found = link(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
