"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weighted share of all words, never above a multiple of what it
has; what a capped source cannot take goes to the others by weight. Inside a source a
document's expected number of copies rises with its length (``LENGTH_POWER``) up to the
same multiple. The whole part of it is taken for certain. The rest is an inclusion
probability p: documents are ranked by odds(U) / odds(p), U being uniform from a hash of
the document, and taken in that order until the source's remaining words are reached
(the document that crosses the line is taken if that ends nearer to it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwatch.llm.common import id_key, packed, stage, sums_before, table, text_of, word_count

MAX_COPIES = 3
LENGTH_POWER = 0.5
BUCKETS = 8_192
SALTS = 64


def source_targets(per_source: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """``[source, source_size]`` to the same with ``target``.

    Weights go round in code-point order of the sources, null last. With sources in
    order of cap / weight, the capped ones are a prefix: the level c is where the first
    source stays at or under its cap.
    """
    ordered = sums_before(per_source, [F.col("source").isNull(), F.col("source")], {}, "mix-order")
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    weighted = ordered.select("source", "source_size", w.alias("w"), (F.col("source_size") * max_copies).alias("cap"))
    level = F.col("cap") / F.col("w")
    filled = sums_before(
        weighted.withColumn("_level", level),
        [F.col("_level"), F.col("source").isNull(), F.col("source")],
        {"cap_before": F.col("cap"), "w_before": F.col("w")},
        "mix-level",
    )
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    c = (F.lit(total["size"] or 0).cast("bigint") - F.col("cap_before")) / (F.lit(total["w"] or 0).cast("bigint") - F.col("w_before"))
    share = filled.where(c <= F.col("_level")).agg(F.min_by(c, "pos").alias("c")).first()["c"]
    return filled.select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.lit(share).cast("double") * F.col("w")).alias("target"),
    )


def octave(size: Column) -> Column:
    """Floor of the binary logarithm; -1 for no words."""
    return F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(F.lit(-1))


def measure(oct_: Column) -> Column:
    return F.pow(F.lit(2.0), oct_ * F.lit(LENGTH_POWER))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the document's id alone, so that reruns agree."""
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digits, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**48))


def copies_by_octave(classes: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """Expected copies of a document for each source and length class.

    Solves sum(min(max, c * measure) * words) = target for c, with the classes (at most
    64 a source) in falling order of measure.
    """
    down = Window.partitionBy("source").orderBy(F.desc("oct"))
    m = measure(F.col("oct"))
    solved = (
        classes.where("oct >= 0")
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "_rest": F.sum(m * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing)),
            }
        )
        .withColumn("_c", (F.col("target") - F.lit(max_copies) * F.col("_before")) / F.col("_rest"))
        .withColumn("_free", F.col("_c") * m <= F.lit(float(max_copies)))
        .withColumn("_at", F.max(F.when(F.col("_free"), F.col("oct"))).over(Window.partitionBy("source")))
        .withColumn("_level", F.max(F.when(F.col("oct") == F.col("_at"), F.col("_c"))).over(Window.partitionBy("source")))
    )
    copies = F.when(F.col("oct") <= F.col("_at"), F.greatest(F.col("_level") * m, F.lit(0.0))).otherwise(F.lit(float(max_copies)))
    return solved.select("source", "oct", copies.alias("copies"), "words", "target")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_copies: int = MAX_COPIES,
    seed: int = 17,
) -> DataFrame:
    """``[doc_id, source, size, source_size, target, copies]`` for every row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns are ignored. Null texts and
    texts without words have size 0 and are never taken. A null source is a source of
    its own, last in order. Rows with equal doc_id draw the same number and are ranked
    by size; identical rows are interchangeable. An empty table gives an empty result.
    """
    rows = stage(docs.select("doc_id", "source", word_count(text_of()).alias("size")), "mix-sizes")
    rows = rows.withColumn("oct", octave(F.col("size")))
    # Partial sums leave each task as one row per source and length class.
    classes = stage(
        rows.groupBy("source", "oct").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-classes"
    )
    per_source = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = stage(source_targets(per_source, weights, max_copies), "mix-targets")
    expected = copies_by_octave(classes, targets.select(F.col("source").alias("t_source"), "target"), max_copies)
    whole = F.floor("copies")
    left = expected.groupBy("source").agg(
        F.first("target").alias("_target"), F.sum(whole * F.col("words")).alias("_certain")
    )
    plan = stage(
        targets.alias("t")
        .join(left.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
        .join(expected.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
        .select(
            F.col("t.source").alias("p_source"),
            F.col("e.oct").alias("p_oct"),
            "t.source_size",
            "t.target",
            (F.col("t.target") - F.coalesce(F.col("l._certain"), F.lit(0))).alias("left"),
            F.coalesce(whole, F.lit(0)).cast("bigint").alias("whole"),
            F.coalesce(F.col("copies") - whole, F.lit(0.0)).alias("p"),
        ),
        "mix-plan",
    )
    # A source may hold a third of the rows: its rows are spread over salted copies of its
    # few plan rows. Rows without words meet any plan row of their source, by octave -1.
    no_words = plan.select("p_source", F.lit(-1).alias("p_oct"), "source_size", "target", "left", F.lit(0).cast("bigint").alias("whole"), F.lit(0.0).alias("p")).distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("p_salt")
    rates = plan.where("p_oct is not null").unionByName(no_words).select("*", salts)
    key = F.coalesce(F.col("source"), F.lit(""))
    drawn = (
        rows.withColumns(
            {"_salt": F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"), "_key": key, "_null": F.col("source").isNull()}
        )
        .join(
            rates.withColumns({"_pkey": F.coalesce(F.col("p_source"), F.lit("")), "_pnull": F.col("p_source").isNull()}),
            (F.col("_key") == F.col("_pkey")) & (F.col("_null") == F.col("_pnull")) & (F.col("oct") == F.col("p_oct")) & (F.col("_salt") == F.col("p_salt")),
        )
        .select("doc_id", "source", "size", "source_size", "target", "left", "whole", "p")
    )
    u = uniform(F.col("doc_id"), seed)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = stage(
        drawn.withColumn("q", F.when(F.col("p") > 0, q)).withColumn(
            "bucket", F.least(F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        ),
        "mix-ranked",
    )
    # Words by rank bucket say in which bucket a source's line falls; only that bucket's
    # documents, about one in BUCKETS, are put in exact order.
    by_bucket = ranked.where("q is not null").groupBy("source", "bucket").agg(
        F.sum("size").alias("_words"), F.first("left").alias("left")
    )
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        by_bucket.withColumn("_before", F.coalesce(F.sum("_words").over(up), F.lit(0)))
        .where((F.col("_before") < F.col("left")) & (F.col("_before") + F.col("_words") >= F.col("left")))
        .select(F.col("source").alias("e_source"), F.col("bucket").alias("e_bucket"), "_before")
    )
    edges = stage(
        plan.select("p_source").distinct().join(edges, _same("p_source", "e_source"), "left").select(
            "p_source", F.col("e_bucket"), F.col("_before")
        ),
        "mix-edges",
    )
    salted = edges.select(
        F.coalesce("p_source", F.lit("")).alias("_pkey"),
        F.col("p_source").isNull().alias("_pnull"),
        "e_bucket",
        "_before",
        salts,
    )
    placed = (
        ranked.withColumns(
            {"_salt": F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"), "_key": key, "_null": F.col("source").isNull()}
        )
        .join(salted, (F.col("_key") == F.col("_pkey")) & (F.col("_null") == F.col("_pnull")) & (F.col("_salt") == F.col("p_salt")))
        .select("doc_id", "source", "size", "source_size", "target", "left", "whole", "q", "bucket", "e_bucket", "_before")
    )
    out = ["doc_id", "source", "size", "source_size", "target"]
    inside = F.col("q").isNotNull() & (F.col("bucket") == F.col("e_bucket"))
    direct = placed.where(~F.coalesce(inside, F.lit(False))).select(
        *out,
        # Without an edge the whole ranking fits under the line (it ends a rounding above it).
        (F.col("whole") + F.when(F.col("q").isNotNull() & (F.col("left") > 0) & F.coalesce(F.col("bucket") < F.col("e_bucket"), F.lit(True)), 1).otherwise(0)).alias("copies"),
    )
    line = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = placed.where(inside).withColumn("_in", F.col("_before") + F.coalesce(F.sum("size").over(line), F.lit(0)))
    at_edge = at_edge.select(
        *out, (F.col("whole") + F.when(F.col("_in") + F.col("size") / 2 <= F.col("left"), 1).otherwise(0)).alias("copies")
    )
    return direct.unionByName(at_edge)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` that are taken, and how often (``mix_copies``, which
    replaces a column of that name). Rows with equal doc_id and size are taken alike."""
    taken = mix(docs, **options).where("copies > 0").select(id_key("doc_id").alias("k"), "size", "copies")
    taken = taken.groupBy("k", "size").agg(F.max("copies").alias("mix_copies"))
    rows = packed(docs.drop("mix_copies"), k=id_key("doc_id"), size=word_count(text_of()))
    return rows.join(taken, ["k", "size"]).select("row.*", "mix_copies")


def op1_pareto_mix(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), o AS (
  SELECT *, CASE WHEN size > 0 THEN length(ltrim(bin(size), '0')) - 1 ELSE -1 END AS oct FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS lvl,
         row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST) AS pos,
         coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(w) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM s
), lv AS (
  SELECT arg_min(c, pos) AS c FROM (
    SELECT pos, lvl, CAST((SELECT sum(source_size) FROM f) - cap_before AS DOUBLE) / CAST((SELECT sum(w) FROM f) - w_before AS DOUBLE) AS c FROM f)
  WHERE c <= lvl
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT c FROM lv) * w) AS target FROM f
), k AS (
  SELECT o.source, o.oct, sum(size) AS words, any_value(t.target) AS target, pow(2.0, o.oct * 0.5) AS m
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source WHERE o.oct >= 0 GROUP BY o.source, o.oct
), kc AS (
  SELECT *, (target - 3 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY oct DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(m * words) OVER (PARTITION BY source ORDER BY oct DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM k
), ka AS (
  SELECT *, max(CASE WHEN c * m <= 3 THEN oct END) OVER (PARTITION BY source) AS at_oct FROM kc
), kl AS (
  SELECT *, max(CASE WHEN oct = at_oct THEN c END) OVER (PARTITION BY source) AS lvl FROM ka
), e AS (
  SELECT source, oct, words, target, CASE WHEN oct <= at_oct THEN greatest(lvl * m, 0.0) ELSE 3.0 END AS copies FROM kl
), r AS (
  SELECT source, any_value(target) - sum(floor(copies) * words) AS remaining FROM e GROUP BY source
), x AS (
  SELECT o.doc_id, o.source, o.size, t.source_size, t.target, coalesce(r.remaining, t.target) AS remaining,
         coalesce(floor(e.copies), 0) AS whole, coalesce(e.copies - floor(e.copies), 0) AS p,
         (CAST('0x' || substr(md5('17:' || coalesce(CAST(o.doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
  LEFT JOIN r ON o.source IS NOT DISTINCT FROM r.source
  LEFT JOIN e ON o.source IS NOT DISTINCT FROM e.source AND o.oct = e.oct
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (CAST(u AS DOUBLE) / (1 - CAST(u AS DOUBLE))) / (p / (1 - p)) END AS q FROM x
), z AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN q IS NOT NULL AND before + size / 2.0 <= remaining THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z
"""
