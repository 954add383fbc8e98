"""Fingerprints against a plain Python tree, and the order of documents by brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from slotwatch.llm import merkle


def plain_tree(text):
    leaf = lambda p: [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in re.findall(merkle.LEAVES, p)]
    return [[leaf(p) for p in s.split("\n")] for s in text.split("\n\n")]


def plain_print(text):
    return ";".join("/".join(",".join(f"{x & ((1 << 48) - 1):012x}" for x in p) for p in s) for s in plain_tree(text))


def like(a, b):
    """The share of leaves in common, each as often as it occurs."""
    x, y = (Counter(x for s in plain_tree(t) for p in s for x in p) for t in (a, b))
    both = x.total() + y.total()
    return 1.0 if a == b else 2.0 * (x & y).total() / both if both else 0.0


def run(spark, tmp_path, rows):
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id bigint, text string, h bigint").write.parquet(f"{path}/documents.parquet")
    return {(r.doc_id, r.n_chars): r for r in merkle.op7_merkle(spark, path).collect()}


def test_against_plain(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé😀.!?\n ") for _ in range(rng.randint(1, 9)))
    texts = ["".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", "", "x", "Wort " * 5000]
    rows = [(3 * i + 1, t, 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = run(spark, tmp_path, rows)
    ordered = sorted(rows)
    for (doc, text, _), (_, after, _) in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = got[(doc, n)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint.split("|")[1] == plain_print(text)
        assert r.edited_fingerprint.split("|")[1] == plain_print(edited)
        assert r.near_edited == like(text, edited) and r.near_next == like(text, after)
    same = {}
    for doc, text, _ in rows:
        same.setdefault(got[(doc, len(text))].fingerprint.split("|")[0], set()).add(text)
    assert all(len(v) == 1 for v in same.values())


def test_nulls_repeats_and_one_row(spark, tmp_path):
    rows = [(None, "null id", 1), (1, None, 1), (2, "twice here", 1), (2, "twice here", 9), (2, "other", 1)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id bigint, text string, h bigint").write.parquet(f"{path}/documents.parquet")
    got = merkle.op7_merkle(spark, path).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 7), (1, 0), (2, 5), (2, 10), (2, 10)]
    one = spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")
    assert merkle.with_next(one).select("next_start").first()[0] == "ab"
    assert merkle.with_next(one.limit(0)).count() == 0


def test_changed_sections_locate_an_edit(spark):
    row = spark.createDataFrame([("one\n\ntwo. three\n\nfour", "one\n\ntwo. thre\n\nfour")], "a string, b string")
    got = row.select(merkle.changed_sections(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("c")).first()
    assert got.c == [1]


def test_repeated_leaves_count_each(spark, tmp_path):
    rng = random.Random(5)
    line = lambda: rng.choice(["Read more.", "Share this", "Next page", f"one {rng.randrange(99)}", ""]) + "\n"
    texts = ["".join(line() for _ in range(rng.randint(0, 80))) for _ in range(20)] + ["x. " * 400 + "end", "", "a\n" * 300]
    got = run(spark, tmp_path, [(i, t, 1) for i, t in enumerate(texts)])

    for i, text in enumerate(texts):
        after, n = texts[(i + 1) % len(texts)], len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = got[(i, n)]
        assert (r.near_edited, r.near_next) == (like(text, edited), like(text, after))
