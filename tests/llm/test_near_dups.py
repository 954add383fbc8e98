"""Near copies against brute force over all pairs."""

from __future__ import annotations

import random

import pytest

from slotwatch.llm import near_dups

DOCS = "doc_id bigint, text string, comp string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if common and 100 * common >= 75 * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        ids = [x for x in (least.get(find(i)), doc) if x is not None]
        least[find(i)] = min(ids, default=None)
    return sorted((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _, _) in enumerate(rows))


def edited(rng, words, share):
    return [rng.choice("pqrstuv") * 4 if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for size in (6, 30, 80, 200):
        base = [word() for _ in range(size)]
        texts += [base, base, [w.upper() for w in base]]
        # Edits around the limit: some copies link, some only through others, some not at all.
        texts += [edited(rng, base, s) for s in (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08) for _ in range(6)]
    shared = [word() for _ in range(60)]
    texts += [[word() for _ in range(90)] + shared for _ in range(30)]
    out = [(100 + i, " ".join(t), "x") for i, t in enumerate(texts)]
    out += [(1, None, "x"), (2, "", "x"), (3, " \t", "x"), (4, "one two", "x"), (5, "One TWO", "x"), (6, "two one", "x")]
    out += [(100, out[0][1], "x"), (7, "É é é é é", "x"), (8, "é é é é é", "x")]
    rng.shuffle(out)
    return out


def test_components_equal_brute_force(spark, rows):
    got = near_dups.link(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_keep_one(spark, rows):
    kept = near_dups.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "comp"]
    want = {doc for doc, _, comp in brute(rows) if doc == comp}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (None, "q r s t u v", "x"), (9, "A B C D E F", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_dups.link(docs).collect())
    assert got == [("9", "9"), ("None", "9"), ("None", "9"), ("None", "None"), ("None", "None")]
    assert near_dups.keep_one(docs).count() == 3
    assert near_dups.link(docs.limit(0)).count() == 0


def cloud(rng, n):
    """Texts of one original, most of them too far from each other to be linked, some by way of others."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    texts = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(60), rng.choice((0, 1, 2, 2, 3, 4))):
            w[at] = word() if rng.random() < 0.9 else "same"
        texts.append(w[: rng.choice((60, 60, 58, 55))])
    # Two that are far from the original and linked with each other by their own words.
    far = list(base)
    for at in (5, 15, 25, 35, 45):
        far[at] = word()
    return [*texts, far, [*far[:-1], "end"]]


def test_a_cloud_of_near_misses_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(w), "x") for i, w in enumerate(cloud(rng, 220))]
    got = near_dups.link(spark.createDataFrame(rows, DOCS))
    want = brute(rows)
    assert len({c for *_, c in want}) > 10
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_verified_pairs_grow_with_the_group(spark, monkeypatch):
    """Pairs of the last step that turn out not to be linked, for a group of twice as many near misses."""
    counted, linked = {}, {}
    plain = near_dups._frame_pairs

    def watched(members):
        out = plain(members)
        counted[n] = out.count()
        return out

    monkeypatch.setattr(near_dups, "_frame_pairs", watched)
    for n in (400, 800):
        rng = random.Random(10)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
        base = [word() for _ in range(60)]
        texts = []
        for _ in range(n):
            w = list(base)
            for at in rng.sample(range(60), 2):
                w[at] = word()
            texts.append(" ".join(w))
        near_dups.link(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)).count()
        sets = [shingles(t) for t in texts]
        # All pairs that are links, those found by earlier steps among them.
        linked[n] = sum(175 * len(a & b) >= 75 * (len(a) + len(b)) for i, a in enumerate(sets) for b in sets[:i])
    assert counted[800] - linked[800] <= 2.2 * max(counted[400] - linked[400], 50), (counted, linked)


def test_long_words_and_texts():
    from slotwatch.llm import hashing

    long = "w" * (hashing.LONG_WORD + 5)
    texts = [f"a {long} b c d e", f"A {long} b c d e f", " ".join(f"w{i}" for i in range(400_000))]
    one, two, three = hashing.shingle_sets([t.lower().encode() for t in texts])
    assert len(one) == 2 and len(two) == 3 and set(one) < set(two) and len(three) == 399_996
    assert (hashing.shingle_sets([b"x y z v w " + texts[2].encode()])[0].size, len(hashing.shingle_sets([texts[2].encode()])[0])) == (400_001, 399_996)
