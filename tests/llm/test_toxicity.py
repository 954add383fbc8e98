"""Gradients by differences, windows over whole texts, and accuracy on held-out texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from slotwatch.llm import toxicity as X

WORDS = [a + b + c for a in "bcdfgm" for b in "aeiou" for c in "lnrst"]
BAD = ("vexor", "grumbag")


def sample(rng, n, toxic, size=(1, 90)):
    words = [rng.choice(WORDS) for _ in range(rng.randint(*size))]
    for _ in range(3 if toxic else 0):
        words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
    return " ".join(words)


@pytest.mark.parametrize("texts", [[b"one two three four", b"five"], [b"a b c " * 20, b"d e " * 30]])
def test_gradients(texts, monkeypatch):
    net = X.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["out"] *= 3
    x = X.Inputs.of(texts)
    y = np.arange(len(x.windows)) % 2

    def vectors():
        sizes = np.diff(np.append(x.gram_at, len(x.gram)))
        chars = np.add.reduceat(net.p["chars"][x.gram], x.gram_at) / sizes[:, None]
        both = np.concatenate([net.p["words"][x.word], chars], axis=1)
        return np.concatenate([both, np.zeros((1, 2 * X.DIM))])

    def loss():
        z = net.forward(vectors(), x.windows)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grad = net.gradients(x, vectors(), x.windows, y)
    rng = np.random.default_rng(1)
    for name, value in net.p.items():
        flat, g = value.reshape(-1), grad[name].reshape(-1)
        places = np.flatnonzero(g) if name in ("words", "chars") else np.arange(len(flat))
        for i in rng.choice(places, min(4, len(places)), replace=False):
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert g[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-5), name


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 47, 48, 49, 1000])
def test_windows_cover_every_word(n):
    x = X.Inputs.of([b"first", " ".join(f"w{i}" for i in range(n)).encode(), b""])
    assert list(x.n_windows[[0, 2]]) == [1, 0]
    mine = x.windows[x.text_at[1] : x.text_at[1] + x.n_windows[1]]
    assert len(set(mine.reshape(-1)) - {len(x.word)}) == n
    assert (n == 0) == (len(mine) == 0)


def test_held_out_accuracy_and_tables(spark):
    rng = random.Random(2)
    rows = [(i, sample(rng, i, i % 4 == 0), i % 4 == 0) for i in range(700)]
    rows[5] = (5, sample(rng, 5, False, (2000, 2000)), False)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (None, "dal", 1.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (5, None), (12345, 1), (0, 1)], "doc_id bigint, toxic int")
    net = X.fit(docs, labels)
    got = {r.doc_id: r.score for r in X.scores(docs, net).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100
    assert sum((got[i] >= 0.5) == y for i, y in held) / len(held) >= 0.97
    assert got[900] == got[901] and 0 < got[900] < 0.5
    kept = X.drop_toxic(docs, net)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    assert X.scores(docs.limit(0), net).count() == 0
    empty = X.fit(docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in X.scores(docs.limit(20), empty).collect())


def test_long_texts_count_in_share_and_cut(spark):
    """Texts above ``chars`` are half of all clean ones and some of the toxic ones."""
    rng = random.Random(4)
    rows = [(i, sample(rng, i, i % 3 == 0, (300, 400) if i % 2 else (20, 60)), i % 3 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id bigint, toxic int")
    net = X.fit(docs, labels, chars=500)
    known = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5]
    share = sum(known) / len(known)
    assert net.empty == pytest.approx(np.log(share / (1 - share)))
    got = {r.doc_id: r.score >= 0.5 for r in X.scores(docs, net).collect()}
    for long in (True, False):
        mine = [(i, y) for i, t, y in rows if (len(t) > 500) == long]
        assert len(mine) > 100 and sum(got[i] == y for i, y in mine) / len(mine) >= 0.9
