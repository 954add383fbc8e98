"""The lattice against all segmentations, the model's sums, and the base figures."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from slotwatch.llm import lattice_lm as lm


@pytest.fixture(scope="module")
def lattice():
    return lm.Lattice.from_vocabulary(lm.VOCABULARY)


def plain(lattice, word):
    """Probability over all segmentations, and the expected uses of every piece."""
    ways = []

    def go(at, p, used):
        if at == len(word):
            ways.append((p, used))
            return
        for end in range(at + 1, len(word) + 1):
            q = lattice.going.get(word[at:end])
            if q is not None:
                go(end, p * math.exp(q), [*used, word[at:end]])
            elif end == at + 1:
                go(end, p * math.exp(sum(lattice.byte[b] for b in word[at].encode())), used)

    for end in range(len(word) + 1):
        q = lattice.opening.get(word[:end])
        if q is not None:
            go(end, math.exp(q), [])
    total = sum(p for p, _ in ways)
    uses = Counter()
    for p, used in ways:
        for piece in used:
            uses[piece] += p / total
    return math.log(total) + lattice.stop, uses


@pytest.mark.parametrize("word", ["a", "thing", "worthless", "aéx", "漢字", "😀b", "$$$,", "the"])
def test_all_segmentations(lattice, word):
    want, uses = plain(lattice, word)
    assert lattice.log_prob(word) == pytest.approx(want, abs=1e-9)
    opening, going, byte = dict.fromkeys(lattice.opening, 0.0), dict.fromkeys(lattice.going, 0.0), [0.0] * 256
    lattice.expected(word, opening, going, byte)
    assert sum(opening.values()) == pytest.approx(1)
    assert {k: v for k, v in going.items() if v} == pytest.approx(dict(uses))


def test_any_length(lattice):
    word = "xyz" * 3000
    opening, going, byte = dict.fromkeys(lattice.opening, 0.0), dict.fromkeys(lattice.going, 0.0), [0.0] * 256
    lattice.expected(word, opening, going, byte)
    assert sum(opening.values()) == pytest.approx(1) and -1e6 < lattice.log_prob(word) < -1000


WORDS = ["a", "the", "thing", "worthless", "aéx", "漢字", "😀b", "$$$,", "\0x", "▁▁", "ab" * 60, "xyz" * 300, "walking", "q" * 256, "q" * 257]


def test_words_side_by_side_are_words_one_by_one(lattice, monkeypatch):
    words, times = WORDS * 3, [i % 4 + 1 for i in range(3 * len(WORDS))]
    opening, going, byte = dict.fromkeys(lattice.opening, 0.0), dict.fromkeys(lattice.going, 0.0), [0.0] * 256
    for word, c in zip(words, times):
        lattice.expected(word, opening, going, byte, c)
    for cells in (lm.CELLS, 40):
        monkeypatch.setattr(lm, "CELLS", cells)
        pieces = lm.Pieces(lattice)
        assert sorted(j for i in pieces.slices(words) for j in i) == [j for j, w in enumerate(words) if len(w) <= lm.LONG]
        assert pieces.log_probs(words).tolist() == pytest.approx([lattice.log_prob(w) for w in words], abs=1e-9)
        uses, by_bytes = np.zeros(len(pieces.names)), [0.0] * 256
        pieces.expected(words, times, uses, by_bytes)
        assert uses.tolist() == pytest.approx([*opening.values(), *going.values()], abs=1e-9)
        assert by_bytes == pytest.approx(byte, abs=1e-9)
        assert pieces.log_probs([]).tolist() == []


def test_distributions_sum_to_one(lattice):
    refined = lattice.refined([("open", "th", 5.0), ("go", "ing", 7.0), ("byte", "65", 1.0)], 5)
    for m in (lattice, refined):
        assert sum(map(math.exp, m.opening.values())) == pytest.approx(1)
        assert sum(map(math.exp, m.going.values())) + sum(map(math.exp, m.byte)) + math.exp(m.stop) == pytest.approx(1)
    assert refined.going["ing"] > lattice.going["ing"]


def test_scores_and_base(spark):
    docs = [(i, f"The w{i % 7} w{i % 5}  the\tEnd{i % 3}") for i in range(60)]
    docs += [(100, None), (101, ""), (None, "the é"), (102, "new words here"), (102, "new words here")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, n int")
    tokens = lambda t: (t or "").encode().lower().split()
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    counts = Counter()
    for d, t in docs:
        if not held(d):
            counts.update([*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    got = lm.score_texts(frame, chunk_bytes=300).collect()
    assert len(got) == len(docs)
    by = {(r.doc_id, r.n_tokens): r for r in got}
    for d, t in docs:
        w = [*tokens(t), None]
        r = by[(d, len(w))]
        assert (r.held_out, r.train_tokens, r.n_known) == (held(d), n, sum(counts[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0 and math.isfinite(r.score)
    # A known word is likelier than an unknown one of the same letters.
    assert by[(None, 3)].score > by[(102, 4)].score
    assert lm.score_texts(frame.limit(0)).count() == 0


def test_without_training_texts(spark):
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = lm.score_texts(spark.createDataFrame([(only, "some text")], "doc_id bigint, text string")).first()
    assert (got.n_known, got.train_tokens) == (0, 0) and math.isfinite(got.score)


def test_score_is_the_lattice_of_all_words(spark):
    docs = [(i, f"the {'the ' * (i % 4)}thing w{i % 5} walking") for i in range(40)] + [(200, "the unseenword"), (201, "the thing")]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(w for d, t in docs if not held(d) for w in t.split())
    n_docs = sum(not held(d) for d, _ in docs)
    tokens = sum(counts.values())
    want = lm.Lattice.from_vocabulary(lm.VOCABULARY)
    for _ in range(lm.EM_ROUNDS):
        opening, going, byte = dict.fromkeys(want.opening, 0.0), dict.fromkeys(want.going, 0.0), [0.0] * 256
        for w, c in counts.items():
            for _ in range(c):
                want.expected(w, opening, going, byte)
        uses = [("open", p, u) for p, u in opening.items()] + [("go", p, u) for p, u in going.items()]
        want = want.refined(uses + [("byte", str(b), u) for b, u in enumerate(byte)], tokens)
    more, end = math.log(tokens / (tokens + n_docs)), math.log(n_docs / (tokens + n_docs))
    for r in lm.score_texts(spark.createDataFrame(docs, "doc_id bigint, text string"), chunk_bytes=300).collect():
        lattice = sum(want.log_prob(w) + more for w in dict(docs)[r.doc_id].split()) + end
        assert r.score == pytest.approx(lattice / math.log(10))


def test_training_texts_without_words(spark):
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = lm.score_texts(spark.createDataFrame([(only, "some text"), (only + 1000, ""), (None, " ")], "doc_id bigint, text string")).collect()
    assert all(math.isfinite(r.score) for r in got)
