"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs.

A word's input is a hashed word vector and the mean of its hashed character trigrams'
vectors. The network reads windows of ``WINDOW`` words, every ``STRIDE`` words and one at the
text's end, so all windows overlap and cover the whole text; a text is as toxic as its
most toxic window. Training is numpy back-propagation on a bounded, documented sample of
labelled rows (``TRAIN_ROWS`` of each class, by hash of the id, of texts up to
``TRAIN_CHARS`` characters); a text's gradient goes through its highest window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwatch.llm import hashing
from slotwatch.llm.common import stage, table, text_of

WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 12
DIM, HIDDEN = 12, 16
TRAIN_ROWS = 1200
TRAIN_CHARS = 20_000
EPOCHS, STEPS = 8, 240  # at least so many passes and so many steps
BATCH = 2048  # windows that go through the network together


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Inputs:
    """Distinct words of some texts, and their windows as places in that list."""

    word: np.ndarray  # row of each distinct word
    gram: np.ndarray  # rows of the trigrams of all distinct words
    gram_at: np.ndarray  # where each word's trigrams start
    windows: np.ndarray  # (windows, WINDOW) word numbers; len(word) stands for no word
    text_at: np.ndarray  # first window of each text
    n_windows: np.ndarray  # of each text; texts without words have none

    @classmethod
    def of(cls, texts: list[bytes]) -> Inputs:
        w = hashing.Words.of(texts)
        distinct, first, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
        start, size = w.start[first], w.end[first] - w.start[first]
        at = np.cumsum(size) - size
        place = np.repeat(start - at, size) + np.arange(int(size.sum()))
        data = np.where(hashing.SPACE[w.data], np.uint8(0x20), w.data).astype(np.uint64)
        gram = (data[place - 1] << np.uint64(16)) | (data[place] << np.uint64(8)) | data[place + 1]
        bounds = np.searchsorted(w.doc, np.arange(len(texts) + 1))
        counts = np.diff(bounds)
        spans = [
            np.unique(np.append(np.arange(0, max(n - WINDOW, 0) + 1, STRIDE), max(n - WINDOW, 0))) if n else np.zeros(0, np.int64)
            for n in counts
        ]
        n_windows = np.array([len(s) for s in spans], np.int64)
        starts = np.concatenate([s + a for s, a in zip(spans, bounds)]) if len(spans) else np.zeros(0, np.int64)
        limit = np.repeat(bounds[1:], n_windows)
        cells = starts[:, None] + np.arange(WINDOW)
        number = np.append(number, len(distinct))
        windows = number[np.where(cells < limit[:, None], cells, len(number) - 1)]
        return cls(
            (distinct % np.uint64(WORD_ROWS)).astype(np.int64),
            (hashing.mixed(gram + np.uint64(1)) % np.uint64(CHAR_ROWS)).astype(np.int64),
            at,
            windows.reshape(-1, WINDOW),
            np.cumsum(n_windows) - n_windows,
            n_windows,
        )


class Network:
    """Parameters by name; ``fw_*`` and ``bw_*`` are the two directions."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = DIM, HIDDEN
        init = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.p = {"words": init(WORD_ROWS, d, s=0.1), "chars": init(CHAR_ROWS, d, s=0.3)}
        for way in ("fw", "bw"):
            self.p |= {
                f"{way}_w": init(2 * d, 3 * h, s=0.4),
                f"{way}_u": init(h, 3 * h, s=0.25),
                f"{way}_b": np.zeros(3 * h, np.float32),
            }
        self.p |= {"att": init(2 * h, s=0.3), "out": init(2 * h, s=0.3), "bias": np.zeros(1, np.float32)}
        self.empty = 0.0  # logit of a text without words
        self.shift = 0.0  # moves the best cut of the training sample to 0

    def inputs(self, x: Inputs) -> np.ndarray:
        """Vectors of the distinct words, with a zero row for no word."""
        sizes = np.diff(np.append(x.gram_at, len(x.gram)))
        chars = np.add.reduceat(self.p["chars"][x.gram], x.gram_at) / sizes[:, None].astype(np.float32) if len(sizes) else np.zeros((0, DIM), np.float32)
        both = np.concatenate([self.p["words"][x.word], chars], axis=1).astype(np.float32)
        return np.concatenate([both, np.zeros((1, 2 * DIM), np.float32)])

    def forward(self, vectors: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logit of each window; with ``keep`` also what the backward pass needs."""
        p, h, n = self.p, HIDDEN, len(windows)
        none = len(vectors) - 1
        there = (windows != none).T.astype(np.float32)[:, :, None]
        full = bool(there.all())
        states = np.zeros((WINDOW, n, 2 * h), np.float32)
        memo = {}
        for way, order in (("fw", range(WINDOW)), ("bw", range(WINDOW - 1, -1, -1))):
            cols = slice(0, h) if way == "fw" else slice(h, 2 * h)
            given = vectors @ p[f"{way}_w"] + p[f"{way}_b"]
            u, state, steps = p[f"{way}_u"], np.zeros((n, h), np.float32), []
            for t in order:
                a = given[windows[:, t]]
                b = state @ u
                gates = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                cand = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
                new = cand + z * (state - cand)
                if not full:
                    new = state + there[t] * (new - state)
                if keep:
                    steps.append((t, state, z, r, cand, b[:, 2 * h :]))
                state = new
                states[t, :, cols] = state
            memo[way] = steps
        energy = states @ p["att"]
        if not full:
            energy = np.where(there[:, :, 0] > 0, energy, np.float32(-1e9))
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (states, weight, pooled, memo, there, full)) if keep else logit

    def gradients(self, x: Inputs, vectors: np.ndarray, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over ``windows``."""
        p, h, n = self.p, HIDDEN, len(windows)
        logit, (states, weight, pooled, memo, there, full) = self.forward(vectors, windows, keep=True)
        dlogit = ((_sigmoid(logit) - labels) / n).astype(np.float32)
        g = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["out"]
        dweight = np.einsum("nh,tnh->tn", dpooled, states)
        denergy = weight * (dweight - (weight * dweight).sum(0))
        g["att"] = np.einsum("tn,tnh->h", denergy, states)
        dstates = weight[:, :, None] * dpooled + denergy[:, :, None] * p["att"]
        dvectors = np.zeros_like(vectors)
        for way in ("fw", "bw"):
            cols = slice(0, h) if way == "fw" else slice(h, 2 * h)
            u, du = p[f"{way}_u"], np.zeros_like(p[f"{way}_u"])
            dgiven = np.zeros((len(vectors), 3 * h), np.float32)
            dstate = np.zeros((n, h), np.float32)
            for t, state, z, r, cand, bn in reversed(memo[way]):
                dstate = dstate + dstates[t, :, cols]
                dnew = dstate if full else dstate * there[t]
                dcand = dnew * (1 - z) * (1 - cand * cand)
                dz = dnew * (state - cand) * z * (1 - z)
                dr = dcand * bn * r * (1 - r)
                da = np.concatenate([dz, dr, dcand], axis=1)
                db = np.concatenate([dz, dr, dcand * r], axis=1)
                np.add.at(dgiven, windows[:, t], da)
                du += state.T @ db
                dstate = dnew * z + db @ u.T + (0 if full else dstate * (1 - there[t]))
            g[f"{way}_u"], g[f"{way}_b"], g[f"{way}_w"] = du, dgiven.sum(0), vectors.T @ dgiven
            dvectors += dgiven @ p[f"{way}_w"].T
        dvectors = dvectors[:-1]
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], x.word, dvectors[:, :DIM])
        sizes = np.diff(np.append(x.gram_at, len(x.gram)))
        g["chars"] = np.zeros_like(p["chars"])
        np.add.at(g["chars"], x.gram, np.repeat(dvectors[:, DIM:] / sizes[:, None].astype(np.float32), sizes, axis=0))
        return g

    def window_logits(self, x: Inputs) -> np.ndarray:
        vectors = self.inputs(x)
        out = np.empty(len(x.windows), np.float32)
        # Windows with missing words are few; apart from them no mask is needed.
        short = x.windows[:, -1] == len(vectors) - 1
        for which in (np.flatnonzero(~short), np.flatnonzero(short)):
            for i in range(0, len(which), BATCH):
                out[which[i : i + BATCH]] = self.forward(vectors, x.windows[which[i : i + BATCH]])
        return out

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: that of its highest window."""
        x = Inputs.of(texts)
        out = np.full(len(texts), self.empty, np.float64)
        has = x.n_windows > 0
        if has.any():
            out[has] = np.maximum.reduceat(self.window_logits(x), x.text_at[has]) - self.shift
        return out


def train(texts: list[bytes], labels: list[int], epochs: int | None = None, seed: int = 7, rate: float = 0.01) -> Network:
    """Fit a network; without both classes every text gets the share of label 1."""
    net = Network(seed)
    y = np.array(labels, np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    net.empty = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        net.p["out"][:] = 0
        net.shift = -net.empty
        return net
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    # Texts of like length together; the order of the groups changes each epoch.
    order = np.argsort([len(t) for t in texts], kind="stable")
    groups = [order[i : i + 48] for i in range(0, len(order), 48)]
    epochs = epochs or max(EPOCHS, min(5 * EPOCHS, -(-STEPS // len(groups))))
    made = [Inputs.of([texts[i] for i in g]) for g in groups]
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            x, has = made[k], made[k].n_windows > 0
            if not has.any():
                continue
            vectors, logit = net.inputs(x), net.window_logits(x)
            picked, wanted = [], []
            for at, n, label in zip(x.text_at[has], x.n_windows[has], y[groups[k]][has]):
                picked.append(at + int(np.argmax(logit[at : at + n])))
                wanted.append(label)
                if not label:  # a clean text is clean everywhere
                    picked.append(at + int(rng.integers(n)))
                    wanted.append(label)
                elif epoch < 2:  # until the network can tell, any window of a toxic text may be it
                    picked.append(at + int(rng.integers(n)))
                    wanted.append(label)
            g = net.gradients(x, vectors, x.windows[picked], np.array(wanted, np.float32))
            step += 1
            lr = rate * (1 - 0.9 * step / (epochs * len(groups) + 1))
            for name, value in g.items():
                mean[name] += 0.1 * (value - mean[name])
                square[name] += 0.001 * (value * value - square[name])
                fixed = np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8
                net.p[name] -= (lr * mean[name] / (1 - 0.9**step) / fixed).astype(np.float32)
    return net


def set_cut(net: Network, logits: np.ndarray, labels: list[int], share: float) -> None:
    """Shift the logits so that 0 is the best cut on the sample for a true share of label 1.

    The cut lies midway in the widest stretch of logits with the fewest weighted errors.
    """
    y, z = np.array(labels), np.asarray(logits)
    if not len(y) or y.min() == y.max():
        return
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    order = np.argsort(z)
    z, y, weight = z[order], y[order], weight[order]
    # Errors if everything from place i on is called toxic.
    errors = np.concatenate([[0], np.cumsum(weight * y)]) + np.concatenate([np.cumsum((weight * (1 - y))[::-1])[::-1], [0]])
    cuts = np.flatnonzero(errors <= errors.min() + 1e-12)
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    best = cuts[np.argmax(edges[cuts + 1] - edges[cuts])]
    net.shift += float((edges[best] + edges[best + 1]) / 2)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Network:
    """Train on at most ``rows`` labelled texts of each class that are not held out.

    The share of label 1 and the cut follow whole texts of any length, which tasks score. A clean text above
    ``chars`` code points teaches by an excerpt of that length, drawn by hash; a toxic one does not
    teach, as nobody said where in it the toxic part is. Labels that are null, or whose id is null or
    has no document, are left out; of repeated ids one label is taken, and the least text.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    known = stage(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "tox-known")
    share = known.agg(F.avg("toxic").alias("share")).first()["share"]
    picked = None
    for label in (0, 1):
        top = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = top if picked is None else picked.unionByName(top)
    # At most 2 * rows ids.
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(stage(picked, "tox-picked")), "doc_id")
    sample = stage(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "tox-sample")
    size = F.length("text")
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(size - F.lit(chars), F.lit(0)) + 1).cast("int") + 1
    teaching = sample.where((size <= chars) | (F.col("toxic") == 0)).select("doc_id", "toxic", F.substring("text", place, F.lit(chars)).alias("text"))
    got = sorted((r["doc_id"], r["text"].encode().lower(), r["toxic"]) for r in teaching.collect())
    net = train([text for _, text, _ in got], [y for _, _, y in got])
    # One number for each text of the sample.
    found = {r["doc_id"]: r["value"] for r in _valued(sample, net, lambda z: z).collect()}
    labelled = sorted((r["doc_id"], r["toxic"]) for r in sample.select("doc_id", "toxic").collect())
    if labelled:
        set_cut(net, np.array([found[d] for d, _ in labelled]), [y for _, y in labelled], min(max(share, 0.01), 0.5))
        net.empty = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return net


def _valued(docs: DataFrame, net: Network, final: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``[doc_id, h, value]``: ``final`` of the logit of each whole text, and a hash of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for first, texts in hashing.slices((t.as_py() or "").encode().lower() for t in column):
                value = final(sent.value.logits(texts))
                yield pa.record_batch(
                    [batch.column("doc_id").slice(first, len(texts)), batch.column("h").slice(first, len(texts)), pa.array(value, pa.float64())],
                    names=["doc_id", "h", "value"],
                )

    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("h"), "text")
    return rows.mapInArrow(run, "doc_id bigint, h bigint, value double")


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` ``[doc_id, text]`` as ``[doc_id, h, score]``, ``h`` being a hash of the text.

    Null and empty texts get the share of toxic texts in training; repeated rows the same score
    each; other columns are ignored and an empty table gives an empty result.
    """
    return _valued(docs, net, _sigmoid).withColumnRenamed("value", "score")


def drop_toxic(docs: DataFrame, net: Network, cut: float = 0.5) -> DataFrame:
    """``docs`` without the texts scored at ``cut`` or more; all columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in hashing.slices((t.as_py() or "").encode().lower() for t in batch.column(at)):
                clean = _sigmoid(sent.value.logits(texts)) < cut
                yield batch.slice(first, len(texts)).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
