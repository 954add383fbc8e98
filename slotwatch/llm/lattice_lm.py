"""Language-model scores from a subword lattice.

A word's lattice probability sums over all its segmentations into pieces of an existing
vocabulary, by a forward recursion in log space. Pieces that open a word and pieces that
continue it (or end it) are two distributions, both from the vocabulary's scores and
then from the pieces' expected counts over all training words (forward and backward
sums of each distinct word, times its count). A text's score is the sum of its words'
lattice probabilities and of its end, so every text has a probability and all of them
sum to one. Characters outside the vocabulary fall back to its byte pieces.

Each chunk of documents sends its distinct words to be counted and gets their scores
back, so what is shuffled follows distinct words per chunk and not tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.llm.common import stage, table, text_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 8 << 20
EM_ROUNDS = 2
PRIOR = 1000.0  # pseudo-counts by which the vocabulary's own scores count
MARK = "▁"  # opens a word in the vocabulary
NEVER = -math.inf
LONG = 256  # characters: longer words go one by one, shorter ones side by side
CELLS = 1 << 15  # characters laid side by side
BEYOND = 0x110000  # stands behind a word's end: no code point


class Lattice:
    """Log probabilities of opening and continuing pieces, of bytes and of a word's end."""

    def __init__(self, opening: dict[str, float], going: dict[str, float], byte: list[float], stop: float):
        self.opening, self.going, self.byte, self.stop = opening, going, byte, stop
        # All beginnings of pieces: where a walk along a word leaves this, no longer piece fits.
        self.open_walk, self.go_walk = (
            {p[:i]: NEVER for p in pieces for i in range(1, len(p))} | pieces for pieces in (opening, going)
        )

    @classmethod
    def from_vocabulary(cls, path: str) -> Lattice:
        """Scores of a rank-based vocabulary are minus the rank: weights fall as 1 / rank."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        opening: dict[str, float] = {}
        going: dict[str, float] = {}
        byte = [1.0 / (model.get_piece_size() + b) for b in range(256)]
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            piece, weight = model.id_to_piece(i), 1.0 / (2.0 - model.get_score(i))
            if piece.startswith(MARK):
                if MARK not in piece[1:]:
                    opening[piece[1:]] = weight
            elif MARK not in piece:
                going[piece] = weight
        opening.setdefault("", 0.1)
        return cls.normalised(opening, going, byte, sum(going.values()) / 3)

    @classmethod
    def normalised(cls, opening, going, byte, stop) -> Lattice:
        log_open = math.log(sum(opening.values()))
        log_go = math.log(sum(going.values()) + sum(byte) + stop)
        return cls(
            {p: math.log(w) - log_open for p, w in opening.items()},
            {p: math.log(w) - log_go for p, w in going.items()},
            [math.log(w) - log_go for w in byte],
            math.log(stop) - log_go,
        )

    def _bytes(self, char: str) -> float:
        return sum(self.byte[b] for b in char.encode())

    def steps(self, word: str) -> list[list[tuple[int, str, float]]]:
        """For each place in ``word`` the pieces that start there: ``(end, piece, log probability)``."""
        walk, n = self.go_walk, len(word)
        out = []
        for start in range(n):
            found = []
            for end in range(start + 1, n + 1):
                piece = word[start:end]
                p = walk.get(piece)
                if p is None:
                    break
                if p != NEVER:
                    found.append((end, piece, p))
            if not found or found[0][0] != start + 1:
                found.insert(0, (start + 1, "", self._bytes(word[start])))
            out.append(found)
        return out

    def starts(self, word: str) -> list[tuple[int, str, float]]:
        """The pieces that open ``word``, the bare mark among them."""
        out = [(0, "", self.opening[""])]
        for end in range(1, len(word) + 1):
            p = self.open_walk.get(word[:end])
            if p is None:
                break
            if p != NEVER:
                out.append((end, word[:end], p))
        return out

    def log_prob(self, word: str) -> float:
        """Forward recursion: at each place, the log of the sum over all ways to reach it."""
        terms: list[list[float]] = [[] for _ in range(len(word) + 1)]
        for end, _, p in self.starts(word):
            terms[end].append(p)
        exp, log = math.exp, math.log
        for start, found in enumerate(self.steps(word)):
            at = terms[start]
            if len(at) > 1:
                top = max(at)
                here = top + log(sum([exp(t - top) for t in at]))
            else:
                here = at[0]
            for end, _, p in found:
                terms[end].append(here + p)
        at = terms[-1]
        top = max(at)
        return top + log(sum([exp(t - top) for t in at])) + self.stop

    def expected(self, word: str, opening: dict[str, float], going: dict[str, float], byte: list[float], times: float = 1.0) -> None:
        """Add the expected uses of each piece in ``times`` times ``word``: forward and backward sums,
        each place scaled by the best way to reach it so that a word may have any length."""
        n, exp, log = len(word), math.exp, math.log
        steps, starts = self.steps(word), self.starts(word)
        best = [NEVER] * (n + 1)
        for end, _, p in starts:
            best[end] = p
        for start, found in enumerate(steps):
            here = best[start]
            for end, _, p in found:
                if here + p > best[end]:
                    best[end] = here + p
        ahead = [0.0] * (n + 1)
        for end, _, p in starts:
            ahead[end] = exp(p - best[end])
        scaled = []
        for start, found in enumerate(steps):
            here, base = ahead[start], best[start]
            row = []
            for end, piece, p in found:
                q = exp(base + p - best[end])
                ahead[end] += here * q
                row.append((end, piece, q))
            scaled.append(row)
        behind = [0.0] * n + [times / ahead[n]]
        for start in range(n - 1, -1, -1):
            here, total = ahead[start], 0.0
            for end, piece, q in scaled[start]:
                through = q * behind[end]
                total += through
                if piece:
                    going[piece] += here * through
                else:
                    for b in word[start].encode():
                        byte[b] += here * through
            behind[start] = total
        for end, piece, p in starts:
            opening[piece] += exp(p - best[end]) * behind[end]

    def refined(self, counts: list[tuple[str, str, float]], n_words: int) -> Lattice:
        """New probabilities from expected counts, with the present ones as a prior."""
        opening = {p: PRIOR * math.exp(v) for p, v in self.opening.items()}
        going = {p: PRIOR * math.exp(v) for p, v in self.going.items()}
        byte = [PRIOR * math.exp(v) for v in self.byte]
        for kind, piece, uses in counts:
            if kind == "open":
                opening[piece] += uses
            elif kind == "go":
                going[piece] += uses
            else:
                byte[int(piece)] += uses
        return Lattice.normalised(opening, going, byte, PRIOR * math.exp(self.stop) + n_words)


class Pieces:
    """The lattice as arrays, for many words at once.

    Pieces are found by walking a trie whose edges ``node << 21 | code point`` are sorted;
    node 0 opens a word, node 1 continues it. A slice of words of similar length is a matrix with a
    column for each word, and the recursion goes from place to place over all columns.
    """

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        edges, at, names = {}, [], [("open", p) for p in lattice.opening] + [("go", p) for p in lattice.going]
        node_of = {"open": 0, "go": 1}
        for kind, piece in names:
            node = node_of[kind]
            for c in piece:
                node = edges.setdefault(node << 21 | ord(c), len(edges) + 2)
            at.append(node)
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.names = names
        self.keys, self.child = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.piece = np.full(len(edges) + 2, -1, np.int32)  # the piece that ends at a node
        self.piece[at] = np.arange(len(at))
        self.logs = np.array([*lattice.opening.values(), *lattice.going.values()])
        self.bare = names.index(("open", ""))
        self.piece[0] = -1
        self.widest = max(map(len, (p for _, p in names)))

    def _step(self, nodes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``nodes`` have an edge for their code, and the nodes these lead to."""
        key = nodes << 21 | codes
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = np.flatnonzero(self.keys[i] == key)
        return there, self.child[i[there]]

    def slices(self, words: list[str]) -> Iterator[np.ndarray]:
        """Places in ``words`` of those not above ``LONG`` characters, by length, about ``CELLS`` characters at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LONG]
        start = 0
        while start < len(order):
            # Columns as many as there is room for at the length of the longest of them.
            end = start + max(1, int(np.searchsorted(sizes[order[start:]] * np.arange(1, len(order) - start + 1), CELLS, "right")))
            yield order[start:end]
            start = end

    def forward(self, words: list[str]) -> tuple:
        """Log probabilities of ``words`` without their ends, and for each place and piece ending
        there the share it has in reaching that place."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        w, n = len(words), int(sizes.max())
        codes = np.full((w, n), BEYOND, np.int64)
        codes[np.arange(n) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes = codes.T.ravel()  # a row for each place
        widest = min(self.widest, n)
        # ways[t, widest - l]: a piece of l characters that ends after place t; the last row: one that opens the word.
        ways = np.full((n, widest + 1, w), NEVER)
        flat, found, ids = ways.ravel(), [], []

        def walk(cells: np.ndarray, nodes: np.ndarray, opening: bool) -> None:
            for l in range(1, widest + 1):
                inside = cells + (l - 1) * w < len(codes)
                cells, nodes = cells[inside], nodes[inside]
                there, nodes = self._step(nodes, codes[cells + (l - 1) * w])
                cells = cells[there]
                if not len(cells):
                    break
                piece = self.piece[nodes]
                ends = np.flatnonzero(piece >= 0)
                place, column = np.divmod(cells[ends] + (l - 1) * w, w)
                target = (place * (widest + 1) + (widest if opening else widest - l)) * w + column
                flat[target] = self.logs[piece[ends]]
                found.append(target)
                ids.append(piece[ends])

        walk(np.arange(len(codes)), np.ones(len(codes), np.int64), False)
        walk(np.arange(w), np.zeros(w, np.int64), True)
        # Characters that are no piece go by their bytes; what lies behind a word's end costs nothing.
        single = ways[:, widest - 1, :]
        lone = np.flatnonzero(single.ravel() == NEVER)
        chars, which = np.unique(codes[lone], return_inverse=True)
        costs = np.array([0.0 if c == BEYOND else self.lattice._bytes(chr(c)) for c in chars.tolist()])
        place, column = np.divmod(lone, w)
        by_bytes = (place * (widest + 1) + widest - 1) * w + column
        flat[by_bytes] = costs[which]
        reached = np.full((widest + n + 1, w), NEVER)
        reached[widest] = self.logs[self.bare]
        for t in range(n):
            here = ways[t]
            here[:widest] += reached[t + 1 : t + 1 + widest]
            top = here.max(axis=0)
            here -= top
            np.exp(here, out=here)
            total = here.sum(axis=0)
            here /= total
            reached[widest + t + 1] = top + np.log(total)
        scores = reached[widest + sizes, np.arange(w)]
        return scores, ways, sizes, (np.concatenate(found) if found else lone[:0], np.concatenate(ids) if ids else lone[:0]), (by_bytes, chars, which)

    def log_probs(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for i in self.slices(words):
            out[i] = self.forward([words[j] for j in i])[0] + self.lattice.stop
        for j, word in enumerate(words):
            if len(word) > LONG:
                out[j] = self.lattice.log_prob(word)
        return out

    def expected(self, words: list[str], times: list[float], uses: np.ndarray, byte: list[float]) -> None:
        """Add the expected uses of each piece in ``words``, each counted ``times``: what reaches a word's end
        is dealt back to the pieces by their shares."""
        every = np.asarray(times, float)
        for i in self.slices(words):
            _, ways, sizes, (found, ids), (by_bytes, chars, which) = self.forward([words[j] for j in i])
            n, rows, w = ways.shape
            through = np.zeros((rows + n, w))  # row widest + t: what passes place t
            through[rows - 1 + sizes, np.arange(w)] = every[i]
            for t in range(n - 1, -1, -1):
                ways[t] *= through[rows + t]
                through[t + 1 : t + rows] += ways[t, :-1]
            flat = ways.ravel()
            uses += np.bincount(ids, flat[found], len(uses))
            uses[self.bare] += through[rows - 1].sum()
            for c, u in zip(chars.tolist(), np.bincount(which, flat[by_bytes], len(chars)).tolist()):
                for b in chr(c).encode() if c != BEYOND else b"":
                    byte[b] += u
        long = [(word, c) for word, c in zip(words, times) if len(word) > LONG]
        if long:
            opening, going = dict.fromkeys(self.lattice.opening, 0.0), dict.fromkeys(self.lattice.going, 0.0)
            for word, c in long:
                self.lattice.expected(word, opening, going, byte, c)
            uses += np.array([*opening.values(), *going.values()])


def _expected_counts(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.value
        uses, byte = np.zeros(len(pieces.names)), [0.0] * 256
        for batch in batches:
            pieces.expected(batch.column("word").to_pylist(), batch.column("c").to_pylist(), uses, byte)
        rows = [(*pieces.names[i], uses[i]) for i in np.flatnonzero(uses)]
        rows += [("byte", str(b), u) for b, u in enumerate(byte) if u]
        kinds, names, counts = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch(
            [pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.float64())],
            names=["kind", "piece", "uses"],
        )

    return run


def _lattice_scores(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.value
        for batch in batches:
            scores = pieces.log_probs(batch.column("word").to_pylist())
            yield pa.record_batch([batch.column("word"), batch.column("c"), pa.array(scores, pa.float64())], names=["word", "c", "lattice"])

    return run


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _chunk_words(key, group):  # no type hints: Spark would read them
    """Distinct words of a chunk with their counts in its training texts."""
    train, rest = Counter(), set()
    for text, is_train in zip(group.column("text"), group.column("train").to_pylist()):
        words = _tokens(text.as_py())
        train.update(words) if is_train else rest.update(words)
    rest.difference_update(train)
    words = [w.decode() for w in train] + [w.decode() for w in rest]
    counts = np.concatenate([np.fromiter(train.values(), np.int64, len(train)), np.zeros(len(rest), np.int64)])
    chunk = np.full(len(words), key[0].as_py(), np.int32)
    return pa.table({"chunk": pa.array(chunk), "word": pa.array(words, pa.string()), "c": pa.array(counts)})


def _scorer(stats: dict) -> object:
    n, v, docs = (stats[k] for k in ("tokens", "vocabulary", "docs"))
    floor = n + 0.5 * (v + 1)
    # After each word comes another or the end; without training words either is as likely.
    more, end = ((n - docs) / n, math.log10(docs / n)) if n > docs else (0.5, -math.log10(2))

    def run(key, group, scored):  # no type hints: Spark would read them
        c = scored.column("c").to_numpy()
        lattice = scored.column("lattice").to_numpy()
        base = np.log10((c + 0.5) / floor)
        model = (lattice + math.log(more)) / math.log(10)
        at = {w.encode(): i for i, w in enumerate(scored.column("word").to_pylist())}.__getitem__
        n_tokens, n_known, base_score, score = [], [], [], []
        for text in group.column("text"):
            i = np.fromiter(map(at, _tokens(text.as_py())), np.int64)
            n_tokens.append(len(i) + 1)
            n_known.append(int((c[i] > 0).sum()) + (docs > 0))
            base_score.append(float(base[i].sum()) + math.log10((docs + 0.5) / floor))
            score.append(float(model[i].sum()) + end)
        return pa.table(
            {
                "doc_id": group.column("doc_id"),
                "held_out": pa.array([not t for t in group.column("train").to_pylist()], pa.bool_()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([n] * len(score), pa.int64()),
                "base_score": pa.array(base_score, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return run


def held_out_ids(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def score_texts(docs: DataFrame, vocabulary: str = VOCABULARY, em_rounds: int = EM_ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``[doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score]`` for every row.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts are
    the end token alone. A null doc_id counts as the empty string, a training document.
    Repeated rows count and are scored each. Without training words the vocabulary's own
    weights are the lattice's. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select("doc_id", text_of().alias("text"), (~held_out_ids(F.col("doc_id"))).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("train").cast("bigint")).alias("docs")).first()
    chunks = max(1, -(-(size["bytes"] or 0) // chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    found = stage(rows.groupBy("chunk").applyInArrow(_chunk_words, "chunk int, word string, c bigint"), "lm-chunk-words")
    words = stage(found.groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    one = lambda cond: F.count(F.when(cond, 1))
    got = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), one(F.col("c") > 0).alias("types")
    ).first()
    n_docs = size["docs"] or 0
    stats = {
        "tokens": got["tokens"] + n_docs,
        "vocabulary": got["types"] + (n_docs > 0),
        "docs": n_docs,
    }
    lattice = Lattice.from_vocabulary(vocabulary)
    for _ in range(em_rounds if got["types"] else 0):
        pieces = sc.broadcast(Pieces(lattice))
        uses = words.where("c > 0").mapInArrow(_expected_counts(pieces), "kind string, piece string, uses double")
        # At most one row a piece of the vocabulary.
        uses = uses.groupBy("kind", "piece").agg(F.sum("uses").alias("uses")).collect()
        pieces.destroy()
        lattice = lattice.refined([tuple(r) for r in uses], got["tokens"])
    pieces = sc.broadcast(Pieces(lattice))
    scored = stage(words.mapInArrow(_lattice_scores(pieces), "word string, c bigint, lattice double"), "lm-scored")
    pieces.destroy()
    lookup = found.select("chunk", "word").join(scored, "word")
    return rows.groupBy("chunk").cogroup(lookup.groupBy("chunk")).applyInArrow(
        _scorer(stats),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )


def op5_lattice_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
