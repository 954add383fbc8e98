"""Secrets in texts: fixed patterns, and a linear-chain conditional random field beside them.

The field tags tokens as the begin of a secret, inside one, or outside. Its features
are the token's shape (length, classes of characters, how often they change), the words
before and after it, white space around it, and the file's shares of digits and punctuation. It is trained here
on a bounded sample of windows: values that the patterns find are labelled, and made-up secrets of other forms
are put into windows of the corpus, so that the field learns more than the
patterns know. Texts are decoded by Viterbi, in numpy: blocks of tokens are taken together
as max-plus products and then joined in order, which gives the best path of the whole chain.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwatch.llm import hashing
from slotwatch.llm.common import stage, table

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "crf")

OUT, BEGIN, INSIDE = 0, 1, 2
SAMPLE_ROWS = 600  # at most twice as many windows are trained on
DRAWN = 64  # texts that are searched for secrets to train on, as a multiple of it
LEAST_WINDOWS = 300
WINDOW = 64  # tokens of a training window
EPOCHS, RATE, DECAY = 30, 0.25, 2e-3
BLOCK = 256  # tokens of a Viterbi block
PIECE = 1 << 19  # bytes of a text that are tagged at a time
MARGIN = 1 << 11  # bytes on either side of a piece that are tagged with it and belong to its neighbours
SHORTEST = 12  # characters of the shortest tagged span that is reported
CUES = ("auth_key", "credential", "bearer", "private key", "access_key", "client_secret", "pwd", "signing key", "apikey", "session", "token", "secret", "password", "key")
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.digits + "abcdef", string.digits + "ABCDEF", string.ascii_letters + string.digits + "_-", string.ascii_letters + string.digits + "+/")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the base patterns, by start, then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out, key=lambda s: (s[0], s[2]))


def secret_values(text: str) -> list[tuple[int, int]]:
    """Spans that are labelled as secrets to train: assigned values, access keys, long mixed hex runs."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [m.span() for m in HEX.finditer(text) if m.end() - m.start() >= 24 and not m.group().isdigit() and not m.group().isalpha()]
    return out


# Classes of bytes: white space, part of a longer token, a token of its own; and kinds within a token.
_KIND = np.full(256, 4, np.uint8)  # symbol
for _k, _chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits), 1):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:] = 5
_CLASS = np.full(256, 2, np.uint8)
_CLASS[_KIND != 4] = 1
_CLASS[[ord(c) for c in "_+/-"]] = 1
_CLASS[hashing.SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LENGTHS = np.array([1, 2, 3, 5, 8, 12, 16, 20, 32, 48])
WORD_BITS = 12
_SHAPES = len(_LENGTHS) * 5 * 5 * 3 * 2 * 2 * 2
OFFSETS = (-4, -3, -2, -1, 1)  # neighbours whose words are features
_STARTS = np.cumsum([0, _SHAPES, *[1 << WORD_BITS] * len(OFFSETS), 9, 16, 16])
N_FEATURES = int(_STARTS[-1])


@dataclass
class Tokens:
    start: np.ndarray  # bytes
    end: np.ndarray
    doc: np.ndarray
    features: np.ndarray  # [token, feature slot]: rows of the weights


def file_features(text: bytes) -> tuple[int, int]:
    """Sixteen steps each of the shares of digits and of punctuation among the bytes of a whole text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(len(text), 1)
    step = lambda k: int(min(15, 64 * k / n))
    return step(counts[_KIND == 3].sum()), step(counts[_CLASS == 2].sum())


def tokens_of(texts: list[bytes], files: list[tuple[int, int]]) -> Tokens:
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n" + bytes(8), np.uint8)
    cls, kind = _CLASS[data], _KIND[data]
    joined = cls[1:] * cls[:-1] == 1  # with the byte before
    solid = cls > 0
    solid[-8:] = False
    start = np.flatnonzero(solid & ~np.append(False, joined))
    end = np.flatnonzero(solid & ~np.append(joined, False)) + 1
    first = np.cumsum([1, *[len(t) + 1 for t in texts]])
    doc = np.searchsorted(first, start, side="right") - 1
    size = end - start

    def inside(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int32))
        return total[end] - total[start]

    lower, upper, digits, other = (inside(kind == k) for k in (1, 2, 3, 5))
    symbols = size - lower - upper - digits - other
    changes = inside(np.append(False, kind[1:] != kind[:-1])) - (kind[start] != kind[start - 1])
    hexes = inside((kind == 3) | ((data >= 97) & (data <= 102)))
    share = np.where(digits == 0, 0, np.where(digits == size, 4, 1 + np.minimum(2, (5 * digits) // (2 * size))))
    case = np.where(lower + upper == 0, 0, np.where(upper == 0, 1, np.where(lower == 0, 2, np.where(upper == 1, 3, 4))))
    rate = np.minimum(2, (20 * changes) // (3 * size))
    shape = np.searchsorted(_LENGTHS, size, side="right") - 1
    for values, n in ((share, 5), (case, 5), (rate, 3), (other > 0, 2), (symbols > 0, 2), (hexes == size, 2)):
        shape = shape * n + values

    low = _LOWER[data].astype(np.uint64)
    word = np.minimum(size, 9).astype(np.uint64)
    for k in range(8):
        word = (word << np.uint64(7)) ^ np.where(size > k, low[start + k], np.uint64(0))
    word = (hashing.mixed(word) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    word = np.where((digits > 0) | (size > 24), 0, word | 1)  # numbers and long runs are told apart by shape alone

    n = len(start)
    features = np.empty((n, len(_STARTS) - 1), np.int32)
    features[:, 0] = shape
    for slot, by in enumerate(OFFSETS, 1):
        other_word = np.zeros(n, np.int64)
        here, there = (slice(-by, n), slice(0, n + by)) if by < 0 else (slice(0, n - by), slice(by, n))
        if n > abs(by):
            same = doc[here] == doc[there]
            other_word[here] = np.where(same, word[there], 0)
        features[:, slot] = other_word
    white = np.where(cls == 0, np.where(data == 10, 2, 1), 0)
    features[:, -3] = 3 * white[start - 1] + white[end]
    features[:, -2:] = np.array(files, np.int32).reshape(-1, 2)[doc]
    features += _STARTS[:-1].astype(np.int32)
    return Tokens(start, end, doc, features)


@dataclass
class Field:
    """Weights [feature, tag], transitions [from, to] and scores of the first tag."""

    weights: np.ndarray
    moves: np.ndarray
    opening: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        field = cls(np.zeros((N_FEATURES, 3)), np.zeros((3, 3)), np.zeros(3))
        field.moves[OUT, INSIDE] = field.opening[INSIDE] = -30.0
        return field

    def emissions(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t.start), 3), self.weights.dtype)
        for slot in range(t.features.shape[1]):
            out += self.weights[t.features[:, slot]]
        return out

    def steps(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[token, from, to]; a text's first token comes from anywhere at the opening score."""
        return np.where(first[:, None, None], self.opening[None, None, :], self.moves[None]) + emit[:, None, :]

    def best_path(self, t: Tokens) -> np.ndarray:
        """The likeliest tags of all texts' chains."""
        n = len(t.start)
        if not n:
            return np.zeros(0, np.uint8)
        blocks = -(-n // BLOCK)
        first = np.ones(blocks * BLOCK, bool)
        first[1:n] = t.doc[1:] != t.doc[:-1]
        emit = np.zeros((blocks * BLOCK, 3))
        emit[:n] = self.emissions(t)
        step = self.steps(emit, first).reshape(blocks, BLOCK, 3, 3)
        # Best scores from every state before a block to every state at its end.
        through = np.where(np.eye(3, dtype=bool), 0.0, -1e9)[None].repeat(blocks, 0)
        for i in range(BLOCK):
            through = (through[:, :, :, None] + step[:, i, None]).max(2)
        entry = np.zeros((blocks, 3))
        for b in range(1, blocks):
            score = (entry[b - 1][:, None] + through[b - 1]).max(0)
            entry[b] = score - score.max()
        came = np.empty((blocks, BLOCK, 3), np.uint8)
        score = entry
        for i in range(BLOCK):
            reach = score[:, :, None] + step[:, i]
            came[:, i] = reach.argmax(1)
            score = reach.max(1)
        # From every state at a block's end back to the state before it, then the blocks in order.
        every = np.arange(blocks)[:, None]
        state = np.tile(np.arange(3, dtype=np.uint8), (blocks, 1))
        for i in range(BLOCK - 1, -1, -1):
            state = came[every, i, state]
        at = int(score[-1].argmax())
        ends = np.empty(blocks, np.uint8)
        for b in range(blocks - 1, -1, -1):
            ends[b], at = at, int(state[b, at])
        tags = np.empty((blocks, BLOCK), np.uint8)
        row = np.arange(blocks)
        for i in range(BLOCK - 1, -1, -1):
            tags[:, i] = ends
            ends = came[row, i, ends]
        return tags.reshape(-1)[:n]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(field: Field, emit: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equally long chains [chain, place]: tag and move probabilities and log normalisers; ``real`` places lead."""
    n, length, _ = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = field.opening + emit[:, 0]
    for i in range(1, length):
        on = _log_sum(alpha[:, i - 1, :, None] + field.moves, 1) + emit[:, i]
        alpha[:, i] = np.where(real[:, i, None], on, alpha[:, i - 1])
    for i in range(length - 2, -1, -1):
        back = _log_sum(field.moves + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where(real[:, i + 1, None], back, 0.0)
    norm = _log_sum(alpha[:, -1], 1)
    tags = np.exp(alpha + beta - norm[:, None, None]) * real[:, :, None]
    moves = alpha[:, :-1, :, None] + field.moves + (emit + beta)[:, 1:, None, :] - norm[:, None, None, None]
    return tags, np.exp(moves) * real[:, 1:, None, None], norm


def likelihood(field: Field, features: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean log likelihood a chain and its gradient by weights, moves and opening scores."""
    n = len(tags)
    emit = field.weights[features].sum(2)
    p_tag, p_move, norm = marginals(field, emit, real)
    gold = (np.eye(3)[tags]) * real[:, :, None]
    score = (emit * gold).sum((1, 2)) + field.opening[tags[:, 0]]
    both = real[:, 1:]
    score += (field.moves[tags[:, :-1], tags[:, 1:]] * both).sum(1)
    miss = (gold - p_tag).reshape(-1, 3)
    weights = np.zeros_like(field.weights)
    for tag in range(3):
        for slot in range(features.shape[2]):
            weights[:, tag] += np.bincount(features[:, :, slot].reshape(-1), miss[:, tag], N_FEATURES)
    pairs = np.bincount((tags[:, :-1] * 3 + tags[:, 1:])[both], minlength=9).reshape(3, 3)
    return float((score - norm).mean()), [weights / n, (pairs - p_move.sum((0, 1))) / n, (gold[:, 0] - p_tag[:, 0]).sum(0) / n]


def _planted(rng: random.Random, words: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """Words with a made-up secret among them, and where its value is."""
    alphabet = rng.choice(ALPHABETS)
    value = "".join(rng.choice(alphabet) for _ in range(rng.choice((16, 20, 24, 32, 40, 48, 64))))
    value = rng.choice(("", "", "", "ghp_", "sk-", "xoxb-")) + value
    quote = rng.choice(("", '"', "'"))
    cue = rng.choice(CUES)
    lead = rng.choice((f"{cue} = {quote}", f"{cue}: {quote}", f"{cue}={quote}", f"{cue.upper()}={quote}", f'"{cue}": "', f"{cue} "))
    at = rng.randint(0, len(words))
    before = " ".join(words[:at]) + " " + lead
    return f"{before}{value}{quote} {' '.join(words[at:])}", [(len(before), len(before) + len(value))]


Window = tuple[str, list[tuple[int, int]], tuple[int, int]]  # text, secret spans, file features


def training_windows(text: str, seed: int) -> list[Window]:
    """Windows of one text: around a found secret or at a drawn place, and one with a planted secret."""
    rng = random.Random(seed)
    file = file_features(text.encode())
    found = secret_values(text)
    centre = rng.choice(found)[0] if found else rng.randrange(max(len(text), 1))
    lo = max(0, centre - 4 * WINDOW)
    window = text[lo : centre + 4 * WINDOW]
    # What is cut by the window's edge is no token of it.
    lead = len(window) - len(window.lstrip()) if not lo else len(re.match(r"\S*", window).group())
    window = window[lead:]
    inside = [(a - lo - lead, b - lo - lead) for a, b in found if a >= lo + lead and b <= lo + lead + len(window)]
    return [(window, inside, file), (*_planted(rng, window.split()[: WINDOW // 2] if not inside else []), file)]


def fit_windows(windows: list[Window], epochs: int = EPOCHS) -> Field:
    """A field trained by gradient steps of adapted size. Fewer than LEAST_WINDOWS are filled up
    with secrets planted into them, so a small table trains a usable field too."""
    rng = random.Random(6)
    windows = list(windows)
    given = windows or [("", [], (0, 0))]
    while len(windows) < LEAST_WINDOWS:
        text, spans, file = given[len(windows) % len(given)]
        windows.append((*_planted(rng, text.split()[: WINDOW // 2] if not spans else []), file))
    raw = [w.encode() for w, _, _ in windows]
    t = tokens_of(raw, [f for _, _, f in windows])
    first = np.cumsum([1, *[len(r) + 1 for r in raw]])
    tags = np.zeros(len(t.start), np.int64)
    for i, (w, spans, _) in enumerate(windows):
        for a, b in spans:
            lo, hi = first[i] + len(w[:a].encode()), first[i] + len(w[:b].encode())
            inside = np.flatnonzero((t.start >= lo) & (t.end <= hi))
            tags[inside] = INSIDE
            tags[inside[:1]] = BEGIN
    at = np.searchsorted(t.doc, np.arange(len(windows)))
    length = 2 * WINDOW
    features = np.broadcast_to(_STARTS[:-1].astype(np.int32), (len(windows), length, len(_STARTS) - 1)).copy()
    gold = np.zeros((len(windows), length), np.int64)
    real = np.zeros((len(windows), length), bool)
    place = np.arange(len(t.start)) - at[t.doc]
    keep = place < length
    features[t.doc[keep], place[keep]] = t.features[keep]
    gold[t.doc[keep], place[keep]] = tags[keep]
    real[t.doc[keep], place[keep]] = True
    used = real.any(1)
    features, gold, real = features[used], gold[used], real[used]
    field = Field.blank()
    parts = [field.weights, field.moves, field.opening]
    seen = [np.zeros_like(p) for p in parts]
    for _ in range(epochs):
        _, slopes = likelihood(field, features, gold, real)
        for part, slope, s in zip(parts, slopes, seen):
            slope = slope - DECAY * part * (np.abs(part) < 30)
            s += slope**2
            part += RATE * slope / (np.sqrt(s) + 1e-8)
    return field


def fit_texts(texts: list[str]) -> Field:
    return fit_windows([w for i, t in enumerate(texts) for w in training_windows(t, i)])


def _windows(rare: int):
    """Training windows of drawn texts; of those without a secret only the lowest hashes are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column("k").to_pylist(), batch.column("text")):
                text = text.as_py()
                hot = bool(secret_values(text))
                if key < rare or hot:
                    for n, (window, spans, file) in enumerate(training_windows(text, key)):
                        out.append({"hot": hot, "k": key, "n": n, "window": window, "spans": [x for s in spans for x in s], "file": list(file)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("hot", pa.bool_()), ("k", pa.int64()), ("n", pa.int64()), ("window", pa.string()), ("spans", pa.list_(pa.int64())), ("file", pa.list_(pa.int64()))]))

    return run


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    """A field trained on a bounded sample: about DRAWN times ``rows`` texts are drawn by hash, those of them with a secret
    and about half of ``rows`` without one give windows, and at most 2 * ``rows`` windows come to the driver."""
    key = F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1))
    share = min(1.0, DRAWN * rows / max(docs.count(), 1))
    drawn = docs.select(key.alias("k"), "text").where("text is not null").where(F.col("k") < int(share * (1 << 40)))
    rare = int(share * (1 << 40) / (2 * DRAWN)) if share < 1 else 1 << 40
    kept = drawn.mapInArrow(_windows(rare), "hot boolean, k bigint, n bigint, window string, spans array<bigint>, file array<bigint>")
    kept = stage(kept.dropDuplicates(["k", "n"]), "secret-windows")
    found = [r for part in (F.col("hot"), ~F.col("hot")) for r in kept.where(part).orderBy("k", "n").limit(rows).collect()]
    return fit_windows([(r.window, list(zip(r.spans[::2], r.spans[1::2])), (r.file[0], r.file[1])) for r in found])


def _pieces(text: bytes) -> Iterator[tuple[int, int, int, int]]:
    """``(from, to, own from, own to)`` in bytes: pieces with margins; each byte is one piece's own. Cuts are at white space where there is any near."""
    at = 0
    while at < len(text):
        cut = len(text)
        if cut - at > PIECE:
            near = re.compile(rb"\s").search(text, at + PIECE, at + 2 * PIECE)
            cut = near.start() if near else at + PIECE
        lo, hi = max(0, at - MARGIN), min(len(text), cut + MARGIN)
        yield lo, hi, at, cut
        at = cut


def tagged(field: Field, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Byte spans of the field's secrets in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    files = [file_features(x) for x in texts]
    parts = [(i, *piece) for i, x in enumerate(texts) for piece in _pieces(x)]
    at = 0
    while at < len(parts):
        run, size = [], 0
        while at < len(parts) and (not run or size + parts[at][2] - parts[at][1] <= PIECE):
            run.append(parts[at])
            size += parts[at][2] - parts[at][1]
            at += 1
        t = tokens_of([texts[i][lo:hi] for i, lo, hi, _, _ in run], [files[r[0]] for r in run])
        tags = field.best_path(t)
        begins = np.flatnonzero(tags == BEGIN)
        stops = np.flatnonzero(np.append(tags[1:] != INSIDE, True))
        ends = stops[np.searchsorted(stops, begins)]
        offset = np.cumsum([1, *[hi - lo + 1 for _, lo, hi, _, _ in run]])
        for b, e in zip(begins.tolist(), ends.tolist()):
            i, lo, _, own, own_end = run[t.doc[b]]
            shift = lo - int(offset[t.doc[b]])
            start, end = int(t.start[b]) + shift, int(t.end[e]) + shift
            if own <= start < own_end and end - start >= SHORTEST:
                out[i].append((start, end))
    return out


def find(text: str, raw: bytes, byte_spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the tagged ones that touch none of them, in code points, by start, then kind."""
    base = base_spans(text)
    out, at, chars = list(base), 0, 0
    for start, end in byte_spans:
        chars += len(raw[at:start].decode(errors="ignore"))
        a, b = chars, chars + len(raw[start:end].decode(errors="ignore"))
        at, chars = end, b
        if not any(s < b and a < e for s, e, _ in base):
            out.append((a, b, len(KINDS) - 1))
    return sorted(out, key=lambda s: (s[0], s[2]))


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def _scan(field: Field):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, raw in hashing.slices((t.as_py() or "").encode() for t in batch.column("text")):
                spans, n_tagged = [], []
                for text, by_field in zip(raw, tagged(field, raw)):
                    found = find(text.decode(), text, by_field)
                    spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in found])
                    n_tagged.append(len(by_field))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(raw)), pa.array(spans, pa.list_(kind)), pa.array(n_tagged, pa.int64())], names=["doc_id", "spans", "n_tagged"]
                )

    return run


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``[doc_id, spans, n_tagged]`` for every row of ``docs`` (doc_id, text).

    ``spans`` are ``(kind, start, end)`` in code points, by start, then kind: assign, access and hex from
    the base patterns, crf from the field where no base span touches it; n_tagged counts all spans of the field. Without
    ``field`` one is fitted on a bounded sample of ``docs``. Null and empty texts have no
    spans; an empty table gives an empty result; repeated rows are scanned each and
    other columns are ignored. Texts above PIECE bytes are tagged in pieces that overlap.
    """
    field = field or fit(docs)
    return docs.select("doc_id", "text").mapInArrow(_scan(field), f"doc_id bigint, spans {SPANS}, n_tagged bigint")


def op12_secrets_crf(spark, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    written = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(kind) for kind in KINDS[:3]],
        F.sha2(written(F.filter(spans, lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        written(spans).alias("spans"),
        "n_tagged",
    )
