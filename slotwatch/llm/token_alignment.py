"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Tokens of both tokenizers cover the same bytes. Every token points to the farthest-right
token of the other tokenizer that it overlaps; where both end together the second
tokenizer's token points to itself. Doubling all pointers at once leads each token
to the last one of its connected component, in as many steps as the logarithm of the longest
component, and that terminal token is the group's label. Tokens that end together are linked.

A text is encoded in segments, cut at a space between two letters or digits. Both
tokenizers begin a token there, so groups never cross a cut, and a task holds one
slice of segments whatever the length of a text.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwatch.llm.common import stage, table

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
SEGMENT = 1 << 15  # code points after which a text is cut at the next safe space
SLICE = 1 << 18  # code points that are encoded together
COMMON_PAIRS = 1 << 19  # at most so many pairs are broadcast with their counts, the commonest; others are joined
# Fixed value: how a byte-level vocabulary's texts are parted before merging.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for
    themselves, the others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and their ids as text with each separator."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        code = byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_fast = self._ranked(a_path, code)
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(code[c] for c in token)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.n_b))
        ]
        self.a_size, self.b_size = (np.array([len(x) for x in every], np.int64) for every in (self.a_bytes, self.b_bytes))
        # Number 2 * id is the id and a comma; odd numbers close a group's first or second half.
        self.names = [f"{i}{s}" for n, close in ((self.n_a, "|"), (self.n_b, ";")) for i in range(n) for s in (",", close)]

    @staticmethod
    def _ranked(a_path: str, code: dict[str, int]):
        """The same vocabulary by rank, which encodes four times as fast, where its file allows it:
        plain byte-level merges whose order is that of the ids. None otherwise."""
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        model, words = spec["model"], spec["pre_tokenizer"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        plain = words == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": words.get("trim_offsets"), "use_regex": True}
        if not plain or spec["normalizer"] or model.get("ignore_merges") or any(model["vocab"][t] != 256 + i for i, t in enumerate(merged)):
            return None
        ranks = {bytes(code[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merged)}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments, each of which opens with a space (which the second tokenizer adds itself)."""
        # The fast form needs stack for long runs of one kind: uncut long segments go the plain way.
        a = [
            self.a_fast.encode_ordinary(s) if self.a_fast and len(s) <= 2 * SEGMENT else self.a.encode_batch_fast([s], add_special_tokens=False)[0].ids
            for s in segments
        ]
        return a, self.b.encode([s[1:] for s in segments], num_threads=1)

    def exact(self, segment: str, a: list[int], b: list[int]) -> bool:
        want = segment.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))


@functools.cache
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For all first and then all second tokens, the second token (its number) that ends their group."""
    n = len(a_end)
    over_a = np.searchsorted(b_end, a_end)  # the second token that holds a first token's last byte
    over_b = np.searchsorted(a_end, b_end)
    itself = n + np.arange(len(b_end))
    to = np.concatenate([n + over_a, np.where(a_end[over_b] == b_end, itself, over_b)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to - n
        to = further


@dataclass
class Aligned:
    n_a: int
    n_b: int
    groups: str  # every group closed by ";"
    links: np.ndarray


def aligned(pair: Pair, segments: list[str]) -> list[Aligned | None]:
    """Groups and links of each segment; None where the tokens' bytes are not the segment's."""
    ids_a, ids_b = pair.encoded(segments)
    good = [i for i, s in enumerate(segments) if pair.exact(s, ids_a[i], ids_b[i])]
    out: list[Aligned | None] = [None] * len(segments)
    if not good:
        return out
    a, b = (np.concatenate([np.array(ids[i], np.int64) for i in good]) for ids in (ids_a, ids_b))
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    last = terminals(a_end, b_end)
    closes_b = last[len(a) :] == np.arange(len(b))
    group = np.cumsum(closes_b)  # from 1, counted at each closing token
    last_b = np.flatnonzero(closes_b)
    last_a = np.searchsorted(a_end, b_end[last_b])
    closes_a = np.zeros(len(a), bool)
    closes_a[last_a] = True
    of_a, of_b = group[last[: len(a)]] - 1, group[last[len(a) :]] - 1
    numbers = np.empty(len(a) + len(b), np.int64)
    numbers[np.arange(len(a)) + np.append(0, last_b + 1)[of_a]] = 2 * a + closes_a
    numbers[np.arange(len(b)) + last_a[of_b] + 1] = 2 * (pair.n_a + b) + closes_b
    names = [pair.names[k] for k in numbers.tolist()]
    links = a[last_a] * pair.n_b + b[last_b]
    at_a = at_b = at_g = 0
    for i in good:
        n_a, n_b = len(ids_a[i]), len(ids_b[i])
        n_g = int(np.count_nonzero(closes_b[at_b : at_b + n_b]))
        out[i] = Aligned(n_a, n_b, "".join(names[at_a + at_b : at_a + at_b + n_a + n_b]), links[at_g : at_g + n_g])
        at_a, at_b, at_g = at_a + n_a, at_b + n_b, at_g + n_g
    return out


def segments_of(text: str) -> Iterator[str]:
    """Space and text, cut at the first safe space after every SEGMENT code points."""
    text = " " + text
    at = 0
    while len(text) - at > SEGMENT:
        cut = SAFE_CUT.search(text, at + SEGMENT)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _slices(texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Segments that are encoded together, with the numbers of their texts."""
    run: list[str] = []
    of: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for s in segments_of(text) if text else ():
            run.append(s)
            of.append(i)
            size += len(s)
            if size >= SLICE:
                yield run, of
                run, of, size = [], [], 0
    if run:
        yield run, of


@dataclass
class Row:
    n_a: int = 0
    n_b: int = 0
    groups: list[str] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    broken: bool = False

    def add(self, got: Aligned | None) -> None:
        if got is None or self.broken:
            self.__init__(broken=True)
        else:
            self.n_a += got.n_a
            self.n_b += got.n_b
            self.groups.append(got.groups)
            self.links.append(got.links)


def _rows(doc_ids: pa.Array, rows: list[Row]) -> pa.RecordBatch:
    links = [np.sort(np.concatenate(r.links)) if r.links else np.zeros(0, np.int64) for r in rows]
    sizes = [len(x) for x in links]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": doc_ids,
            "n_a": pa.array([r.n_a for r in rows], pa.int64()),
            "n_b": pa.array([r.n_b for r in rows], pa.int64()),
            "n_groups": pa.array(sizes, pa.int64()),
            "groups": pa.array(["".join(r.groups)[:-1] for r in rows], pa.string()),
            "links": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(links))),
        }
    )


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        for batch in batches:
            doc_ids, done = batch.column("doc_id"), 0
            rows: list[Row] = []  # texts from number ``done`` on; the last may have more segments to come
            for segments, of in _slices(t.as_py() for t in batch.column("text")):
                for i, got in zip(of, aligned(pair, segments)):
                    rows += [Row() for _ in range(i + 1 - done - len(rows))]
                    rows[-1].add(got)
                *ready, open_ = rows
                if ready:
                    yield _rows(doc_ids.slice(done, len(ready)), ready)
                rows, done = [open_], done + len(ready)
            rows += [Row() for _ in range(batch.num_rows - done - len(rows))]
            if rows:
                yield _rows(doc_ids.slice(done, len(rows)), rows)

    return run


def align(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """``[doc_id, n_a, n_b, n_groups, groups, links]`` for every row of ``docs`` (doc_id, text).

    ``groups`` has each group's ids of both tokenizers as ``a1,a2|b1;a3|b2,b3``; ``links`` has, for every
    pair of tokens that end together and in ascending order, its number (first id times the size of the second vocabulary plus second id).
    Tokens are never empty, so a group has one link. Null and empty texts, and texts
    that one of the tokenizers does not give back byte for byte, have no tokens: zeros and an empty ``groups``.
    Special tokens' strings are plain text. Repeated rows are aligned each, other
    columns are ignored, an empty table gives an empty result. A text without any space between letters or digits is one segment.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _align(a_path, b_path), "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<bigint>"
    )


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """``[pair, n, best]`` of a column ``pair``: occurrences and whether no pair of the same second token has more."""
    counts = stage(links.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "align-counts")
    second = F.col("pair") % n_b
    most = counts.groupBy(second.alias("b")).agg(F.max("n").alias("most"))  # at most n_b rows: one a vocabulary entry
    return counts.join(F.broadcast(most), second == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))


def _common_from(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs occur as often or more."""
    by_size = counts.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count(F.lit(1)).alias("k")).collect()  # 64 rows at most
    above, floor = 0, 1 << 62
    for e, k in sorted(map(tuple, by_size), reverse=True):
        above += k
        if above > most:
            break
        floor = 1 << e
    return floor


def link_figures(rows: DataFrame, n_b: int, common: int = COMMON_PAIRS) -> DataFrame:
    """``[rid, n_best, count_sum]`` of the rows ``[rid, links]`` that have links.

    The commonest pairs, at most ``common``, are broadcast with their counts. All other
    links meet their counts in a shuffled join; each of those pairs is rare, so none is a hot key.
    """
    links = rows.select("rid", F.explode("links").alias("pair"))
    counts = stage(pair_counts(links, n_b), "align-best")
    floor = _common_from(counts, common)
    usual = links.join(F.broadcast(counts.where(F.col("n") >= floor)), "pair", "left")
    found = usual.where("n is not null").select("rid", "n", "best")
    rare = counts.where(F.col("n") < floor)
    if not rare.isEmpty():
        rest = usual.where("n is null").groupBy("rid", "pair").agg(F.count(F.lit(1)).alias("times"))
        rest = rest.join(rare, "pair").select("rid", (F.col("n") * F.col("times")).alias("n"), (F.col("best") * F.col("times")).alias("best"))
        found = found.unionByName(rest)
    return found.groupBy("rid").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    rows = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = rows.select("doc_id", "n_a", "n_b", "n_groups", "links", digest.alias("groups_sha256"))
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "align-rows")
    figures = link_figures(rows.select("rid", "links"), second_size())
    zero = F.lit(0).cast("bigint")
    return rows.drop("links").join(figures, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )


def second_size(b_path: str = PIECE_BPE) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
