"""Token alignment against a plain merge of both tokenizers' offsets."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import pytest

from slotwatch.llm import token_alignment as A

DOCS = "doc_id bigint, text string, pair string, n string, rid string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=A.PIECE_BPE)
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in letters)}
    of_id = {i: bytes(code[c] for c in t) for t, i in json.load(open(A.BYTE_BPE))["model"]["vocab"].items()}
    return a, b, of_id


def spans(pieces):
    at, out = 0, []
    for i, raw in pieces:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(tools, rows):
    """Texts are encoded whole here; the operator cuts long ones."""
    a_tok, b_tok, of_id = tools
    docs = []
    for _, text, *_ in rows:
        want = (" " + (text or "")).encode()
        a = [(i, of_id[i]) for i in a_tok.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in b_tok.encode(text or ""):
            p = b_tok.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            docs.append(None)
            continue
        a, b = spans(a), spans(b)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, at = [], [0, 0]
        for cut in cuts:
            group = ([], [])
            for side, (tokens, ids) in enumerate(zip((a, b), group)):
                while at[side] < len(tokens) and tokens[at[side]][2] <= cut:
                    ids.append(tokens[at[side]][0])
                    at[side] += 1
            groups.append(group)
        ends_a, ends_b = {e: i for i, _, e in a}, {e: i for i, _, e in b}
        docs.append((len(a), len(b), cuts, groups, [(ends_a[e], ends_b[e]) for e in cuts]))
    count = Counter(link for d in docs if d for link in d[4])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (doc_id, *_), d in zip(rows, docs):
        if d is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, cuts, groups, links = d
        digest = hashlib.sha256(";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups).encode()).hexdigest()
        counts = [count[x] for x in links]
        out.append((doc_id, n_a, n_b, len(cuts), len(links), sum(n == best[b] for n, (_, b) in zip(counts, links)), sum(counts), digest))
    return out


TEXTS = [
    None, "", " ", "a", "hello world", "hello  world ", " lead", "Ünïcödé ½ ﬁ 日本語テキスト", "é   x", "a\tb\nc\r\n\r\n  d",
    "<s> </s> <|endoftext|> <unk> <0x41>", "under_score under▁line", "▁", "\U0001f600\U0001f468‍\U0001f469 ok", "x" * 5000, "don't it's we'll 12,345.67",
    "hello world", "\x00 nul", "ab " * 200,
]


def query(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = A.op11_token_alignment(spark, str(tmp_path))
    assert got.columns == cols
    return sorted(map(tuple, got.collect()), key=repr)


def test_equals_brute_force(spark, tools, tmp_path):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abé ,.\n1_-'Zß日") for _ in range(rng.randint(1, 120))) for _ in range(150)]
    rows = [(i if i % 9 else None, t, "c", "c", "c") for i, t in enumerate(texts)] + [(1, "a", "", "", ""), (4, "hello world", "", "", "")]
    assert query(spark, rows, tmp_path) == sorted(brute(tools, rows), key=repr)


def test_documents_cut_and_counted_by_join(spark, tools, tmp_path, monkeypatch):
    """Small segments, slices and broadcast bound change nothing."""
    monkeypatch.setattr(A, "SEGMENT", 40)
    monkeypatch.setattr(A, "SLICE", 300)
    monkeypatch.setattr(A.link_figures, "__defaults__", (20,))
    rows = [(r.doc_id, r.text, "", "", "") for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 2500").limit(60).collect()]
    rows += [(1000 + i, t, "", "", "") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    # Workers import the module anew, so the small sizes are passed through its functions here.
    pair = A.pair_of(A.BYTE_BPE, A.PIECE_BPE)
    want = {id(r): w for r, w in zip(rows, brute(tools, rows))}
    for row in rows:
        if not row[1]:
            continue
        parts = [x for run, _ in A._slices([row[1]]) for x in A.aligned(pair, run)]
        w = want[id(row)]
        if None in parts:
            assert w[1] == 0
        else:
            assert "".join(A.segments_of(row[1])) == " " + row[1]
            digest = hashlib.sha256("".join(p.groups for p in parts)[:-1].encode()).hexdigest()
            assert (sum(p.n_a for p in parts), sum(p.n_b for p in parts), digest) == (w[1], w[2], w[7])
    got = sorted(map(tuple, A.op11_token_alignment(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(want.values(), key=repr)


def test_long_text_is_cut(tools):
    pair = A.pair_of(A.BYTE_BPE, A.PIECE_BPE)
    text = "The année 1999, naïve–ish words_with breaks. " * 4000
    parts = A.aligned(pair, list(A.segments_of(text)))
    assert len(parts) > 3 and all(parts)
    a = tools[0].encode(" " + text, add_special_tokens=False).ids
    b = tools[1].encode(text)
    flat = [g.split("|") for p in parts for g in p.groups[:-1].split(";")]
    assert [int(x) for g in flat for x in g[0].split(",")] == a and [int(x) for g in flat for x in g[1].split(",")] == b


def test_both_forms_of_the_first_tokenizer_agree():
    pair = A.pair_of(A.BYTE_BPE, A.PIECE_BPE)
    assert pair.a_fast is not None
    rng = random.Random(8)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}{c}b {c} 1{c}!{c}  {c}\n{c}" for c in map(chr, rng.sample(points, 30_000))]
    texts += [f" {c}" + c * (2 * A.SEGMENT - 2) for c in " x\n1!"]
    plain = [e.ids for e in pair.a.encode_batch_fast(texts, add_special_tokens=False)]
    assert [pair.a_fast.encode_ordinary(t) for t in texts] == plain


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
    again = tmp_path / "nulls"
    assert query(spark, [(None, None, None, None, None)], again) == [(None, 0, 0, 0, 0, 0, 0, "")]
