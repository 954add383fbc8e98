"""Personal data: against the plain patterns run from every position, and edge cases."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slotwatch.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(d) <= 19 and pii.luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [(s["kind"], s["start"], s["end"]) for s in pii.find_spans(text) if s["kind"] in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+%0123456789 ()é\n", max_size=60))
def test_base_kinds_equal_plain_patterns(text):
    assert base(text) == plain(text)


def test_examples():
    text = "Mail a.b+c@x-1.example.com, ip 10.0.0.255 and 10.0.0.256; 4111 1111 1111 1111; +1 (988) 555-2485"
    assert base(text) == plain(text)
    assert [s[0] for s in base(text)] == ["email", "ip", "card", "phone"]


def test_added_kinds():
    iban = "DE89 3704 0044 0532 0130 00"
    kinds = [s["kind"] for s in pii.find_spans(f"My iban is {iban} THEN")]
    assert kinds == ["iban"]
    assert pii.find_spans(f"{iban[:-1]}1") == []
    assert [s["kind"] for s in pii.find_spans("call 555-123-4567 now")] == ["local_phone"]
    assert pii.find_spans("part 555-123-4567 now") == []
    assert [s["kind"] for s in pii.find_spans("555-123-4567 (my phone)")] == ["local_phone"]
    assert pii.find_spans("the hotel 555-123-4567 is called so") == []
    far = "x" * 33
    assert [s["kind"] for s in pii.find_spans(f"Tel. {far} 555-123-4567")] == ["local_phone"]
    assert pii.find_spans(f"hotel {far} 555-123-4567") == []
    assert [s["kind"] for s in pii.find_spans(f"555-123-4567 {far} phones")] == ["local_phone"]
    assert pii.find_spans(f"555-123-4567 {far} telegrams") == []


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, "write x@y.org", 1), (1, "write x@y.org", 1), (2, None, 1), (None, "", 1), (3, "1 " * 50_000, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_email, r.spans) for r in pii.op2_pii_spans(spark, str(tmp_path)).collect())
    assert got == [("1", 1, "email:6:13"), ("1", 1, "email:6:13"), ("2", 0, ""), ("3", 0, ""), ("None", 0, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string, spans int").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op2_pii_spans(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 50_000, "1-" * 100_000, "A1" * 100_000])
def test_very_long_runs_are_linear(text):
    import time

    start = time.process_time()
    pii.find_spans(text)
    assert time.process_time() - start < 5


def test_redact(spark):
    rows = [(1, "write x@y.org now", 17, "k"), (2, None, None, "k"), (3, "", 0, None), (3, "", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, spans string")
    got = {(r.doc_id, r.text, r.n_chars, r.spans) for r in pii.redact(docs).collect()}
    assert got == {(1, "write <EMAIL> now", 17, "k"), (2, None, None, "k"), (3, "", 0, None)}
    assert pii.redact(docs.limit(0)).count() == 0
