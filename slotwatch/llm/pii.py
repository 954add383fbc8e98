"""Personal data in texts: patterns propose, checksums confirm, context words weigh.

Base kinds (email, ip, card, phone) follow fixed patterns: leftmost, non-overlapping per
kind, a match that fails its test is dropped and not retried. They always stay. Added
kinds (iban, local phone numbers) stay when their score, raised by a checksum and by
words nearby, reaches ``KEEP``. Every search is linear in the text, also for a text that
is one endless run of digits or letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwatch.llm.common import table, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone")
KEEP = 0.5
REACH = 40  # code points before and after a span that are searched for context words

# Score without context, and the words that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.2}
CONTEXT = {
    "email": ("mail", "email", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "tel", "call", "fax", "mobile"),
    "iban": ("iban", "account", "bank", "konto", "compte"),
    "local_phone": ("phone", "telephone", "tel", "call", "fax", "mobile"),
}
BOOST = 0.4
LONGEST = max(len(w) for words in CONTEXT.values() for w in words)
# Whole words, also in the plural.
_CONTEXT = {
    kind: re.compile(rf"(?<![^\W\d_])(?:{'|'.join(words)})s?(?![^\W\d_])", re.I) for kind, words in CONTEXT.items()
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_GROUPED = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        # A failed try consumes nothing, but no later start before this @ can succeed.
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        for m in _IP.finditer(text, run.start(), run.end()):
            # Compare by length first: a part may have any number of digits.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                yield m.span()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 38 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if m.start() and text[m.start() - 1].isalnum():
            continue
        groups = m.group()
        while len(groups.replace(" ", "")) >= 15:  # give trailing words back one by one
            if mod97(groups.replace(" ", "")):
                yield m.start(), m.start() + len(groups)
                break
            groups = groups.rpartition(" ")[0]


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _GROUPED.finditer(text):
        if not m.start() or text[m.start() - 1] not in "+.-0123456789":
            yield m.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "local_phone": _local_phones}


def _score(text: str, kind: str, start: int, end: int) -> float:
    words = _CONTEXT[kind]
    first = max(0, start - REACH)
    # One more character before, and a whole word more behind, show where words at the rim begin and end.
    before = text[max(0, first - 1) : start]
    near = words.search(before, min(first, 1)) is not None
    if not near:
        after = words.search(text[end : end + REACH + LONGEST + 2])
        near = after is not None and after.start() < REACH
    return min(1.0, PRIOR[kind] + BOOST * near)


def find_spans(text: str) -> list[dict]:
    """All spans of one text, by kind as in ``KINDS``, then start; ends are exclusive."""
    out: list[dict] = []
    for kind in KINDS:
        added = kind not in BASE_KINDS
        taken = [(s["start"], s["end"]) for s in out] if added else []
        for start, end in _FINDERS[kind](text):
            score = _score(text, kind, start, end)
            if added and (score < KEEP or any(start < e and s < end for s, e in taken)):
                continue
            out.append({"kind": kind, "start": start, "end": end, "score": score})
    return out


def mask_spans(text: str) -> str:
    """The text with every span replaced by its kind; overlapping spans by the first one's."""
    out, at = [], 0
    for s in sorted(find_spans(text), key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)


@F.pandas_udf(SPANS)
def _spans_udf(texts: pd.Series) -> pd.Series:
    return texts.map(find_spans)


@F.pandas_udf(T.StringType())
def _mask_udf(texts: pd.Series) -> pd.Series:
    return texts.map(mask_spans)


def pii_spans(text: Column) -> Column:
    """``array<struct<kind, start, end, score>>`` of a text column; null counts as empty."""
    return _spans_udf(text_of(text))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; other columns stay, null text stays null.

    ``n_chars``, where there is one, is brought up to date.
    """
    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), _mask_udf(text_of())))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def op2_pii_spans(spark, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", pii_spans(F.col("text")).alias("s"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("s", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("s")).alias("spans"),
        *[count(kind).alias(f"n_{kind}") for kind in KINDS if kind not in BASE_KINDS],
    )
