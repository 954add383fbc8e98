from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from slotwatch.functions import text as X
from slotwatch.operators.ranks import register_percentile_floor


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", make(F.col("v"))).orderBy("i").collect()]


def cut(s: str, n: int) -> str:
    return s.encode()[:n].decode(errors="ignore")


def test_truncate_matches_byte_prefix(spark):
    rng = random.Random(7)
    alphabet = "aé漢😀 \t"
    values = ["x" * 198 + "😀", "y" * 500, "", "z" * 200]
    values += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(260))) for _ in range(200)]
    for n in (0, 1, 60, 200):
        assert column(spark, values, lambda c: X.truncate_utf8(c, n)) == [cut(v, n) for v in values]


def test_sanitise_body(spark):
    values = ["a\x1b[31mb", "a\x7fb", "a\nb\rc", "a\x00b\x07c", "a\tb", "é漢"]
    assert column(spark, values, X.sanitise_body) == ["a[31mb", "ab", "abc", "a?b?c", "a\tb", "é漢"]


def test_cut_comes_before_cleaning(spark):
    body = "\x1b" * 10 + "a" * 300
    assert column(spark, [body], X.issue_body) == ["a" * 190]


def test_sanitise_display(spark):
    values = ["a\x1bb", "a\x7fb", "a\tb", "é\n"]
    assert column(spark, values, X.sanitise_display) == ["a�b", "a�b", "a\tb", "é�"]


def test_numbers_and_hashes(spark):
    values = ["5", "+5", " 5", "5 ", "-5", "", "0005", "9223372036854775807", "9223372036854775808", "5\n"]
    assert column(spark, values, X.parse_u64) == [5, 5, None, None, None, None, 5, 2**63 - 1, None, None]
    hashes = ["A" * 31, "A" * 32, "A" * 48, "A" * 49, "A" * 40 + "l", "A" * 40 + "\n"]
    assert column(spark, hashes, X.valid_base58) == [False, True, True, False, False, False]


def test_durations(spark):
    secs = [5, 60, 65, 3600, 3660, 3665, 76000]
    full = ["5s", "1m 0s", "1m 5s", "1h 0m 0s", "1h 1m 0s", "1h 1m 5s", "21h 6m 40s"]
    head = ["5s", "1m", "1m 5s", "1h", "1h 1m", "1h 1m 5s", "21h 6m 40s"]
    assert column(spark, secs, X.humanize_full, "bigint") == full
    assert column(spark, secs, X.humanize_header, "bigint") == head
    assert column(spark, secs, X.humanize_coarse, "bigint") == ["5s", "1m", "1m", "1h", "1h", "1h", "21h"]
    assert column(spark, secs, X.humanize_hm, "bigint") == ["0h 0m", "0h 1m", "0h 1m", "1h 0m", "1h 1m", "1h 1m", "21h 6m"]
    assert column(spark, [600, 5400, 90, 7200], X.humanize_bucket, "bigint") == ["10m", "1h 30m", "90s", "2h"]
    assert column(spark, [0, 999, 1000, 1234567], X.commas, "bigint") == ["0", "999", "1,000", "1,234,567"]


@pytest.mark.parametrize("text,secs", [("10m", 600), ("60s", 60), ("1h", 3600), ("24h", 86400), (" 5m ", 300)])
def test_bucket_argument(text, secs):
    assert X.parse_bucket_duration(text) == secs


@pytest.mark.parametrize("text", ["59s", "25h", "10", "10d", "", "m", "-5m", "1.5h"])
def test_bucket_argument_errors(text):
    with pytest.raises(ValueError):
        X.parse_bucket_duration(text)


def test_percentile_function(spark):
    register_percentile_floor(spark)
    row = spark.sql(
        "SELECT percentile_floor(sequence(1L, 10L), 0D) a, percentile_floor(sequence(1L, 10L), 0.5D) b,"
        " percentile_floor(sequence(1L, 10L), 9D) c, percentile_floor(array(), 0.5D) d,"
        " percentile_floor(sequence(1L, 10L), double('NaN')) e, percentile_floor(array(7L), 0.95D) f"
    ).first()
    assert tuple(row) == (1, 5, 10, None, 1, 7)
