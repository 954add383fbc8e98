"""Text expressions: safe truncation, control bytes, hashes, numbers, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the log format -------------------------------------------------
ISSUE_BODY_MAX_BYTES = 200
PREVIEW_MAX_BYTES = 60
HASH = "[1-9A-HJ-NP-Za-km-z]{32,48}"  # Base58, no 0 O I l
DIGITS = "[0-9]{1,20}"  # bounded number, used inside tuple patterns
NUMBER = r"\+?[0-9]+"  # unbounded number, one leading plus allowed
# ------------------------------------------------------------------------------------


def truncate_utf8(col: Column, max_bytes: int) -> Column:
    """Longest prefix of at most ``max_bytes`` bytes that ends on a character boundary.

    A cut inside a multi-byte character leaves bytes that are not valid UTF-8, and a
    character has at most four bytes, so one of four cut points is always valid.
    """
    raw = F.encode(col, "utf-8")
    cuts = [
        F.try_validate_utf8(F.substring(raw, 1, n).cast("string"))
        for n in range(max_bytes, max(max_bytes - 4, -1), -1)
    ]
    return F.when(F.octet_length(col) <= max_bytes, col).otherwise(F.coalesce(*cuts))


def sanitise_body(col: Column) -> Column:
    """Drop ESC, DEL, LF and CR; turn every other control byte but TAB into ``?``."""
    dropped = F.regexp_replace(col, r"[\x1B\x7F\n\r]", "")
    return F.regexp_replace(dropped, r"[\x00-\x08\x0B-\x1F]", "?")


def sanitise_display(col: Column) -> Column:
    """Turn control bytes (except TAB) and DEL into the replacement character."""
    return F.regexp_replace(col, r"[\x00-\x08\x0A-\x1F\x7F]", "�")


def issue_body(col: Column) -> Column:
    """Body kept with a WARN/ERROR line: cut first, then cleaned."""
    return sanitise_body(truncate_utf8(col, ISSUE_BODY_MAX_BYTES))


def saturating_sum(col: Column) -> Column:
    """Sum of BIGINTs that stops at the largest one instead of failing; an aggregate."""
    top = F.lit(2**63 - 1).cast("decimal(20,0)")
    total = F.sum(col.cast("decimal(20,0)"))
    return F.when(total > top, top).otherwise(total).cast("bigint")


def valid_base58(col: Column) -> Column:
    return col.rlike(rf"^{HASH}\z")


def parse_u64(col: Column) -> Column:
    """Whole-string unsigned number, or NULL. Values above 2^63-1 give NULL."""
    return F.when(col.rlike(rf"^{NUMBER}\z"), col.try_cast("bigint"))


def parse_ts_ns(col: Column) -> Column:
    """RFC 3339 text to epoch nanoseconds, or NULL when malformed."""
    shape = (
        r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
        r"(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
    )
    # Whole seconds come from the timestamp parser (it knows months and offsets); the
    # fraction is text, because timestamps stop at microseconds. Nearly every line ends
    # in Z, so only the others pay for finding their offset.
    clock = F.upper(F.substring(col, 1, 19))
    offset = F.regexp_extract(col, r"([+-][0-9]{2}:[0-9]{2})\z", 1)
    is_utc = F.upper(F.right(col, F.lit(1))) == "Z"
    moment = F.when(is_utc, clock).otherwise(F.concat(clock, offset))
    digits = F.when(is_utc, F.rtrim(F.substring(col, 21, 9), F.lit("Zz"))).otherwise(
        F.regexp_extract(F.substring(col, 21, 9), "^([0-9]*)", 1)
    )
    fraction = F.when(F.substring(col, 20, 1) == ".", F.rpad(digits, 9, "0").cast("bigint")).otherwise(0)
    seconds = F.unix_seconds(F.try_to_timestamp(moment))
    # Years outside 1677 to 2262 do not fit BIGINT nanoseconds: malformed, not an error.
    return F.when(col.rlike(shape), F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000).cast("bigint")), fraction))


def commas(col: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(col, 0)


def fixed(col: Column, digits: int) -> Column:
    """Number with a fixed count of decimals and no separators.

    Rounded from the six decimals every result has, so that the last digit does not
    depend on how an engine sums floating-point values.
    """
    exact = F.round(col.cast("double"), 6).cast("decimal(38,6)")
    return F.round(exact, digits).cast(f"decimal(38,{digits})").cast("string")


_UNITS = (("h", 3600), ("m", 60), ("s", 1))


def _spelled(secs: Column, first: Column | int, last: Column | int) -> Column:
    """Hours, minutes and seconds from place ``first`` to place ``last`` of ``_UNITS``."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    shown, above = [], None
    for unit, size in _UNITS:
        rest = secs if above is None else secs % above
        shown.append(F.concat(F.floor(rest / size).cast("string"), F.lit(unit)))
        above = size
    spelled = F.array_join(F.slice(F.array(*shown), first + 1, last - first + 1), " ")
    return F.when(secs.isNotNull(), spelled)


def _largest(secs: Column) -> Column:
    """Place of the largest unit that is not zero (seconds for zero)."""
    return F.when(secs >= 3600, 0).when(secs >= 60, 1).otherwise(2)


def _smallest(secs: Column) -> Column:
    """Place of the smallest unit that is not zero (seconds for zero)."""
    return F.when((secs % 60 != 0) | (secs == 0), 2).when(secs % 3600 != 0, 1).otherwise(0)


def humanize_full(secs: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s`` or ``3s``."""
    return _spelled(secs, _largest(secs), 2)


def humanize_header(secs: Column) -> Column:
    """Like :func:`humanize_full`, with zero units at the end left out."""
    return _spelled(secs, _largest(secs), _smallest(secs))


def humanize_hm(secs: Column) -> Column:
    """``1h 2m``, always both units."""
    return _spelled(secs, 0, 1)


def humanize_coarse(secs: Column) -> Column:
    """Only the largest unit: ``1h``, ``2m`` or ``3s``."""
    return _spelled(secs, _largest(secs), _largest(secs))


def humanize_bucket(secs: Column) -> Column:
    """Bucket-width label: ``1h``, ``1h 30m``, ``10m`` or ``90s``."""
    long = _spelled(secs, 0, F.when(secs % 3600 == 0, 0).otherwise(1))
    odd = (secs < 60) | (secs % 60 != 0)
    short = F.when(odd, F.concat(secs.cast("bigint").cast("string"), F.lit("s"))).otherwise(_spelled(secs, 1, 1))
    return F.when(secs >= 3600, long).otherwise(short)


_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600}
MIN_BUCKET_SECS = 60
MAX_BUCKET_SECS = 24 * 3600
DEFAULT_BUCKET_SECS = 600


def parse_bucket_duration(text: str) -> int:
    """Bucket width argument such as ``10m``: seconds between one minute and a day."""
    text = text.strip()
    number, unit = text[:-1], text[-1:]
    if unit not in _UNIT_SECONDS or not number.isascii() or not number.isdigit():
        raise ValueError(f"bucket width must be <digits>s, m or h: {text!r}")
    secs = int(number) * _UNIT_SECONDS[unit]
    if not MIN_BUCKET_SECS <= secs <= MAX_BUCKET_SECS:
        raise ValueError(f"bucket width must be between 60s and 24h: {text!r}")
    return secs
