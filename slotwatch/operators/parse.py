"""Raw lines to typed events, as one chain of native projections.

Each step is a narrow projection, so the whole parse stays in the scan stage: no
shuffle, no Python worker. One pattern pass per line finds its leading words and all payload
fields at once; the module then decides whether the words count. The steps are
kept small enough to be compiled as one method.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwatch.functions.text import DIGITS, HASH, NUMBER, issue_body, parse_ts_ns

# --- fixed values of the log format -------------------------------------------------
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG", "TRACE")
VOTOR_MODULE = "agave_votor::event_handler"
ROOT_MODULE = "agave_votor::root_utils"
BANK_MODULE = "solana_runtime::bank"
CLUSTER_SLOTS_MODULE = "solana_core::cluster_slots_service::cluster_slots"
CLUSTER_SLOTS_PARENT_MODULE = "solana_core::cluster_slots_service"
# ------------------------------------------------------------------------------------

_TUPLE = rf"\(({NUMBER}), ({HASH})\)[ \t]*\z"
_STRICT_TUPLE = rf"\(({DIGITS}), ({HASH})\)"


@dataclass(frozen=True)
class Rule:
    """One event kind: where it occurs, how its text starts, what it carries.

    ``tail`` is the pattern of what follows the leading words and ``fields`` names its
    groups in order; a rule without one is recognised by its leading words alone.
    """

    kind: str
    modules: tuple[str, ...]
    prefix: str
    tail: str | None = None
    fields: tuple[str, ...] = ("slot",)


_V = (VOTOR_MODULE,)
_R = (ROOT_MODULE,)
_C = (CLUSTER_SLOTS_MODULE, CLUSTER_SLOTS_PARENT_MODULE)
_NUM = rf"({NUMBER})\z"
_SLOT_HASH = ("slot", "hash")
_PARENT = ("slot", "hash", "parent_slot", "parent_hash")

# The event grammar. Where one prefix is the start of another, the longer one is first.
RULES: tuple[Rule, ...] = (
    Rule("Block", _V, "Block (", rf"({DIGITS}), ({HASH})\) parent {_STRICT_TUPLE}\z", _PARENT),
    Rule("BlockNotarized", _V, "Block Notarized ", _TUPLE, _SLOT_HASH),
    Rule("BlockNotarFallback", _V, "Block notar-fallback ", _TUPLE, _SLOT_HASH),
    Rule("VotingNotarize", _V, "Voting notarize for ", rf"({NUMBER}) ({HASH})[ \t]*\z", _SLOT_HASH),
    Rule("VotingFinalize", _V, "Voting finalize for ", _NUM),
    Rule("VotingSkip", _V, "Voting skip for ", _NUM),
    Rule("FirstShred", _V, "First shred ", _NUM),
    Rule("Finalized", _V, "Finalized ", rf"{_STRICT_TUPLE} fast: (true|false)\z", ("slot", "hash", "fast")),
    Rule("Timeout", _V, "Timeout ", _NUM),
    Rule("TimeoutCrashedLeader", _V, "TimeoutCrashedLeader ", _NUM),
    Rule("SafeToNotar", _V, "SafeToNotar ", _TUPLE, _SLOT_HASH),
    Rule("SafeToSkip", _V, "SafeToSkip ", _NUM),
    Rule(
        "ProduceWindow",
        _V,
        "ProduceWindow LeaderWindowInfo { start_slot: ",
        rf"({DIGITS}), end_slot: ({DIGITS}), parent_block: {_STRICT_TUPLE}.*\z",
        ("slot", "slot_end", "parent_slot", "parent_hash"),
    ),
    Rule(
        "StandstillEnded",
        _V,
        "Standstill initially detected at slot=",
        rf"({DIGITS}) has ended at slot=({DIGITS})\..*\z",
        ("slot", "slot_end"),
    ),
    Rule("Standstill", _V, "Standstill ", _NUM),
    Rule("StandstillExtending", _V, "Extending timeouts starting at slot ", _NUM),
    Rule("RefreshingVote", _V, "Refreshing vote ", None, ()),
    Rule(
        "TriggeringParentReady",
        _V,
        "Triggering parent ready for slot ",
        rf"({DIGITS}) with parent ({DIGITS}) ({HASH})\z",
        ("slot", "parent_slot", "parent_hash"),
    ),
    Rule("SettingRoot", _R, "setting root ", _NUM),
    Rule("NewRoot", _R, "new root ", _NUM),
    Rule(
        "BankFrozen",
        (BANK_MODULE,),
        "bank frozen: ",
        rf"({DIGITS}) hash: ({HASH}) signature_count: ({DIGITS}).*\z",
        ("slot", "hash", "n"),
    ),
    Rule("NoEpochMetadata", _C, "No epoch_metadata record for epoch ", _NUM, ("epoch",)),
    Rule("NoEpochInfoForSlot", _C, "No epoch info for slot ", _NUM),
    Rule("UpdatingEpochMetadata", _C, "Updating epoch_metadata for epoch ", _NUM, ("epoch",)),
    Rule("EvictingEpochMetadata", _C, "Evicting epoch_metadata for epoch ", _NUM, ("epoch",)),
    Rule("InvalidClusterSlotsUpdate", _C, "Invalid update call to ClusterSlots", None, ()),
    Rule(
        "ClusterSlotsStopped",
        _C,
        "ClusterSlotsService has stopped because we have finished the alpenglow migration epoch",
        None,
        (),
    ),
)

EVENT_KINDS = tuple(r.kind for r in RULES) + ("SetIdentity",)
PAYLOAD = ("slot", "slot_end", "hash", "parent_slot", "parent_hash", "fast", "epoch", "n")


# The pattern writes its groups into one fixed layout, so that a field is always at the same
# position whatever the kind; a position the kind does not fill is empty.
_LAYOUT = {"slot": 0, "epoch": 0, "hash": 1, "parent_slot": 2, "parent_hash": 3, "slot_end": 4, "fast": 4, "n": 4, "words": 5}
_FIELD_END = "\t"  # neither in leading words nor in a payload field


def _rest(text: Column, skip: Column | int) -> Column:
    """``text`` without its first ``skip`` characters."""
    return F.substring(text, skip + 1, 2**31 - 1)


# A kind is a number, its place in EVENT_KINDS, until the last step: lines are tested for it many times.
_NUMBER_OF = {kind: i for i, kind in enumerate(EVENT_KINDS)}
# A bare first word: anything may follow it after a space.
_SET_IDENTITY = Rule("SetIdentity", _V, "SetIdentity", r"(?: .*)?\z", ())
_BY_NUMBER = (*RULES, _SET_IDENTITY)


def _kinds_with(field: str) -> list[int]:
    return [_NUMBER_OF[r.kind] for r in RULES if field in r.fields]


def _grammar() -> tuple[str, str]:
    """One pattern for the text of every kind, leading words included, and what replaces a match: the fields
    and the words in layout order.

    Rules with the same ``tail`` and fields at the same positions share their groups. At most one rule matches a text:
    where one's words start another's, the shorter rule goes on with a number. A replaced text begins
    with a number or ``_FIELD_END`` and a matching one with a word, so an unchanged text is one that did not match.
    """
    shapes: dict[tuple[str, tuple[int, ...]], list[str]] = {}
    for rule in _BY_NUMBER:
        tail = r".*\z" if rule.tail is None else rule.tail
        shapes.setdefault((tail, tuple(_LAYOUT[f] for f in rule.fields)), []).append(re.escape(rule.prefix))
    branches, groups, n = [], [""] * len(set(_LAYOUT.values())), 0
    for (tail, positions), words in shapes.items():
        branches.append(f"({'|'.join(words)}){tail}")
        for position in (_LAYOUT["words"], *positions):
            n += 1
            groups[position] += f"${n}"
    # (?s): whatever follows an open-ended match is dropped, line breaks included.
    return f"(?s)^(?:{'|'.join(branches)})", _FIELD_END.join(groups)


def _family(module: Column) -> Column:
    """The module whose kinds a module may log: the first one of a rule."""
    out = module
    for first, *others in dict.fromkeys(r.modules for r in RULES):
        out = F.when(module.isin(*others), F.lit(first)).otherwise(out) if others else out
    return out


def _of_kind(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number)


def parse_prefix(lines: DataFrame) -> DataFrame:
    """Split ``[ts LEVEL module] body``; adds is_record, ts_ns, level, module, body.

    ``is_record`` is false for continuation lines. A record whose prefix is malformed
    has a NULL in one of the other columns.
    """
    keep = [c for c in lines.columns if c != "line"]
    valid = F.is_valid_utf8("line")
    step = lines.select(
        *keep,
        # A line that is not text is counted as a malformed record.
        (~valid | F.col("line").rlike(r"^\[[0-9]{4}-")).alias("is_record"),
        F.when(valid, F.split("line", " ", 3)).alias("_parts"),
    )
    step = step.select(
        *keep,
        "is_record",
        _rest(F.get("_parts", F.lit(0)), 1).alias("_ts"),
        F.get("_parts", F.lit(1)).alias("level"),
        F.ltrim(F.get("_parts", F.lit(2))).alias("_tail"),
    )
    step = step.select(*keep, "is_record", "_ts", "level", "_tail", F.instr("_tail", "] ").alias("_close"))
    record = F.col("is_record")
    closed = record & (F.col("_close") > 0)
    return step.select(
        *keep,
        "is_record",
        F.when(record, parse_ts_ns(F.col("_ts"))).alias("ts_ns"),
        F.when(record & F.col("level").isin(*LEVELS), F.col("level")).alias("level"),
        F.when(closed, F.substring("_tail", F.lit(1), F.col("_close") - 1)).alias("module"),
        F.when(closed, _rest(F.col("_tail"), F.col("_close") + 1)).alias("body"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines[log_id, seq, line]`` to one ``parsed`` row per line.

    ``outcome`` is event, issue, ignored, continuation or parse_error.
    """
    prefix = parse_prefix(lines.select("log_id", "seq", "line"))
    base = ["log_id", "seq", "is_record", "ts_ns", "level", "module"]
    wellformed = F.col("ts_ns").isNotNull() & F.col("level").isNotNull() & F.col("module").isNotNull()
    after_key = F.instr("body", ": ")
    step = prefix.select(
        *base,
        F.when(wellformed & F.col("level").isin("WARN", "ERROR"), F.col("body")).alias("body"),
        wellformed.alias("ok"),
        F.when(
            wellformed,
            F.when(
                F.col("module").isin(VOTOR_MODULE, ROOT_MODULE),
                F.when(after_key > 0, _rest(F.col("body"), after_key + 1)),
            ).when(F.col("module").isin(BANK_MODULE, *_C), F.col("body")),
        ).alias("text"),
    )
    pattern, fields = _grammar()
    step = step.select(*base, "body", "ok", "text", F.regexp_replace("text", pattern, fields).alias("payload"))
    matched = F.col("payload") != F.col("text")
    step = step.select(*base, "body", "ok", F.when(matched, F.split("payload", _FIELD_END)).alias("fields"))
    words = F.array(*[F.lit(r.prefix) for r in _BY_NUMBER])
    step = step.select(
        *base,
        "body",
        "ok",
        *[F.get("fields", F.lit(_LAYOUT[f])).alias(f"_{f}") for f in ("slot", "hash", "parent_slot", "parent_hash", "n")],
        (F.array_position(words, F.get("fields", F.lit(_LAYOUT["words"]))) - 1).cast("int").alias("candidate"),
    )

    def number(field: str) -> Column:
        # A failing try_cast raises and catches inside, so it must stay the rare case.
        return F.when(~F.col(field).isin("", "true", "false"), F.col(field).try_cast("bigint"))

    step = step.select(
        *base,
        "body",
        "ok",
        "candidate",
        "_slot",
        number("_slot").alias("first"),
        F.nullif("_hash", F.lit("")).alias("hash"),
        "_parent_slot",
        number("_parent_slot").alias("parent_slot"),
        F.nullif("_parent_hash", F.lit("")).alias("parent_hash"),
        F.col("_n").alias("extra"),
        number("_n").alias("extra_n"),
    )
    # A number that does not fit a BIGINT is NULL here, and the line is no event then.
    complete = (
        ((F.col("_slot") == "") == F.col("first").isNull())
        & ((F.col("_parent_slot") == "") == F.col("parent_slot").isNull())
        & (F.col("extra").isin("", "true", "false") == F.col("extra_n").isNull())
    )
    logged = _of_kind([r.modules[0] for r in _BY_NUMBER], F.col("candidate")) == _family(F.col("module"))
    step = step.select(
        *base,
        "body",
        "ok",
        F.when(logged & complete, F.col("candidate")).alias("kind"),
        "first",
        "hash",
        "parent_slot",
        "parent_hash",
        "extra",
        "extra_n",
    )
    outcome = (
        F.when(~F.col("is_record"), "continuation")
        .when(~F.col("ok"), "parse_error")
        .when(F.col("kind").isNotNull(), "event")
        .when(F.col("body").isNotNull(), "issue")
        .otherwise("ignored")
    )
    event = F.col("kind").isNotNull()
    kept = event | F.col("body").isNotNull()
    is_epoch = F.col("kind").isin(*_kinds_with("epoch"))

    def of_event(col: Column, *kinds: int) -> Column:
        return F.when(F.col("kind").isin(*kinds) if kinds else event, col)

    step = step.select(
        "log_id",
        "seq",
        outcome.alias("outcome"),
        F.when(kept, F.col("ts_ns")).alias("ts_ns"),
        F.when(kept, F.col("level")).alias("level"),
        F.when(kept, F.col("module")).alias("module"),
        _of_kind(list(EVENT_KINDS), F.col("kind")).alias("kind"),
        of_event(F.when(~is_epoch, F.col("first"))).alias("slot"),
        of_event(F.col("extra_n"), *_kinds_with("slot_end")).alias("slot_end"),
        of_event(F.col("hash")).alias("hash"),
        of_event(F.col("parent_slot")).alias("parent_slot"),
        of_event(F.col("parent_hash")).alias("parent_hash"),
        of_event(F.col("extra") == "true", *_kinds_with("fast")).alias("fast"),
        of_event(F.col("first"), *_kinds_with("epoch")).alias("epoch"),
        of_event(F.col("extra_n"), *_kinds_with("n")).alias("n"),
        # Whole: what is shown of it is cut and cleaned where it is shown.
        F.when(~event, F.col("body")).alias("body"),
    )
    # The one-row generator keeps a caller's filter above the parse. Without it the
    # optimizer rewrites a test such as outcome = 'event' into the raw line, through
    # every step above, and repeats each step wherever the next one uses it. A generator
    # interprets what it is given, so it gets plain columns.
    return step.select("log_id", "seq", F.inline(F.array(F.struct(*step.columns[2:]))))


def parse_events(parsed: DataFrame) -> DataFrame:
    """Only the events, without the issue columns."""
    return parsed.where(F.col("outcome") == "event").select(
        "log_id", "seq", "ts_ns", "kind", *PAYLOAD
    )


def event_kind_counts(parsed: DataFrame) -> DataFrame:
    return (
        parsed.where(F.col("outcome") == "event")
        .groupBy("log_id", "kind")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


def ingest_aggregates() -> list[Column]:
    """Lines per outcome; ``ingested`` are the lines that reached the fold."""

    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return [
        F.count(F.lit(1)).alias("lines"),
        n("continuation").alias("continuation_lines"),
        n("ignored").alias("ignored_lines"),
        n("parse_error").alias("parse_errors"),
        F.count_if(F.col("outcome").isin("event", "issue")).alias("ingested"),
    ]


def ingest_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("log_id").agg(*ingest_aggregates())


def meta_aggregates() -> list[Column]:
    """Line count and time range; only events and issues move the range."""
    return [F.count(F.lit(1)).alias("line_count"), F.min("ts_ns").alias("lo_ns"), F.max("ts_ns").alias("hi_ns")]


def log_meta(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("log_id").agg(*meta_aggregates())
