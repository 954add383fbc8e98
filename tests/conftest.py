from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slotwatch.session import build_session, shared_folder  # noqa: E402
from slotwatch.sources.fixture_log import fixture_log  # noqa: E402

SF = "/root/testdata/sf0.001"
HASH = "AbCdEfGhJkLmNpQrStUvWxYz123456789abcdefghij"
HASH2 = "ZbCdEfGhJkLmNpQrStUvWxYz123456789abcdefghij"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    shared_folder(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample_lines(spark, tmp_path_factory):
    """The rendered log of the smallest folder, written once."""
    path = str(tmp_path_factory.mktemp("lines"))
    fixture_log(spark, SF).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def make_lines(spark):
    def make(lines, log_id="log"):
        rows = [(log_id, i, line) for i, line in enumerate(lines)]
        return spark.createDataFrame(rows, "log_id string, seq bigint, line string")

    return make


def votor(text: str, at: str = "2026-05-01T00:00:00.000000000Z", level: str = "INFO") -> str:
    return f"[{at} {level}  agave_votor::event_handler] NodeKey: {text}"


def other(module: str, text: str, at: str = "2026-05-01T00:00:00.000000000Z", level: str = "INFO") -> str:
    return f"[{at} {level}  {module}] {text}"


SLOT_FIELDS = (
    "log_id string, slot bigint, block_id string, parent_slot bigint, parent_hash string, first_shred_ns bigint, "
    "block_emitted_ns bigint, voted_notarize_ns bigint, block_notarized_ns bigint, voted_finalize_ns bigint, "
    "notar_fallback_ns bigint, finalized_ns bigint, setting_root_ns bigint, new_root_ns bigint, timeout_ns bigint, "
    "timeout_crashed_leader_ns bigint, voted_skip_ns bigint, safe_to_notar_ns bigint, safe_to_skip_ns bigint, "
    "fast_finalize boolean, signature_count bigint, we_are_leader boolean, skip_classification string"
)


@pytest.fixture
def make_slots(spark):
    """Slot rows from dicts that name only the columns set."""
    names = [f.split()[0] for f in SLOT_FIELDS.split(", ")]

    def make(*rows):
        full = []
        for r in rows:
            r = {"log_id": "log", "we_are_leader": False, "skip_classification": "not_skipped", **r}
            full.append(tuple(r.get(n) for n in names))
        return spark.createDataFrame(full, SLOT_FIELDS)

    return make
