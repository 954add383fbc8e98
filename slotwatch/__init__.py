"""slotwatch: validator-log analytics as PySpark DataFrame jobs."""

from slotwatch.plans.tables import LogTables
from slotwatch.session import build_session
from slotwatch.sources.lines import read_log_lines

__all__ = ["LogTables", "build_session", "read_log_lines"]
