"""All tables of a set of logs, each built once and shared by what depends on it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwatch.functions.text import DEFAULT_BUCKET_SECS
from slotwatch.operators import alerts as A
from slotwatch.operators import ancestry, buckets, gaps, health, issues, latency, parse, standstill
from slotwatch.operators import slots as S
from slotwatch.operators import view as V
from slotwatch.operators import windows as W
from slotwatch.operators.ordered import rank_within
from slotwatch.plans.report import summary_report
from slotwatch.session import fresh_path, prepare
from slotwatch.sources.lines import file_meta


class LogTables:
    """Result tables over ``lines[log_id, seq, line]``.

    The text is parsed once. The tables many others read (``parsed``, ``slots``,
    ``resumes`` and the per-log ones) are stages: each is written as Parquet under
    ``store`` and read back. Later reads push filters and columns down, their plans
    start at a file scan of known size instead of at the raw text, and a lost executor
    costs one file read. ``store`` defaults to a new folder in the shared folder.
    """

    def __init__(self, lines: DataFrame, store: str | None = None):
        self.spark = prepare(lines.sparkSession)
        self.lines = lines
        self.store = (store or fresh_path(self.spark, "logtables")).rstrip("/")
        self._buckets: dict[int, DataFrame] = {}
        self._indexes: dict[str, DataFrame] = {}

    def _stage(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        # Not partitioned by log: a log id may be empty or longer than a folder name, and
        # an input split holds one log, so file statistics prune as well.
        path = f"{self.store}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    # --- stages -------------------------------------------------------------------
    @cached_property
    def _by_class(self) -> DataFrame:
        """Parsed lines with their class, a folder each: a reader of rare events does not open the files
        of slot events or of lines that are no events."""
        rows = parse.parse_lines(self.lines).withColumn("class", S.line_class())
        return self._stage("parsed", rows, by="class")

    def _of_class(self, *classes: str) -> DataFrame:
        return self._by_class.where(F.col("class").isin(*classes)).drop("class")

    @cached_property
    def parsed(self) -> DataFrame:
        return self._by_class.drop("class")

    @cached_property
    def events(self) -> DataFrame:
        """Parsed rows that reach the fold (events and issues)."""
        return self._of_class("slot", "rare", "issue")

    @cached_property
    def rare_events(self) -> DataFrame:
        """Events that touch no slot record on their own: leader windows, standstills, identity, epochs."""
        return self._of_class("rare")

    @cached_property
    def issue_rows(self) -> DataFrame:
        """Grouped issues: unparsed warnings and errors, and the rare events that count as such."""
        return self._of_class("issue", "rare")

    @cached_property
    def per_log(self) -> DataFrame:
        """Everything that is one number per log of parsed lines, from one pass."""
        aggregates = [*parse.meta_aggregates(), *parse.ingest_aggregates(), *S.counter_aggregates()]
        return self._stage("per_log", self.parsed.groupBy("log_id").agg(*aggregates))

    @cached_property
    def meta(self) -> DataFrame:
        return self.per_log.select("log_id", "line_count", "lo_ns", "hi_ns")

    @cached_property
    def ingest(self) -> DataFrame:
        return self.per_log.select("log_id", "lines", "continuation_lines", "ignored_lines", "parse_errors", "ingested")

    @cached_property
    def overall(self) -> DataFrame:
        return self.per_log.drop(*self.meta.columns[1:], *self.ingest.columns[1:])

    @cached_property
    def slots(self) -> DataFrame:
        raw = self._stage("slots_raw", S.build_slots(self._of_class("slot", "rare")))
        return self._stage("slots", ancestry.classify_skips(raw, ancestry.canonical_ancestors(raw)))

    @cached_property
    def outcomes(self) -> DataFrame:
        return self._stage("slot_outcomes", S.slot_outcomes(self.slots))

    @cached_property
    def resumes(self) -> DataFrame:
        return self._stage("vote_resumes", latency.vote_resumes(self.slots))

    @cached_property
    def ranges(self) -> DataFrame:
        return self._stage("standstill_ranges", standstill.standstill_ranges(self.rare_events, self.slots, self.meta))

    @cached_property
    def issue_groups(self) -> DataFrame:
        return self._stage("log_issue_groups", issues.log_issue_groups(issues.issue_events(self.issue_rows)))

    @cached_property
    def alert_rows(self) -> DataFrame:
        union = A.alerts(
            self.issue_groups,
            standstill.standstill_firings(self.rare_events),
            self.rare_events,
            A.leader_summary(self.rare_events, self.outcomes),
        )
        return self._stage("alerts", union)

    @cached_property
    def _facts(self) -> DataFrame:
        facts = health.log_facts(
            self.meta,
            self.ingest,
            self.overall,
            self.outcomes,
            standstill.tcl_outside_standstill(self.slots, self.ranges, self.overall),
            self.resumes,
            latency.lifecycle_latency(self.slots),
        )
        return self._stage("log_facts", facts)

    # --- parse --------------------------------------------------------------------
    def ingest_counts(self) -> DataFrame:
        return self.ingest

    def log_meta(self) -> DataFrame:
        return self.meta

    def parse_events(self) -> DataFrame:
        return parse.parse_events(self._of_class("slot", "rare"))

    def event_kind_counts(self) -> DataFrame:
        return parse.event_kind_counts(self._of_class("slot", "rare"))

    def issue_events(self) -> DataFrame:
        return issues.issue_events(self.issue_rows)

    # --- slots --------------------------------------------------------------------
    def overall_counters(self) -> DataFrame:
        return self.overall

    def slot_outcomes(self) -> DataFrame:
        return self.outcomes

    def skip_counts(self) -> DataFrame:
        return S.skip_counts(self.slots)

    def slot_view(self) -> DataFrame:
        return V.slot_view(self.slots)

    def filtered_view(self, **flags: bool) -> DataFrame:
        return V.filter_slots(self.slot_view(), **flags)

    def _places(self, name: str, placed: Callable[[], DataFrame]) -> DataFrame:
        """The place index of a list, built when its first page is asked for."""
        if name not in self._indexes:
            self._indexes[name] = self._stage(f"{name}_places", V.place_index(placed()), by="place_block")
        return self._indexes[name]

    def slot_page(self, offset: int, limit: int, **flags: bool) -> DataFrame:
        """A page of every log's own slot list, or of its slots that satisfy the flags of
        :meth:`filtered_view`. The list is ranked and stored once; a page opens the files
        that hold its places."""

        def placed() -> DataFrame:
            by_slot = [F.shiftright("slot", 16)]
            return rank_within(self.filtered_view(**flags), ["log_id"], [by_slot], [F.col("slot")], "place")

        name = "_".join(["slots", *sorted(f for f, on in flags.items() if on)])
        return V.indexed_page(self._places(name, placed), offset, limit)

    def incident_page(self, offset: int, limit: int) -> DataFrame:
        """A page of every log's own incidents, longest first."""
        return V.indexed_page(self._places("incidents", self.incidents), offset, limit)

    def leader_summary(self) -> DataFrame:
        return A.leader_summary(self.rare_events, self.outcomes)

    def leader_slots(self) -> DataFrame:
        return S.leader_slots(self.rare_events).select("log_id", "slot").distinct()

    # --- latency ------------------------------------------------------------------
    def latency_samples(self) -> DataFrame:
        return latency.latency_samples(self.slots)

    def latency_stages(self) -> DataFrame:
        return latency.latency_stages(self.slots)

    def lifecycle_latency(self) -> DataFrame:
        return latency.lifecycle_latency(self.slots)

    def top_slowest_slots(self, k: int = 5) -> DataFrame:
        return latency.top_slowest_slots(self.slots, k)

    def vote_resumes(self) -> DataFrame:
        return self.resumes.select("log_id", "tcl_slot", "resume_slot", "resume_us")

    def resume_percentiles(self) -> DataFrame:
        return latency.percentile_table(self.resumes, ["log_id"], "resume_us")

    def resume_severity(self) -> DataFrame:
        return latency.resume_severity_counts(self.resumes)

    def resume_distribution(self) -> DataFrame:
        return latency.resume_distribution(self.resumes)

    def incidents(self) -> DataFrame:
        return latency.incidents(self.resumes)

    def top_resumes(self, k: int = 5) -> DataFrame:
        return latency.top_resumes(self.resumes, k)

    def voting_gaps(self, min_size: int = gaps.REPORT_MIN_GAP) -> DataFrame:
        return gaps.voting_gaps(self.slots, min_size)

    def top_gaps(self, k: int = 5) -> DataFrame:
        return gaps.top_gaps(self.voting_gaps(), k)

    # --- standstill ---------------------------------------------------------------
    def standstill_alerts(self) -> DataFrame:
        return standstill.standstill_firings(self.rare_events).drop("seq")

    def standstill_ranges(self) -> DataFrame:
        return self.ranges

    def tcl_outside_standstill(self) -> DataFrame:
        return standstill.tcl_outside_standstill(self.slots, self.ranges, self.overall)

    # --- issues and alerts --------------------------------------------------------
    def log_issue_groups(self) -> DataFrame:
        return self.issue_groups

    def issue_histogram(self, bins: int, cap: int | None = None) -> DataFrame:
        """Over all timestamps of a group, or with ``cap`` over its first ones."""
        kept = self.issue_events()
        if cap is not None:
            kept = issues.retained_timestamps(kept, self.issue_groups, cap)
        return issues.event_histogram(kept, issues.GROUP, bins, sized_by=self.issue_groups)

    def leader_window_histogram(self, bins: int) -> DataFrame:
        return issues.event_histogram(A.leader_windows(self.rare_events), ["log_id"], bins, sized_by=self.meta)

    def alerts(self) -> DataFrame:
        return self.alert_rows

    def alert_detail(self) -> DataFrame:
        return A.alert_detail(self.alert_rows, self.issue_groups)

    def alert_rollup(self) -> DataFrame:
        return A.alert_rollup(self.alert_rows)

    def actionable_alerts(self) -> DataFrame:
        return A.actionable_alerts(self.alert_rows)

    # --- time ---------------------------------------------------------------------
    def time_buckets(self, bucket_secs: int = DEFAULT_BUCKET_SECS) -> DataFrame:
        if bucket_secs not in self._buckets:
            df = buckets.time_buckets(self.slots, self.resumes, self.meta, bucket_secs)
            self._buckets[bucket_secs] = self._stage(f"time_buckets_{bucket_secs}", df)
        return self._buckets[bucket_secs]

    def bucket_series(self, bucket_secs: int = DEFAULT_BUCKET_SECS) -> DataFrame:
        return buckets.bucket_series(self.time_buckets(bucket_secs), bucket_secs)

    def long_series(self, bucket_secs: int = DEFAULT_BUCKET_SECS) -> DataFrame:
        return buckets.long_series(self.bucket_series(bucket_secs))

    def series_stats(self, bucket_secs: int = DEFAULT_BUCKET_SECS) -> DataFrame:
        return buckets.series_stats(self.long_series(bucket_secs))

    def deviation_series(self, bucket_secs: int = DEFAULT_BUCKET_SECS) -> DataFrame:
        return buckets.deviation_series(self.long_series(bucket_secs))

    def trend_stats(self, bucket_secs: int = DEFAULT_BUCKET_SECS) -> DataFrame:
        return buckets.trend_stats(self.time_buckets(bucket_secs))

    def tx_per_block(self, bucket_secs: int = DEFAULT_BUCKET_SECS) -> DataFrame:
        return buckets.tx_per_block(self.time_buckets(bucket_secs))

    def resampled_series(self, width: int, bucket_secs: int = DEFAULT_BUCKET_SECS) -> DataFrame:
        return buckets.resample_nearest(
            self.long_series(bucket_secs), ["log_id", "series"], "bucket", "value", width
        )

    def window_stats(self) -> DataFrame:
        return W.window_stats(self.slots, self.resumes, self.meta)

    def slot_durations(self) -> DataFrame:
        return V.slot_durations(self.slots).select("log_id", "slot", "duration_us")

    # --- health -------------------------------------------------------------------
    def facts(self) -> DataFrame:
        return self._facts

    def slot_range(self) -> DataFrame:
        return health.slot_range(self._facts)

    def vote_cert_flow(self) -> DataFrame:
        return health.vote_cert_flow(self._facts)

    def block_flow(self) -> DataFrame:
        return health.block_flow(self._facts)

    def cluster_slots_rate(self) -> DataFrame:
        return health.cluster_slots_rate(self._facts)

    def leadership_share(self) -> DataFrame:
        return health.leadership_share(self._facts)

    def crashed_leader_pct(self) -> DataFrame:
        return health.crashed_leader_pct(self._facts)

    def rates(self) -> DataFrame:
        return health.rates(self._facts)

    def fin_pcts(self) -> DataFrame:
        return health.fin_pcts(self._facts)

    def health_verdicts(self) -> DataFrame:
        return health.health_verdicts(self._facts)

    def summary_report(self) -> DataFrame:
        return summary_report(self)

    def log_files(self) -> DataFrame:
        """Path, files, bytes, lines and time range per log, for lines that came from files."""
        return file_meta(self.lines).join(self.meta.select("log_id", "lo_ns", "hi_ns"), "log_id", "left")

    def discard(self) -> None:
        """Delete the stages; every table of this object is gone with them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.store)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # --- sinks --------------------------------------------------------------------
    def write_all(self, out: str, bucket_secs: int = DEFAULT_BUCKET_SECS) -> list[str]:
        """Write every result table as Parquet under ``out``, one folder per table.

        ``out`` must not be the store or inside it: its tables are read while writing.
        """
        if f"{out.rstrip('/')}/".startswith(f"{self.store}/") or f"{self.store}/".startswith(f"{out.rstrip('/')}/"):
            raise ValueError(f"results and stages need folders of their own: {out}, {self.store}")
        results = {
            "parsed": self.parsed,
            "log_meta": self.meta,
            "overall": self.overall,
            "slots": self.slots,
            "slot_view": self.slot_view(),
            "slot_outcomes": self.outcomes,
            "vote_resumes": self.resumes,
            "voting_gaps": self.voting_gaps(),
            "standstill_ranges": self.ranges,
            "log_issue_groups": self.issue_groups,
            "alerts": self.alert_rows,
            "alert_detail": self.alert_detail(),
            "latency_stages": self.latency_stages(),
            "time_buckets": self.time_buckets(bucket_secs),
            "window_stats": self.window_stats(),
            "health_verdicts": self.health_verdicts(),
            "summary_report": self.summary_report(),
        }
        for name, df in results.items():
            df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")
        return list(results)
