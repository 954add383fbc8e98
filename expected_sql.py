"""Expected results as SQL over the raw ``events`` and ``documents`` columns.

The log lines of the tests are rendered from ``events``; this module states, for the
same rows, which events the rendered log contains, without touching any text. All
further tables are plain SQL over those, so every query of the engine has an answer
that was computed on a different path by a different engine.
"""

from __future__ import annotations

_BASE = """
b0 AS (
  SELECT event_id AS id, event_id % 2 AS ln, 1000000 + event_id // 2 AS slot,
         (event_id * 7919 + user_id * 31) % 997 AS k, user_id, event_type AS et, props,
         epoch_us(ts) AS real_us
  FROM events),
base AS MATERIALIZED (
  SELECT *, 'log' || ln AS log_id,
         CASE WHEN ln = 0 THEN 1704067200000000 + (slot - 1000000) * 1200000 + k * 500 ELSE real_us END AS t,
         300000 + k * 300 AS a, 100000 + k * 600 AS c,
         (slot // 10) % 13 = 0 AND slot % 10 BETWEEN 3 AND 3 + (slot // 130) % 4 AS mute,
         CASE WHEN id % 3 = 0 THEN slot - 2 ELSE slot - 1 END AS parent,
         et IN ('view', 'click', 'purchase') AS is_block,
         rpad('H' || translate(slot::VARCHAR, '0123456789', 'ABCDEFGHJK'), 44, 'z') AS h,
         rpad('H' || translate((CASE WHEN id % 3 = 0 THEN slot - 2 ELSE slot - 1 END)::VARCHAR,
                               '0123456789', 'ABCDEFGHJK'), 44, 'z') AS ph,
         CASE WHEN slot % 64 = 0 THEN slot + 3 WHEN slot % 320 = 5 THEN slot + 20 END AS window_end,
         slot % 500 AS stand, 900 + id % 7 AS epoch_no,
         (SELECT 1000000 + max(event_id) // 2 FROM events WHERE event_id % 2 = 1) AS last_slot
  FROM b0)
"""

_FIN_AT = "CASE WHEN NOT is_block THEN t + a + c WHEN et = 'click' AND id % 11 = 0 THEN t + a - 50000 ELSE t + a + c END"
_BLOCK_FIN = "(is_block AND id % 41 <> 0)"
_CLUSTER = "solana_core::cluster_slots_service"

# order, kind, condition, time in us, payload (columns not named are NULL)
_EVENTS = [
    (1, "FirstShred", "is_block AND id % 37 <> 0", "t", {"slot": "slot"}),
    (1, "Timeout", "et = 'signup'", "t", {"slot": "slot"}),
    (1, "TimeoutCrashedLeader", "et = 'error'", "t", {"slot": "slot"}),
    (2, "BankFrozen", "is_block", "t + a - 40", {"slot": "slot", "hash": "h", "n": "2000 + 11 * k"}),
    (2, "VotingSkip", "et IN ('signup', 'error') AND NOT mute", "t + 100", {"slot": "slot"}),
    (3, "Block", "is_block OR (et = 'signup' AND id % 4 = 0)", "t + a",
     {"slot": "slot", "hash": "h", "parent_slot": "parent", "parent_hash": "ph"}),
    (4, "VotingNotarize", "is_block AND NOT mute", "t + a + 7", {"slot": "slot", "hash": "h"}),
    (5, "BlockNotarized", "is_block AND NOT (et = 'purchase' AND k % 5 = 0)", "t + a + 40000", {"slot": "slot", "hash": "h"}),
    (6, "BlockNotarFallback", "is_block", "t + a + 40002", {"slot": "slot", "hash": "h"}),
    (7, "VotingFinalize", "is_block AND et <> 'purchase' AND NOT mute", "t + a + 40010", {"slot": "slot"}),
    (8, "Finalized", f"{_BLOCK_FIN} OR (et = 'signup' AND id % 5 = 0)", _FIN_AT,
     {"slot": "slot", "hash": "h", "fast": "et <> 'purchase'"}),
    (9, "SettingRoot", _BLOCK_FIN, f"{_FIN_AT} + 12", {"slot": "slot"}),
    (10, "NewRoot", _BLOCK_FIN, f"{_FIN_AT} + 7012", {"slot": "slot"}),
    (11, "SafeToNotar", "et = 'purchase' AND k % 7 = 0", "t + a + 40020", {"slot": "slot", "hash": "h"}),
    (11, "SafeToSkip", "et = 'signup' AND k % 6 = 0", "t + a + 40020", {"slot": "slot"}),
    (13, "ProduceWindow", "window_end IS NOT NULL", "t",
     {"slot": "slot", "slot_end": "window_end", "parent_slot": "parent", "parent_hash": "ph"}),
    (14, "StandstillExtending", "stand = 100", "t", {"slot": "slot"}),
    (14, "Standstill", "stand BETWEEN 101 AND 109", "t", {"slot": "slot - stand + 100"}),
    (14, "StandstillEnded", "stand = 110", "t", {"slot": "slot - 10", "slot_end": "slot"}),
    (15, "NoEpochMetadata", "id % 53 = 0", "t", {"epoch": "epoch_no"}),
    (16, "UpdatingEpochMetadata", "id % 211 = 0", "t", {"epoch": "epoch_no"}),
    (17, "SetIdentity", "id % 499 = 0", "t", {}),
    (18, "ClusterSlotsStopped", "id % 503 = 5", "t", {}),
    (19, "RefreshingVote", "id % 101 = 0", "t", {}),
    (20, "TriggeringParentReady", "id % 61 = 0", "t", {"slot": "slot", "parent_slot": "parent", "parent_hash": "ph"}),
    (21, "FirstShred", "id % 43 = 0", "t + 900000", {"slot": "slot"}),
    (25, "EvictingEpochMetadata", "id % 223 = 0", "t", {"epoch": "epoch_no"}),
    (26, "NoEpochInfoForSlot", "id % 227 = 0", "t", {"slot": "slot"}),
    (27, "InvalidClusterSlotsUpdate", "id % 229 = 0", "t", {}),
    (28, "StandstillExtending", "ln = 1 AND slot = last_slot - 20", "t", {"slot": "slot"}),
]
_PAYLOAD = {
    "slot": "BIGINT", "slot_end": "BIGINT", "hash": "VARCHAR", "parent_slot": "BIGINT",
    "parent_hash": "VARCHAR", "fast": "BOOLEAN", "epoch": "BIGINT", "n": "BIGINT",
}


def _ev() -> str:
    parts = []
    for order, kind, cond, at, payload in _EVENTS:
        cols = ", ".join(f"({payload[c]})::{t} AS {c}" if c in payload else f"NULL::{t} AS {c}" for c, t in _PAYLOAD.items())
        parts.append(
            f"SELECT log_id, id * 32 + {order} AS seq, ({at}) * 1000 + id % 1000 AS ts_ns, '{kind}' AS kind, {cols} "
            f"FROM base WHERE {cond}"
        )
    return "ev AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


# The unparsed WARN/ERROR lines; the body is cut at 200 bytes before ESC is dropped.
_RAW_ISSUES = """
raw_issues AS (
  SELECT log_id, id * 32 + 12 AS seq, (t + 200) * 1000 + id % 1000 AS ts_ns,
         CASE WHEN k % 3 = 0 THEN 'Warn' ELSE 'Critical' END AS severity,
         'app::mod_' || (user_id % 5) AS module,
         CASE WHEN k % 4 = 0 THEN 'request failed[31m: ' ELSE 'request failed: ' END || props || ' '
         || repeat('é', least(k % 150,
              (200 - (CASE WHEN k % 4 = 0 THEN 21 ELSE 16 END) - strlen(props) - 1) // 2)::INT) AS body
  FROM base WHERE et = 'error')
"""

_LINES = """
line_counts AS (
  SELECT log_id,
         (SELECT count(*) FROM ev WHERE ev.log_id = base.log_id) AS n_events,
         (SELECT count(*) FROM raw_issues WHERE raw_issues.log_id = base.log_id) AS n_issues,
         count(*) FILTER (id % 50 = 0) AS n_cont,
         count(*) FILTER (id % 97 = 0) AS n_bad,
         count(*) FILTER (id % 31 = 0) AS n_ignored
  FROM base GROUP BY log_id),
meta AS (
  SELECT log_id, min(ts_ns) AS lo_ns, max(ts_ns) AS hi_ns
  FROM (SELECT log_id, ts_ns FROM ev UNION ALL SELECT log_id, ts_ns FROM raw_issues) GROUP BY log_id)
"""

_TS = {
    "first_shred_ns": "FirstShred", "block_emitted_ns": "Block", "voted_notarize_ns": "VotingNotarize",
    "block_notarized_ns": "BlockNotarized", "voted_finalize_ns": "VotingFinalize",
    "notar_fallback_ns": "BlockNotarFallback", "finalized_ns": "Finalized", "setting_root_ns": "SettingRoot",
    "new_root_ns": "NewRoot", "timeout_ns": "Timeout", "timeout_crashed_leader_ns": "TimeoutCrashedLeader",
    "voted_skip_ns": "VotingSkip", "safe_to_notar_ns": "SafeToNotar", "safe_to_skip_ns": "SafeToSkip",
}
_HASHED = "('Block', 'VotingNotarize', 'BlockNotarized', 'BlockNotarFallback', 'Finalized', 'SafeToNotar')"
_SLOTS = f"""
win_ok AS (SELECT * FROM ev WHERE kind = 'ProduceWindow' AND slot_end - slot BETWEEN 0 AND 16),
led AS (SELECT DISTINCT log_id, unnest(range(slot, slot_end + 1)) AS slot FROM win_ok),
folded AS (
  SELECT log_id, slot,
         arg_min(hash, seq) FILTER (kind IN {_HASHED}) AS block_id,
         arg_min(parent_slot, seq) FILTER (kind = 'Block') AS parent_slot,
         arg_min(parent_hash, seq) FILTER (kind = 'Block') AS parent_hash,
         {", ".join(f"arg_min(ts_ns, seq) FILTER (kind = '{k}') AS {c}" for c, k in _TS.items())},
         arg_min(fast, seq) FILTER (kind = 'Finalized') AS fast_finalize,
         arg_min(n, seq) FILTER (kind = 'BankFrozen') AS signature_count
  FROM ev WHERE kind IN ({", ".join(f"'{k}'" for k in [*_TS.values(), "BankFrozen"])}) GROUP BY ALL),
raw_slots AS MATERIALIZED (
  SELECT COALESCE(f.log_id, l.log_id) AS log_id, COALESCE(f.slot, l.slot) AS slot,
         f.* EXCLUDE (log_id, slot), l.slot IS NOT NULL AS we_are_leader
  FROM folded f FULL JOIN led l ON f.log_id = l.log_id AND f.slot = l.slot),
anc AS (
  SELECT log_id, parent_slot AS slot FROM raw_slots WHERE finalized_ns IS NOT NULL AND parent_slot IS NOT NULL
  UNION
  SELECT s.log_id, s.parent_slot FROM anc JOIN raw_slots s ON s.log_id = anc.log_id AND s.slot = anc.slot
  WHERE s.parent_slot IS NOT NULL),
slots AS MATERIALIZED (
  SELECT s.*,
         CASE WHEN voted_skip_ns IS NULL THEN 'not_skipped' WHEN finalized_ns IS NOT NULL THEN 'canonical_direct'
              WHEN anc.slot IS NOT NULL THEN 'canonical_ancestry' ELSE 'indeterminate' END AS skip_classification,
         COALESCE(first_shred_ns, voted_notarize_ns, voted_skip_ns, timeout_crashed_leader_ns) AS anchor_ns,
         CASE WHEN block_emitted_ns >= first_shred_ns THEN (block_emitted_ns - first_shred_ns) // 1000
              WHEN first_shred_ns - block_emitted_ns < 1000 THEN 0 END AS assembly_us,
         CASE WHEN finalized_ns >= block_emitted_ns THEN (finalized_ns - block_emitted_ns) // 1000
              WHEN block_emitted_ns - finalized_ns < 1000 THEN 0 END AS consensus_us,
         CASE WHEN finalized_ns >= first_shred_ns THEN (finalized_ns - first_shred_ns) // 1000
              WHEN first_shred_ns - finalized_ns < 1000 THEN 0 END AS lifecycle_us
  FROM raw_slots s LEFT JOIN anc ON anc.log_id = s.log_id AND anc.slot = s.slot)
"""

_DERIVED = """
samples AS (
  SELECT log_id, slot, 'assembly' AS stage, assembly_us AS us FROM slots WHERE assembly_us IS NOT NULL
  UNION ALL SELECT log_id, slot, 'consensus', consensus_us FROM slots WHERE consensus_us IS NOT NULL
  UNION ALL SELECT log_id, slot, 'lifecycle', lifecycle_us FROM slots WHERE lifecycle_us IS NOT NULL),
resumes AS MATERIALIZED (
  SELECT log_id, tcl_slot, resume_slot, (vote_ns - tcl_ns) // 1000 AS resume_us, resume_slot - tcl_slot AS slot_gap,
         CASE WHEN (vote_ns - tcl_ns) // 1000 >= 3000000 THEN 'severe'
              WHEN (vote_ns - tcl_ns) // 1000 >= 1500000 THEN 'elevated' ELSE 'normal' END AS severity,
         tcl_ns, anchor_ns
  FROM (SELECT t.log_id, t.slot AS tcl_slot, t.timeout_crashed_leader_ns AS tcl_ns, t.anchor_ns,
               v.slot AS resume_slot, v.voted_notarize_ns AS vote_ns
        FROM (SELECT * FROM slots WHERE timeout_crashed_leader_ns IS NOT NULL) t
        ASOF JOIN (SELECT * FROM slots WHERE voted_notarize_ns IS NOT NULL) v
          ON t.log_id = v.log_id AND t.slot < v.slot)
  WHERE vote_ns >= tcl_ns),
gaps AS (
  SELECT log_id, prev + 1 AS start_slot, slot - 1 AS end_slot, slot - prev - 1 AS gap_slots,
         prev_ns AS last_vote_ns, vote_ns AS resume_vote_ns
  FROM (SELECT log_id, slot, COALESCE(voted_notarize_ns, voted_skip_ns) AS vote_ns,
               lag(slot) OVER w AS prev, lag(COALESCE(voted_notarize_ns, voted_skip_ns)) OVER w AS prev_ns
        FROM slots WHERE voted_notarize_ns IS NOT NULL OR voted_skip_ns IS NOT NULL
        WINDOW w AS (PARTITION BY log_id ORDER BY slot))
  WHERE slot - prev - 1 >= 1),
ranges AS (
  SELECT log_id, slot AS entry_slot, slot_end AS exit_slot, seq FROM ev WHERE kind = 'StandstillEnded'
  UNION ALL
  SELECT x.log_id, arg_min(x.slot, x.seq), (SELECT max(slot) FROM slots s WHERE s.log_id = x.log_id), NULL
  FROM ev x WHERE x.kind = 'StandstillExtending'
    AND x.seq > COALESCE((SELECT max(seq) FROM ev e WHERE e.kind = 'StandstillEnded' AND e.log_id = x.log_id), -1)
  GROUP BY x.log_id),
overall AS (
  SELECT log_id,
         count(*) FILTER (kind = 'VotingNotarize') AS votes_notarize,
         count(*) FILTER (kind = 'VotingFinalize') AS votes_finalize,
         count(*) FILTER (kind = 'VotingSkip') AS votes_skip,
         count(*) FILTER (kind = 'BlockNotarized') AS block_notarized,
         count(*) FILTER (kind = 'BlockNotarFallback') AS block_notar_fallback,
         count(*) FILTER (kind = 'SettingRoot') AS setting_root,
         count(*) FILTER (kind = 'NewRoot') AS new_root,
         count(*) FILTER (kind = 'FirstShred') AS first_shreds,
         count(*) FILTER (kind = 'Timeout') AS timeouts,
         count(*) FILTER (kind = 'TimeoutCrashedLeader') AS timeout_crashed_leaders,
         count(*) FILTER (kind = 'SafeToNotar') AS safe_to_notar,
         count(*) FILTER (kind = 'SafeToSkip') AS safe_to_skip,
         count(*) FILTER (kind = 'Standstill') AS standstill_events,
         count(*) FILTER (kind = 'StandstillExtending') AS standstill_extending,
         count(*) FILTER (kind = 'StandstillEnded') AS standstill_ended,
         count(*) FILTER (kind = 'RefreshingVote') AS refreshing_votes,
         count(*) FILTER (kind = 'TriggeringParentReady') AS parent_ready_recoveries,
         count(*) FILTER (kind = 'BankFrozen') AS bank_frozen,
         count(*) FILTER (kind = 'NoEpochMetadata') AS no_epoch_metadata,
         count(*) FILTER (kind = 'NoEpochInfoForSlot') AS no_epoch_info_for_slot,
         count(*) FILTER (kind = 'UpdatingEpochMetadata') AS updating_epoch_metadata,
         count(*) FILTER (kind = 'EvictingEpochMetadata') AS evicting_epoch_metadata,
         count(*) FILTER (kind = 'InvalidClusterSlotsUpdate') AS invalid_cluster_slots_update,
         count(*) FILTER (kind = 'Finalized' AND fast) AS finalized_fast,
         count(*) FILTER (kind = 'Finalized' AND NOT fast) AS finalized_slow,
         count(*) FILTER (kind = 'ProduceWindow' AND slot_end - slot BETWEEN 0 AND 16) AS produce_windows,
         count(*) FILTER (kind = 'ProduceWindow' AND NOT (slot_end - slot BETWEEN 0 AND 16)) AS malformed_produce_window,
         bool_or(kind = 'ClusterSlotsStopped') AS cluster_slots_service_stopped
  FROM ev GROUP BY log_id),
outcomes AS (
  SELECT log_id, count(*) AS distinct_slots, min(slot) AS min_slot, max(slot) AS max_slot,
         count(finalized_ns) AS finalized_slots, count(voted_skip_ns) AS skipped_slots,
         count(*) FILTER (finalized_ns IS NULL AND voted_skip_ns IS NULL) AS pending_slots,
         count(*) FILTER (skip_classification = 'canonical_direct') AS canonical_direct,
         count(*) FILTER (skip_classification = 'canonical_ancestry') AS canonical_ancestry,
         count(*) FILTER (skip_classification = 'indeterminate') AS indeterminate,
         count(*) FILTER (we_are_leader) AS leader_slots,
         count(timeout_crashed_leader_ns) AS tcl_slots,
         count(*) FILTER (notar_fallback_ns IS NOT NULL AND block_notarized_ns IS NULL) AS fallback_only_slots
  FROM slots GROUP BY log_id),
tcl AS (
  SELECT o.log_id, (SELECT count(*) FROM ranges r WHERE r.log_id = o.log_id) AS standstill_ranges,
         o.timeout_crashed_leaders AS tcl_events,
         CASE WHEN NOT EXISTS (SELECT 1 FROM ranges r WHERE r.log_id = o.log_id) THEN o.timeout_crashed_leaders
              ELSE (SELECT count(*) FROM slots s WHERE s.log_id = o.log_id AND s.timeout_crashed_leader_ns IS NOT NULL
                    AND NOT EXISTS (SELECT 1 FROM ranges r WHERE r.log_id = s.log_id
                                    AND s.slot BETWEEN r.entry_slot AND r.exit_slot)) END AS tcl_outside_standstill
  FROM overall o),
life AS (
  SELECT log_id, stage, count(*) AS n, list_sort(list(us)) AS xs FROM samples GROUP BY ALL),
facts AS (
  SELECT o.*, c.* EXCLUDE (log_id), m.lo_ns, m.hi_ns, t.standstill_ranges, t.tcl_outside_standstill,
         lc.n_events + lc.n_issues AS ingested, lc.n_ignored, lc.n_cont, lc.n_bad,
         lc.n_events + lc.n_issues + lc.n_ignored + lc.n_cont + lc.n_bad AS line_count,
         (SELECT count(*) FROM resumes r WHERE r.log_id = o.log_id) AS resume_total,
         l.xs[floor((l.n - 1) * 0.95::DOUBLE)::BIGINT + 1] AS lifecycle_p95_us, l.xs[-1] AS lifecycle_max_us,
         greatest(COALESCE((m.hi_ns - m.lo_ns) / 1e9 / 3600.0::DOUBLE, 1.0), 1.0)::DOUBLE AS hours1,
         ((m.hi_ns - m.lo_ns) / 1e9 / 3600.0::DOUBLE)::DOUBLE AS hours
  FROM overall o JOIN outcomes c USING (log_id) JOIN meta m USING (log_id) JOIN tcl t USING (log_id)
  JOIN line_counts lc USING (log_id) LEFT JOIN life l ON l.log_id = o.log_id AND l.stage = 'lifecycle'),
issue_ev AS (
  SELECT log_id, seq, ts_ns, severity, module, body FROM raw_issues
  UNION ALL
  SELECT log_id, seq, ts_ns, CASE WHEN kind = 'InvalidClusterSlotsUpdate' THEN 'Warn' ELSE 'Critical' END,
         'solana_core::cluster_slots_service::cluster_slots',
         CASE kind WHEN 'NoEpochMetadata' THEN 'No epoch_metadata record for epoch ' || epoch
                   WHEN 'NoEpochInfoForSlot' THEN 'No epoch info for slot ' || slot
                   ELSE 'Invalid update call to ClusterSlots, can not roll time backwards!' END
  FROM ev WHERE kind IN ('NoEpochMetadata', 'NoEpochInfoForSlot', 'InvalidClusterSlotsUpdate')),
groups AS (
  SELECT log_id, severity, module, count(*) AS n, arg_min(ts_ns, seq) AS first_ns, arg_max(ts_ns, seq) AS last_ns,
         arg_min(body, seq) AS sample_body, greatest(count(*) - 1000000, 0) AS timestamps_dropped
  FROM issue_ev GROUP BY ALL),
firings AS (
  SELECT log_id, slot, count(*) AS firings, arg_min(ts_ns, seq) AS first_ns, arg_max(ts_ns, seq) AS last_ns,
         min(seq) AS seq
  FROM ev WHERE kind = 'Standstill' GROUP BY ALL),
leader AS (
  SELECT w.log_id, count(*) AS window_count,
         (SELECT count(*) FROM led WHERE led.log_id = w.log_id) AS slot_count, arg_min(ts_ns, seq) AS first_ns
  FROM win_ok w GROUP BY w.log_id),
all_alerts AS (
  SELECT log_id, severity, first_ns AS at_ns, 'LogPattern' AS kind,
         (CASE severity WHEN 'Critical' THEN 'ERROR' ELSE 'WARN' END) || ' ' || module || ' (' || n || ' occurrence'
         || (CASE WHEN n = 1 THEN '' ELSE 's' END) || '): ' || sample_body AS description,
         module, n AS count, NULL::BIGINT AS at_slot, NULL::BIGINT AS last_ns, NULL::BIGINT AS slot_count,
         NULL::BIGINT AS window_count, 0 AS kr, -n AS tie
  FROM groups
  UNION ALL
  SELECT log_id, 'Warn', first_ns, 'StandstillObserved', 'Standstill firing at finalized slot ' || slot,
         NULL, firings, slot, last_ns, NULL, NULL, 1, seq FROM firings
  UNION ALL
  SELECT log_id, 'Info', ts_ns, 'ClusterSlotsShutdownObserved',
         'ClusterSlotsService has stopped — validator entered FullAlpenglowEpoch', NULL, 1, NULL, NULL, NULL, NULL, 2, seq
  FROM ev WHERE kind = 'ClusterSlotsStopped'
  UNION ALL
  SELECT log_id, 'Info', ts_ns, 'IdentityChanged', 'Operator rotated validator identity (Set identity event)',
         NULL, 1, NULL, NULL, NULL, NULL, 3, seq FROM ev WHERE kind = 'SetIdentity'
  UNION ALL
  SELECT log_id, 'Info', first_ns, 'LocalLeaderSummary',
         'Local validator was leader: ' || slot_count || ' slots = ' || window_count || ' windows × 4 slots/window',
         NULL, slot_count, NULL, NULL, slot_count, window_count, 4, 0 FROM leader),
alerts AS MATERIALIZED (
  SELECT log_id,
         row_number() OVER (PARTITION BY log_id ORDER BY
           CASE severity WHEN 'Critical' THEN 0 WHEN 'Warn' THEN 1 ELSE 2 END, at_ns, kr, tie, COALESCE(module, '')) AS alert_rank,
         severity, at_ns, kind, description, module, count, at_slot, last_ns, slot_count, window_count
  FROM all_alerts)
"""

_BUCKETS = """
bmeta AS (
  SELECT log_id, lo_ns, hi_ns,
         greatest((greatest((hi_ns - lo_ns) // 1000000000, 60) + 599) // 600, 1) AS nb
  FROM meta),
spine AS (
  SELECT log_id, unnest(range(0, nb)) AS bucket, lo_ns FROM bmeta),
bslots AS (
  SELECT s.*, least(greatest((s.anchor_ns - m.lo_ns) // 1000000000, 0) // 600, m.nb - 1) AS bucket
  FROM slots s JOIN bmeta m USING (log_id) WHERE s.anchor_ns IS NOT NULL),
bcounts AS (
  SELECT log_id, bucket,
         count(*) FILTER (fast_finalize) AS finalized_fast,
         count(*) FILTER (NOT fast_finalize) AS finalized_slow,
         count(voted_skip_ns) AS votes_skip,
         count(*) FILTER (skip_classification IN ('canonical_direct', 'canonical_ancestry')) AS canonical_skips,
         count(timeout_crashed_leader_ns) AS crashed_leaders,
         count(safe_to_notar_ns) AS safe_to_notar, count(safe_to_skip_ns) AS safe_to_skip,
         count(*) FILTER (we_are_leader) AS our_leader_slots,
         sum(signature_count)::BIGINT AS signature_sum, count(signature_count) AS signature_sample_count,
         list_sort(list(lifecycle_us) FILTER (lifecycle_us IS NOT NULL)) AS xs
  FROM bslots GROUP BY ALL),
bresume AS (
  SELECT log_id, least(greatest((r.tcl_ns - m.lo_ns) // 1000000000, 0) // 600, m.nb - 1) AS bucket,
         list_sort(list(resume_us)) AS rs
  FROM resumes r JOIN bmeta m USING (log_id) GROUP BY ALL),
buckets AS MATERIALIZED (
  SELECT log_id, bucket, lo_ns + bucket * 600000000000 AS start_ns,
         COALESCE(finalized_fast, 0) AS finalized_fast, COALESCE(finalized_slow, 0) AS finalized_slow,
         COALESCE(votes_skip, 0) AS votes_skip, COALESCE(canonical_skips, 0) AS canonical_skips,
         COALESCE(crashed_leaders, 0) AS crashed_leaders, COALESCE(safe_to_notar, 0) AS safe_to_notar,
         COALESCE(safe_to_skip, 0) AS safe_to_skip, COALESCE(our_leader_slots, 0) AS our_leader_slots,
         COALESCE(signature_sum, 0) AS signature_sum, COALESCE(signature_sample_count, 0) AS signature_sample_count,
         COALESCE(xs[floor((len(xs) - 1) * 0.95::DOUBLE)::BIGINT + 1], 0) AS lifecycle_p95_us,
         COALESCE(len(xs), 0) AS lifecycle_n,
         COALESCE(rs[floor((len(rs) - 1) * 0.95::DOUBLE)::BIGINT + 1], 0) AS resume_p95_us,
         COALESCE(len(rs), 0) AS resume_n
  FROM spine LEFT JOIN bcounts USING (log_id, bucket) LEFT JOIN bresume USING (log_id, bucket)),
series AS (
  SELECT log_id, bucket,
         round(COALESCE(finalized_fast * 100.0::DOUBLE / nullif(finalized_fast + finalized_slow, 0), 0), 6) AS fast_finalize_pct,
         votes_skip AS skip_count, canonical_skips AS canonical_skip_count, crashed_leaders AS crashed_leader_count,
         safe_to_notar + safe_to_skip AS fragmentation_count, safe_to_notar AS safe_to_notar_count,
         safe_to_skip AS safe_to_skip_count, our_leader_slots AS our_leader_slot_count, signature_sum,
         signature_sum // 600 AS tx_per_second, finalized_fast + finalized_slow AS finalized_total_count,
         COALESCE(finalized_fast * 100 // nullif(finalized_fast + finalized_slow, 0), 0) AS fast_pct,
         CASE WHEN finalized_fast + finalized_slow = 0 THEN 0
              ELSE 100 - finalized_fast * 100 // (finalized_fast + finalized_slow) END AS slow_pct,
         lifecycle_p95_us, resume_p95_us, resume_n AS resume_count
  FROM buckets),
long AS (
  SELECT log_id, bucket, series, value FROM (
    SELECT log_id, bucket, fast_pct, slow_pct, skip_count, canonical_skip_count, safe_to_notar_count,
           safe_to_skip_count, crashed_leader_count, our_leader_slot_count, tx_per_second, finalized_total_count,
           lifecycle_p95_us // 1000 AS lifecycle_p95_ms, resume_p95_us // 1000 AS resume_p95_ms FROM series)
  UNPIVOT (value FOR series IN (fast_pct, slow_pct, skip_count, canonical_skip_count, safe_to_notar_count,
           safe_to_skip_count, crashed_leader_count, our_leader_slot_count, tx_per_second, finalized_total_count,
           lifecycle_p95_ms, resume_p95_ms)))
"""

_HOURS = "(VALUES (1, '24h', 24), (2, '12h', 12), (3, '6h', 6), (4, '3h', 3), (5, '1h', 1)) v(w, label, h)"
_WINDOWS = f"""
wins AS (
  SELECT log_id, 'all' AS label, lo_ns AS start_ns, hi_ns AS end_ns, (hi_ns - lo_ns) / 1e9 AS secs FROM meta
  UNION ALL
  SELECT log_id, label, greatest(hi_ns - h * 3600000000000, lo_ns), hi_ns, (h * 3600)::DOUBLE FROM meta, {_HOURS}),
durations AS (
  SELECT s.log_id, s.slot, (n.first_shred_ns - s.first_shred_ns) // 1000 AS duration_us, s.anchor_ns AS a1, n.anchor_ns AS a2
  FROM slots s JOIN slots n ON n.log_id = s.log_id AND n.slot = s.slot + 1
  WHERE n.first_shred_ns >= s.first_shred_ns),
wslots AS (
  SELECT w.log_id, w.label, count(*) AS slot_count,
         count(*) FILTER (fast_finalize) AS fast, count(*) FILTER (NOT fast_finalize) AS slow,
         count(voted_skip_ns) AS vote_skips,
         count(*) FILTER (skip_classification IN ('canonical_direct', 'canonical_ancestry')) AS canonical_skips,
         count(*) FILTER (skip_classification = 'indeterminate') AS indeterminate_skips,
         count(timeout_crashed_leader_ns) AS crashed_leaders,
         count(safe_to_notar_ns) + count(safe_to_skip_ns) AS fragmentation,
         list_sort(list(assembly_us) FILTER (assembly_us IS NOT NULL)) AS a_xs,
         list_sort(list(consensus_us) FILTER (consensus_us IS NOT NULL)) AS c_xs,
         list_sort(list(lifecycle_us) FILTER (lifecycle_us IS NOT NULL)) AS l_xs
  FROM wins w JOIN slots s ON s.log_id = w.log_id AND s.anchor_ns >= w.start_ns AND s.anchor_ns < w.end_ns
  GROUP BY ALL),
wdur AS (
  SELECT w.log_id, w.label, list_sort(list(duration_us)) AS d_xs
  FROM wins w JOIN durations d ON d.log_id = w.log_id AND least(a1, a2) >= w.start_ns AND greatest(a1, a2) < w.end_ns
  GROUP BY ALL),
wres AS (
  SELECT w.log_id, w.label, list_sort(list(resume_us)) AS r_xs
  FROM wins w JOIN resumes r ON r.log_id = w.log_id AND r.anchor_ns >= w.start_ns AND r.anchor_ns < w.end_ns
  GROUP BY ALL)
"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


_EV = (_BASE, _ev(), _RAW_ISSUES, _LINES)
_ALL = (*_EV, _SLOTS, _DERIVED)


def _p(xs: str, p: str) -> str:
    return f"COALESCE({xs}[floor((len({xs}) - 1) * {p}::DOUBLE)::BIGINT + 1], 0)"


def _pct(num: str, den: str) -> str:
    return f"round(COALESCE(({num}) * 100.0::DOUBLE / nullif({den}, 0), 0), 6)"


def _percentiles(xs: str = "xs") -> str:
    return f"{_p(xs, '0.5')} AS p50, {_p(xs, '0.95')} AS p95, {_p(xs, '0.99')} AS p99, {xs}[-1] AS max"


_SLOT_COLS = (
    "log_id, slot, block_id, parent_slot, parent_hash, " + ", ".join(_TS) + ", fast_finalize, signature_count, we_are_leader, skip_classification"
)


def _ms_band(us: str, warn: int, bad: int) -> str:
    return f"CASE WHEN {us} < {warn}000 THEN 'good' WHEN {us} < {bad}000 THEN 'warn' WHEN {us} IS NOT NULL THEN 'bad' END"


_VIEW = f"""
vw AS (
  SELECT log_id, slot,
         CASE WHEN voted_skip_ns IS NOT NULL THEN 'skipped' WHEN finalized_ns IS NULL THEN 'pending'
              WHEN fast_finalize THEN 'fast' ELSE 'slow' END AS status,
         CASE WHEN skip_classification IN ('canonical_direct', 'canonical_ancestry') THEN 'CSKIP'
              WHEN skip_classification = 'indeterminate' THEN 'VSKIP'
              WHEN finalized_ns IS NOT NULL THEN 'FIN' ELSE 'PEND' END AS status_label,
         skip_classification,
         CASE WHEN fast_finalize THEN 'F' WHEN NOT fast_finalize THEN 'S' ELSE ' ' END AS path,
         fast_finalize, we_are_leader, assembly_us / 1000.0::DOUBLE AS assembly_ms,
         consensus_us / 1000.0::DOUBLE AS consensus_ms,
         COALESCE(finalized_ns < block_emitted_ns, FALSE) AS consensus_inverted,
         lifecycle_us / 1000.0::DOUBLE AS lifecycle_ms,
         CASE WHEN new_root_ns >= setting_root_ns THEN (new_root_ns - setting_root_ns) // 1000 END AS root_pruning_us,
         {_ms_band("assembly_us", 500, 600)} AS assembly_band,
         {_ms_band("lifecycle_us", 600, 1000)} AS lifecycle_band,
         CASE WHEN voted_notarize_ns IS NULL THEN (CASE WHEN voted_skip_ns IS NULL THEN '-' ELSE 'S' END)
              ELSE 'N' || (CASE WHEN voted_finalize_ns IS NULL THEN '' ELSE '+F' END)
                   || (CASE WHEN voted_skip_ns IS NULL THEN '' ELSE '+S' END) END AS vote_pattern,
         trim((CASE WHEN timeout_crashed_leader_ns IS NULL THEN '' ELSE 'TCL' END)
              || (CASE WHEN safe_to_notar_ns IS NULL THEN '' ELSE ' S2N' END)
              || (CASE WHEN safe_to_skip_ns IS NULL THEN '' ELSE ' S2S' END)) AS event_tags,
         timeout_crashed_leader_ns IS NOT NULL AS crashed_leader, safe_to_notar_ns IS NOT NULL AS safe_to_notar,
         safe_to_skip_ns IS NOT NULL AS safe_to_skip
  FROM slots)
"""

_FLOW = f"""
flow AS (
  SELECT *, finalized_fast + finalized_slow AS finalized_total,
         greatest(block_notar_fallback - block_notarized, 0) AS true_fb,
         canonical_direct + canonical_ancestry AS canonical FROM facts)
"""

_VERDICTS = f"""
raw_verdicts AS (
  SELECT log_id, 'fast_finalize_pct' AS metric, {_pct("finalized_fast", "finalized_total")} AS value, FALSE AS is_lower_bound FROM flow
  UNION ALL SELECT log_id, 'canonical_skip_pct', {_pct("canonical", "votes_skip")}, indeterminate > 0 FROM flow
  UNION ALL SELECT log_id, 'standstills', standstill_events::DOUBLE, FALSE FROM flow
  UNION ALL SELECT log_id, 'refresh_votes', refreshing_votes::DOUBLE, FALSE FROM flow
  UNION ALL SELECT log_id, 'true_fallback_pct', {_pct("true_fb", "block_notar_fallback")}, FALSE FROM flow
  UNION ALL SELECT log_id, 'finalized_pct', {_pct("finalized_slots", "distinct_slots")}, FALSE FROM flow
  UNION ALL SELECT log_id, 'vote_skip_events_pct', {_pct("votes_skip", "distinct_slots")}, FALSE FROM flow
  UNION ALL SELECT log_id, 'vote_skip_slots_pct', {_pct("skipped_slots", "distinct_slots")}, FALSE FROM flow
  UNION ALL SELECT log_id, 'canonical_skip_slots_pct', {_pct("canonical", "skipped_slots")}, indeterminate > 0 FROM flow
  UNION ALL SELECT log_id, 'lifecycle_p95_ms', (lifecycle_p95_us // 1000)::DOUBLE, FALSE FROM flow
  UNION ALL SELECT log_id, 'lifecycle_max_ms', (lifecycle_max_us // 1000)::DOUBLE, FALSE FROM flow),
verdicts AS (
  SELECT log_id, metric, value,
         CASE metric
           WHEN 'fast_finalize_pct' THEN CASE WHEN value >= 80 THEN 'ok' WHEN value >= 60 THEN 'degraded' ELSE 'critical' END
           WHEN 'canonical_skip_pct' THEN CASE WHEN value < 0.5 THEN 'ok' WHEN value < 2 THEN 'degraded' ELSE 'critical' END
           WHEN 'standstills' THEN CASE WHEN value = 0 THEN 'none' ELSE 'seen' END
           WHEN 'refresh_votes' THEN CASE WHEN value = 0 THEN 'none' ELSE 'seen' END
           WHEN 'true_fallback_pct' THEN CASE WHEN value < 0.5 THEN 'rare' ELSE 'elevated' END
           WHEN 'finalized_pct' THEN CASE WHEN value >= 90 THEN 'good' WHEN value >= 80 THEN 'warn' ELSE 'bad' END
           WHEN 'vote_skip_events_pct' THEN CASE WHEN value < 5 THEN 'good' WHEN value < 15 THEN 'warn' ELSE 'bad' END
           WHEN 'vote_skip_slots_pct' THEN CASE WHEN value < 5 THEN 'good' WHEN value < 15 THEN 'warn' ELSE 'bad' END
           WHEN 'canonical_skip_slots_pct' THEN CASE WHEN value < 0.5 THEN 'good' WHEN value < 2 THEN 'warn' ELSE 'bad' END
           WHEN 'lifecycle_p95_ms' THEN CASE WHEN value <= 600 THEN 'good' ELSE 'warn' END
           ELSE CASE WHEN value >= 1000 THEN 'bad' ELSE 'warn' END END AS verdict,
         is_lower_bound
  FROM raw_verdicts)
"""

_TOP_LIFE = """
top_life AS (
  SELECT log_id, slot, lifecycle_us AS us, CASE WHEN fast_finalize THEN 'fast' WHEN NOT fast_finalize THEN 'slow' ELSE '?' END AS path,
         row_number() OVER (PARTITION BY log_id ORDER BY lifecycle_us DESC, slot) AS place
  FROM slots WHERE lifecycle_us IS NOT NULL QUALIFY place <= 5),
top_res AS (
  SELECT log_id, tcl_slot, resume_slot, resume_us, slot_gap,
         row_number() OVER (PARTITION BY log_id ORDER BY resume_us DESC, tcl_slot) AS place
  FROM resumes QUALIFY place <= 5),
top_gap AS (
  SELECT log_id, start_slot, end_slot, gap_slots, (resume_vote_ns - last_vote_ns) // 1000000000 AS wall_secs,
         row_number() OVER (PARTITION BY log_id ORDER BY gap_slots DESC, start_slot) AS place
  FROM gaps WHERE gap_slots >= 2 QUALIFY place <= 5),
resume_life AS (
  SELECT log_id, count(*) AS n, list_sort(list(resume_us)) AS xs FROM resumes GROUP BY log_id)
"""


def _full(secs: str) -> str:
    return (
        f"CASE WHEN {secs} >= 3600 THEN ({secs} // 3600) || 'h ' || ({secs} % 3600 // 60) || 'm ' || ({secs} % 60) || 's' "
        f"WHEN {secs} >= 60 THEN ({secs} // 60) || 'm ' || ({secs} % 60) || 's' ELSE {secs} || 's' END"
    )


def _short(secs: str) -> str:
    h, m, s = f"({secs} // 3600)", f"({secs} % 3600 // 60)", f"({secs} % 60)"
    return (
        f"CASE WHEN {secs} < 60 THEN {s} || 's' ELSE "
        f"trim((CASE WHEN {h} > 0 THEN {h} || 'h' ELSE '' END) || "
        f"(CASE WHEN {m} > 0 OR ({h} > 0 AND {s} > 0) THEN ' ' || {m} || 'm' ELSE '' END) || "
        f"(CASE WHEN {s} > 0 THEN ' ' || {s} || 's' ELSE '' END)) END"
    )


def _commas(x: str) -> str:
    return f"format('{{:,}}', ({x})::BIGINT)"


def _fixed(x: str, digits: int) -> str:
    return f"(round(({x})::DECIMAL(38, 6), {digits})::DECIMAL(38, {digits}))::VARCHAR"


def _report() -> str:
    secs = "((hi_ns - lo_ns) // 1000000000)"

    def rows(section: str, source: str, items: list[tuple[str, str]], where: str = "TRUE") -> str:
        return "\nUNION ALL ".join(
            f"SELECT log_id, '{section}' AS section, '{m}' AS metric, {v} AS value, NULL::VARCHAR AS verdict FROM {source} WHERE {where}"
            for m, v in items
        )

    def pcts(section: str, source: str, unit: str, digits: int, where: str = "TRUE") -> str:
        items = [("count", _commas("n"))]
        items += [(m, _fixed(f"{_p('xs', p)} / {unit}", digits)) for m, p in (("p50", "0.5"), ("p95", "0.95"), ("p99", "0.99"))]
        items.append(("max", _fixed(f"xs[-1] / {unit}", digits)))
        return rows(section, source, items, where)

    parts = [
        rows("header", "facts", [
            ("lines", _commas("line_count")), ("duration", _full(secs)), ("duration_short", _short(secs)),
            ("min_slot", _commas("min_slot")), ("max_slot", _commas("max_slot")), ("distinct_slots", _commas("distinct_slots")),
            ("ingested", _commas("ingested")), ("ignored", _commas("n_ignored")), ("continuations", _commas("n_cont")),
            ("parse_errors", _commas("n_bad"))]),
        f"SELECT log_id, 'health', metric, (CASE WHEN is_lower_bound THEN '>=' ELSE '' END) || {_fixed('value', 2)}, verdict FROM verdicts",
        rows("health", "flow", [
            ("vote_skips", _commas("votes_skip")), ("canonical_skips", _commas("canonical")),
            ("indeterminate_skips", _commas("indeterminate")), ("total_slots", _commas("distinct_slots"))]),
        rows("health", "facts", [
            ("crashed_leaders", _commas("tcl_outside_standstill")), ("crashed_leaders_raw", _commas("timeout_crashed_leaders")),
            ("fragmentation", _commas("safe_to_notar + safe_to_skip")),
            ("fragmentation_per_hour", _fixed("round((safe_to_notar + safe_to_skip) / hours1, 6)", 2))]),
        rows("leadership", "facts", [
            ("leader_windows", _commas("produce_windows")), ("leader_slots", _commas("leader_slots")),
            ("leader_slot_pct", _fixed(_pct("leader_slots", "distinct_slots"), 2))], "produce_windows > 0"),
        pcts("lifecycle", "life", "1000.0::DOUBLE", 1, "stage = 'lifecycle'"),
        pcts("resume", "resume_life", "1e6", 2),
        rows("gaps", "facts", [("count", "format('{:,}', (SELECT count(*) FROM gaps g WHERE g.log_id = facts.log_id AND g.gap_slots >= 2))")]),
        f"SELECT log_id, 'lifecycle', 'top_' || place, 'slot ' || {_commas('slot')} || ' ' || {_fixed('us / 1000.0::DOUBLE', 1)} || ' ms (' || path || ')', NULL FROM top_life",
        f"SELECT log_id, 'resume', 'top_' || place, 'TCL ' || {_commas('tcl_slot')} || ' -> ' || {_commas('resume_slot')} || ' ' || {_fixed('resume_us / 1e6', 2)} || ' s (+' || slot_gap || ' slots)', NULL FROM top_res",
        f"SELECT log_id, 'gaps', 'top_' || place, 'slots ' || {_commas('start_slot')} || ' -> ' || {_commas('end_slot')} || ' (' || {_commas('gap_slots')} || ' slots, ' || wall_secs || ' s)', NULL FROM top_gap",
        rows("vote_cert_flow", "flow", [
            ("votes_notarize", _commas("votes_notarize")),
            ("notarize_without_finalize", _commas("greatest(votes_notarize - votes_finalize, 0)")),
            ("votes_finalize", _commas("votes_finalize")), ("block_notarized", _commas("block_notarized")),
            ("block_notar_fallback", _commas("block_notar_fallback")), ("true_fallbacks", _commas("true_fb")),
            ("true_fallback_pct", _fixed(_pct("true_fb", "block_notar_fallback"), 2)),
            ("finalized", _commas("finalized_total")), ("finalized_fast", _commas("finalized_fast")),
            ("fast_pct", _fixed(_pct("finalized_fast", "finalized_total"), 2)), ("finalized_slow", _commas("finalized_slow"))]),
        rows("block_flow", "facts", [
            ("first_shreds", _commas("first_shreds")), ("frozen_without_shred", _commas("greatest(bank_frozen - first_shreds, 0)")),
            ("bank_frozen", _commas("bank_frozen")), ("frozen_not_rooted", _commas("greatest(bank_frozen - setting_root, 0)")),
            ("setting_root", _commas("setting_root")), ("pruning_in_flight", _commas("greatest(setting_root - new_root, 0)")),
            ("new_root", _commas("new_root"))]),
        rows("cluster_slots", "facts", [
            ("no_epoch_metadata", _commas("no_epoch_metadata")),
            ("per_sec", _fixed("round(no_epoch_metadata / (hours1 * 3600.0), 6)", 2)),
            ("service_stopped", "CASE WHEN cluster_slots_service_stopped THEN 'yes' ELSE 'no' END")],
            "no_epoch_metadata > 0 OR cluster_slots_service_stopped"),
        "SELECT log_id, 'alerts', alert_rank::VARCHAR, (CASE severity WHEN 'Critical' THEN '[CRIT] ' WHEN 'Warn' THEN '[WARN] ' ELSE '[INFO] ' END) || description, NULL FROM alerts",
    ]
    return _with(*_ALL, _FLOW, _VERDICTS, _TOP_LIFE) + "\nUNION ALL ".join(parts)


def _histogram(source: str, keys: str, bins: int) -> str:
    return f"""
    , h0 AS (SELECT {keys}, ts_ns, min(ts_ns) OVER (PARTITION BY {keys}) AS lo, max(ts_ns) OVER (PARTITION BY {keys}) AS hi FROM {source}),
    h1 AS (SELECT {keys}, least(trunc((ts_ns - lo)::DOUBLE / greatest(hi - lo, 1)::DOUBLE * {bins}.0::DOUBLE)::BIGINT, {bins - 1}) AS bin FROM h0),
    h2 AS (SELECT {keys}, bin, count(*) AS n FROM h1 GROUP BY ALL),
    sp AS (SELECT DISTINCT {keys}, unnest(range(0, {bins})) AS bin FROM {source})
    SELECT {keys}, bin, COALESCE(n, 0) AS n FROM sp LEFT JOIN h2 USING ({keys}, bin)"""


_SAN = r"regexp_replace(regexp_replace({x}, '[\x1B\x7F\n\r]', '', 'g'), '[\x00-\x08\x0B-\x1F]', '?', 'g')"


def statements() -> dict[str, str]:
    """Query name to SQL."""
    ev, every = _with(*_EV), _with(*_ALL)
    view = _with(*_ALL, _VIEW)
    bucket = _with(*_ALL, _BUCKETS)
    flow = _with(*_ALL, _FLOW)
    cut = "left(text, list_filter(range(0, 201), lambda n: strlen(left(text, n)) <= 200)[-1])"
    payload = ", ".join(_PAYLOAD)
    bins = "(VALUES (0, '0.0-0.5s', 0, 500000), (1, '0.5-1.0s', 500000, 1000000), (2, '1.0-1.5s', 1000000, 1500000), (3, '1.5-2.0s', 1500000, 2000000), (4, '2.0-3.0s', 2000000, 3000000), (5, '3.0-4.0s', 3000000, 4000000), (6, '4.0-5.0s', 4000000, 5000000), (7, '>5.0s', 5000000, 9000000000000000)) v(bin, label, lo, hi)"
    alert_cols = "log_id, alert_rank, severity, at_ns, kind, description, module, count, at_slot, last_ns, slot_count, window_count"
    wall = "((resume_vote_ns - last_vote_ns) // 1000000000)"
    body = "(CASE WHEN kind = 'LogPattern' THEN substr(description, strpos(description, ': ') + 2) ELSE description END)"
    cut60 = f"left({body}, list_filter(range(0, 61), lambda n: strlen(left({body}, n)) <= 60)[-1])"
    return {
        "ingest_counts": ev + "SELECT log_id, n_events + n_issues + n_cont + n_bad + n_ignored AS lines, n_cont AS continuation_lines, n_ignored AS ignored_lines, n_bad AS parse_errors, n_events + n_issues AS ingested FROM line_counts",
        "log_meta": ev + "SELECT log_id, n_events + n_issues + n_cont + n_bad + n_ignored AS line_count, lo_ns, hi_ns FROM line_counts JOIN meta USING (log_id)",
        "parse_events": ev + f"SELECT log_id, seq, ts_ns, kind, {payload} FROM ev",
        "event_kind_counts": ev + "SELECT log_id, kind, count(*) AS n_events FROM ev GROUP BY ALL",
        "issue_events": every + "SELECT log_id, seq, ts_ns, severity, module, body FROM issue_ev",
        "issue_bodies": f"SELECT doc_id, {_SAN.format(x=cut)} AS body FROM documents",
        "display_bodies": r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0A-\x1F\x7F]', chr(65533), 'g') AS body FROM documents",
        "overall_counters": every + "SELECT * FROM overall",
        "slots": every + f"SELECT {_SLOT_COLS} FROM slots",
        "skip_classification": every + "SELECT log_id, slot, skip_classification FROM slots",
        "skip_counts": every + "SELECT log_id, canonical_direct, canonical_ancestry, indeterminate FROM outcomes",
        "slot_outcomes": every + "SELECT * FROM outcomes",
        "leader_slots": every + "SELECT log_id, slot FROM led",
        "slot_view": view + "SELECT * FROM vw",
        "slot_filter_vskip_or_cskip": view + "SELECT * FROM vw WHERE status_label IN ('VSKIP', 'CSKIP')",
        "slot_filter_leader_fast": view + "SELECT * FROM vw WHERE we_are_leader AND status = 'fast'",
        "slot_filter_tcl_vskip": view + "SELECT * FROM vw WHERE crashed_leader AND status_label = 'VSKIP'",
        "slot_filter_slow": view + "SELECT * FROM vw WHERE status = 'slow'",
        "slot_filter_s2n_s2s": view + "SELECT * FROM vw WHERE safe_to_notar AND safe_to_skip",
        "slot_filter_slow_s2n_s2s": view + "SELECT * FROM vw WHERE status = 'slow' AND safe_to_notar AND safe_to_skip",
        "slot_page": view + "SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY slot) AS place FROM vw QUALIFY place BETWEEN 101 AND 150",
        "incident_page": every + "SELECT log_id, tcl_slot, resume_slot, resume_us, slot_gap, severity, row_number() OVER (PARTITION BY log_id ORDER BY resume_us DESC, tcl_slot) AS place FROM resumes QUALIFY place BETWEEN 3 AND 12",
        "standstill_ranges": every + "SELECT log_id, entry_slot, exit_slot, seq FROM ranges",
        "standstill_alerts": every + "SELECT log_id, slot, firings, first_ns, last_ns FROM firings",
        "tcl_outside_standstill": every + "SELECT * FROM tcl",
        "latency_samples": every + "SELECT * FROM samples",
        "latency_stages": every + f"SELECT log_id, stage, n, {_percentiles()} FROM life",
        "lifecycle_latency": every + f"SELECT log_id, n, {_percentiles()} FROM life WHERE stage = 'lifecycle'",
        "top_slowest_slots": _with(*_ALL, _TOP_LIFE) + "SELECT * FROM top_life",
        "vote_resumes": every + "SELECT log_id, tcl_slot, resume_slot, resume_us FROM resumes",
        "resume_percentiles": _with(*_ALL, _TOP_LIFE) + f"SELECT log_id, n, {_percentiles()} FROM resume_life",
        "resume_severity": every + "SELECT log_id, count(*) FILTER (severity = 'normal') AS normal, count(*) FILTER (severity = 'elevated') AS elevated, count(*) FILTER (severity = 'severe') AS severe, count(*) AS total FROM resumes GROUP BY log_id",
        "resume_distribution": every + f"SELECT l.log_id, v.bin::BIGINT AS bin, v.label, count(r.resume_us) AS n, round(count(r.resume_us) * 100.0::DOUBLE / (SELECT count(*) FROM resumes x WHERE x.log_id = l.log_id), 6) AS pct FROM (SELECT DISTINCT log_id FROM resumes) l CROSS JOIN {bins} LEFT JOIN resumes r ON r.log_id = l.log_id AND r.resume_us >= v.lo AND r.resume_us < v.hi GROUP BY l.log_id, v.bin, v.label",
        "incidents": every + "SELECT log_id, tcl_slot, resume_slot, resume_us, slot_gap, severity, row_number() OVER (PARTITION BY log_id ORDER BY resume_us DESC, tcl_slot) AS place FROM resumes",
        "top_resumes": _with(*_ALL, _TOP_LIFE) + "SELECT * FROM top_res",
        "voting_gaps": every + "SELECT * FROM gaps WHERE gap_slots >= 2",
        "voting_gaps_all": every + "SELECT * FROM gaps",
        "top_gaps": _with(*_ALL, _TOP_LIFE) + "SELECT * FROM top_gap",
        "gap_durations": every + f"""SELECT log_id, start_slot, {wall} AS secs, {_full(wall)} AS full_text, {_short(wall)} AS header_text,
            ({wall} // 3600) || 'h ' || ({wall} % 3600 // 60) || 'm' AS hm_text,
            CASE WHEN {wall} >= 3600 THEN ({wall} // 3600) || 'h' WHEN {wall} >= 60 THEN ({wall} // 60) || 'm' ELSE {wall} || 's' END AS coarse_text,
            CASE WHEN {wall} >= 3600 AND {wall} % 3600 = 0 THEN ({wall} // 3600) || 'h'
                 WHEN {wall} >= 3600 THEN ({wall} // 3600) || 'h ' || ({wall} % 3600 // 60) || 'm'
                 WHEN {wall} >= 60 AND {wall} % 60 = 0 THEN ({wall} // 60) || 'm' ELSE {wall} || 's' END AS bucket_text FROM gaps""",
        "time_buckets_10m": bucket + "SELECT * FROM buckets",
        "bucket_series": bucket + "SELECT * FROM series",
        "series_stats": bucket + "SELECT log_id, series, sum(value)::BIGINT AS total, min(value) AS min_value, max(value) AS max_value, (sum(value) // count(*))::BIGINT AS mean_value, count(*) FILTER (value > 0) AS active, count(*) AS n_buckets FROM long GROUP BY ALL",
        "deviation_series": bucket + ", bl AS (SELECT log_id, series, list_sort(list(value))[count(*) // 10 + 1] AS baseline, max(value) AS top FROM long GROUP BY ALL) SELECT log_id, series, bucket, value, baseline, greatest(value - baseline, 0) AS deviation, greatest(top - baseline, 1) AS dev_peak FROM long JOIN bl USING (log_id, series)",
        "trend_stats": bucket + "SELECT log_id, sum(resume_n)::BIGINT AS total, max(resume_n) AS peak, min(resume_n) AS min_value, round(sum(resume_n)::DOUBLE / count(*), 6) AS avg_value, count(*) FILTER (resume_n > 0) AS nonzero, round(count(*) FILTER (resume_n > 0) * 100.0::DOUBLE / count(*), 6) AS coverage_pct, list_sort(list(resume_n))[count(*) // 10 + 1] AS baseline, max(resume_n) - list_sort(list(resume_n))[count(*) // 10 + 1] AS dev_peak FROM buckets GROUP BY log_id",
        "resampled_series": bucket + ", ln AS (SELECT log_id, series, count(*) AS len FROM long GROUP BY ALL), pts AS (SELECT log_id, series, unnest(range(0, 80)) AS point, len FROM ln) SELECT log_id, series, point, value FROM (SELECT log_id, series, point, point * len // 80 AS bucket FROM pts) JOIN long USING (log_id, series, bucket)",
        "tx_per_block": bucket + "SELECT log_id, sum(signature_sum)::BIGINT AS signature_sum, sum(signature_sample_count)::BIGINT AS blocks, COALESCE(sum(signature_sum)::BIGINT // nullif(sum(signature_sample_count)::BIGINT, 0), 0) AS avg_tx_per_block FROM buckets GROUP BY log_id",
        "window_stats": _with(*_ALL, _WINDOWS) + f"""
            SELECT w.log_id, w.label, w.start_ns, w.end_ns, COALESCE(slot_count, 0) AS slot_count,
                   round(COALESCE(slot_count, 0) / greatest(secs, 1.0::DOUBLE), 6) AS slot_rate_per_sec,
                   {_pct("fast", "fast + slow")} AS fast_finalize_pct, {_pct("vote_skips", "slot_count")} AS vote_skip_pct,
                   COALESCE(vote_skips, 0) AS vote_skips, COALESCE(canonical_skips, 0) AS canonical_skips,
                   COALESCE(indeterminate_skips, 0) AS indeterminate_skips,
                   {_pct("canonical_skips", "vote_skips")} AS canonical_skip_pct,
                   COALESCE(crashed_leaders, 0) AS crashed_leaders, COALESCE(fragmentation, 0) AS fragmentation,
                   {_p("d_xs", "0.5")} AS slot_duration_p50_us, {_p("d_xs", "0.95")} AS slot_duration_p95_us,
                   {_p("a_xs", "0.5")} AS assembly_p50_us, {_p("a_xs", "0.95")} AS assembly_p95_us,
                   {_p("c_xs", "0.5")} AS consensus_p50_us, {_p("c_xs", "0.95")} AS consensus_p95_us,
                   {_p("l_xs", "0.5")} AS lifecycle_p50_us, {_p("l_xs", "0.95")} AS lifecycle_p95_us,
                   {_p("l_xs", "0.99")} AS lifecycle_p99_us, {_p("r_xs", "0.5")} AS resume_p50_us,
                   {_p("r_xs", "0.95")} AS resume_p95_us, {_p("r_xs", "0.99")} AS resume_p99_us,
                   round({_p("l_xs", "0.95")} / 1000.0::DOUBLE / 400.0::DOUBLE, 6) AS lifecycle_p95_per_slot_time
            FROM wins w LEFT JOIN wslots USING (log_id, label) LEFT JOIN wdur USING (log_id, label) LEFT JOIN wres USING (log_id, label)""",
        "slot_durations": _with(*_ALL, _WINDOWS) + "SELECT log_id, slot, duration_us FROM durations",
        "log_issue_groups": every + "SELECT * FROM groups",
        "log_pattern_order": every + "SELECT log_id, severity, module, n, first_ns, row_number() OVER (PARTITION BY log_id ORDER BY CASE severity WHEN 'Critical' THEN 2 WHEN 'Warn' THEN 1 ELSE 0 END DESC, n DESC, module, first_ns) AS place FROM groups",
        "issue_histogram": every + _histogram("issue_ev", "log_id, severity, module", 24),
        "issue_histogram_capped": every + ", kept AS (SELECT * FROM issue_ev QUALIFY row_number() OVER (PARTITION BY log_id, severity, module ORDER BY seq) <= 40)" + _histogram("kept", "log_id, severity, module", 24),
        "leader_window_histogram": every + _histogram("win_ok", "log_id", 24),
        "leader_summary": every + "SELECT * FROM leader",
        "leadership_share": every + f"SELECT log_id, produce_windows, leader_slots, distinct_slots, {_pct('leader_slots', 'distinct_slots')} AS leader_slot_pct FROM facts",
        "alerts": every + f"SELECT {alert_cols} FROM alerts",
        "actionable_alerts": every + f"SELECT {alert_cols} FROM alerts WHERE severity <> 'Info'",
        "alert_rollup": every + "SELECT log_id, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Warn') AS warn, count(*) FILTER (severity = 'Info') AS info, count(*) AS total FROM alerts GROUP BY log_id",
        "alert_detail": every + f"""
            , d AS (SELECT a.*, g.sample_body,
                      CASE WHEN kind = 'LogPattern' THEN g.first_ns WHEN kind = 'StandstillObserved' THEN at_ns END AS first_at,
                      CASE WHEN kind = 'LogPattern' THEN g.last_ns ELSE a.last_ns END AS last_at
                    FROM alerts a LEFT JOIN groups g ON g.log_id = a.log_id AND g.severity = a.severity AND g.module = a.module),
            e AS (SELECT *, greatest((last_at - first_at) // 1000000000, 0) AS raw_span FROM d),
            f AS (SELECT *, CASE WHEN last_at IS NOT NULL THEN raw_span END AS span FROM e)
            SELECT log_id, alert_rank, severity, kind, at_ns,
                   CASE kind WHEN 'LogPattern' THEN split_part(module, '::', -1) WHEN 'StandstillObserved' THEN 'standstill'
                        WHEN 'ClusterSlotsShutdownObserved' THEN 'shutdown' WHEN 'IdentityChanged' THEN 'identity-change'
                        ELSE 'local-leader' END AS module_short,
                   module, count, first_at AS first_ns, last_at AS last_ns, span AS span_secs, {_full("span")} AS span_label,
                   CASE WHEN span > 0 THEN round(count * 60.0::DOUBLE / span, 6) END AS rate_per_min,
                   sample_body, at_slot, slot_count, window_count,
                   CASE WHEN strlen({body}) <= 60 THEN {body} ELSE {cut60} || '…' END AS preview, description
            FROM f""",
        "slot_range": every + "SELECT log_id, min_slot, max_slot, distinct_slots FROM outcomes",
        "vote_cert_flow": flow + f"SELECT log_id, votes_notarize, votes_finalize, greatest(votes_notarize - votes_finalize, 0) AS notarize_without_finalize, block_notarized, block_notar_fallback, true_fb AS true_fallbacks, {_pct('true_fb', 'block_notar_fallback')} AS true_fallback_pct, fallback_only_slots, finalized_total, finalized_fast, finalized_slow, {_pct('finalized_fast', 'finalized_total')} AS fast_pct, {_pct('finalized_slow', 'finalized_total')} AS slow_pct FROM flow",
        "block_flow": every + "SELECT log_id, first_shreds, bank_frozen, setting_root, new_root, greatest(bank_frozen - first_shreds, 0) AS frozen_without_shred, greatest(bank_frozen - setting_root, 0) AS frozen_not_rooted, greatest(setting_root - new_root, 0) AS pruning_in_flight FROM facts",
        "cluster_slots_rate": every + "SELECT log_id, no_epoch_metadata, cluster_slots_service_stopped, round(no_epoch_metadata / (hours1 * 3600.0), 6) AS per_sec FROM facts WHERE no_epoch_metadata > 0 OR cluster_slots_service_stopped",
        "crashed_leader_pct": every + f"SELECT log_id, distinct_slots // 4 AS leader_windows, timeout_crashed_leaders AS tcl_events, tcl_outside_standstill, {_pct('timeout_crashed_leaders', 'distinct_slots // 4')} AS crashed_pct, {_pct('tcl_outside_standstill', 'distinct_slots // 4')} AS crashed_outside_pct, standstill_ranges > 0 AS has_standstill FROM facts",
        "rates": every + "SELECT log_id, resume_total, round(resume_total / hours, 6) AS resumes_per_hour, safe_to_notar + safe_to_skip AS fragmentation, round((safe_to_notar + safe_to_skip) / hours1, 6) AS fragmentation_per_hour FROM facts",
        "fin_pcts": flow + f"SELECT log_id, {_pct('finalized_slots', 'distinct_slots')} AS finalized_pct, {_pct('skipped_slots', 'distinct_slots')} AS skipped_pct, {_pct('votes_skip', 'distinct_slots')} AS vote_skip_events_pct, {_pct('canonical', 'skipped_slots')} AS canonical_pct_slots, {_pct('canonical', 'votes_skip')} AS canonical_pct_events FROM flow",
        "health_verdicts": _with(*_ALL, _FLOW, _VERDICTS) + "SELECT log_id, metric, value, verdict, is_lower_bound FROM verdicts",
        "summary_report": _report(),
        "text_source_events": ev + f"SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY seq) AS place, ts_ns, kind, {payload} FROM ev",
        "stream_files": ev + f"SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY seq) AS place, ts_ns, kind, {payload} FROM ev",
        "log_files": ev + "SELECT log_id, 3::BIGINT AS n_files, n_events + n_issues + n_cont + n_bad + n_ignored AS line_count FROM line_counts",
        "stream_parse": ev + "SELECT * FROM (SELECT log_id, unnest(['event', 'issue', 'continuation', 'parse_error', 'ignored']) AS outcome, unnest([n_events, n_issues, n_cont, n_bad, n_ignored]) AS n FROM line_counts) WHERE n > 0",
        "stream_counters": ev + "SELECT log_id, kind, ts_ns // 1000000000 // 600 * 600 AS start_secs, count(*) AS n FROM ev GROUP BY ALL",
        "stream_standstill": every + """
            SELECT log_id, 'range' AS what, entry_slot AS slot, exit_slot AS slot_end, seq,
                   CAST(NULL AS BIGINT) AS firings, CAST(NULL AS BIGINT) AS first_ns, CAST(NULL AS BIGINT) AS last_ns FROM ranges
            UNION ALL SELECT log_id, 'firing', slot, NULL, NULL, firings, first_ns, last_ns FROM firings""",
        "stream_issues": every + "SELECT * FROM groups",
        "stream_slots": every + f"SELECT {_SLOT_COLS.replace(', skip_classification', '')} FROM slots",
    }
