"""Every operator as a query over the audit view of the driver's event stream, with DuckDB SQL for the same rows.

Times are fixed: 'now' is 2024-02-01, the reporting period is January 2024.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fx
from .functions import timeranges as tr
from .functions.ids import id_prefix, is_id
from .operators import alerts, chain, compliance, erasure, export, retention
from .plans import cube
from .plans import query as q
from .schema import DIMENSIONS, POLICIES
from .scope import Scope, client_ip
from .sources import lines, sinks
from .sources.audit_view import SQL as AUDIT
from .sources.audit_view import audit_events, audit_view
from .sources.scratch import scratch
from .sources.store import Store
from .streaming.ingest import Recorder, append_stream, problems, validated

NOW = datetime(2024, 2, 1)
FROM, TO = datetime(2024, 1, 1), datetime(2024, 1, 31)
MEMBER = Scope("app0", "t1")
KEY = "0123456789abcdef0123456789abcdef"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The chain in SQL: a recursion over places, all chains at once.
CONTENT = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(timestamp, '.%f'), '0'), '.') || 'Z|' || action || '|' || resource || '|' || category || '|' || resource_id || '|' || outcome || '|' || severity || '|' || metadata"
CHAIN = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY app_id, tenant_id ORDER BY timestamp, id) AS sequence, {CONTENT} AS tail FROM audit),
chain AS (
  SELECT id, app_id, tenant_id, timestamp, sequence, '' AS prev_hash, sha256('|' || tail) AS hash FROM numbered WHERE sequence = 1
  UNION ALL SELECT n.id, n.app_id, n.tenant_id, n.timestamp, n.sequence, c.hash, sha256(c.hash || '|' || n.tail) FROM chain c JOIN numbered n ON n.app_id = c.app_id AND n.tenant_id = c.tenant_id AND n.sequence = c.sequence + 1
)"""
STREAM = "'stream_' || left(sha256(app_id || '|' || tenant_id), 26)"


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers a query of the audit events; its SQL sees them as `audit`."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(audit_events(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH {'RECURSIVE ' * recursive}audit AS ({AUDIT}){', ' + CHAIN if recursive else ''} {sql}"
        return f

    return add


# point lookups, filters, pages
query("event_by_id", "SELECT id, timestamp, action, user_id FROM audit WHERE id = 'audit_00000000000000000000000123'")(lambda e: e.where(F.col("id") == "audit_00000000000000000000000123").limit(1).select("id", "timestamp", "action", "user_id"))
PAGE = "SELECT id, timestamp, action, outcome FROM audit WHERE"
_page = ["id", "timestamp", "action", "outcome"]
query("query_category_in", f"{PAGE} category IN ('auth', 'ai')")(lambda e: e.where(q.condition(q.Query(categories=["auth", "ai"]))).select(_page))
query("query_multi_filter", f"{PAGE} app_id = 'app1' AND tenant_id = 't3' AND category IN ('data') AND action IN ('read', 'write') AND resource IN ('record') AND severity IN ('info', 'warning') AND outcome IN ('success', 'denied')")(
    lambda e: e.where(q.condition(q.Query("app1", "t3", categories=["data"], actions=["read", "write"], resources=["record"], severities=["info", "warning"], outcomes=["success", "denied"]))).select(_page)
)
query("query_time_range_closed", f"{PAGE} timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-06 12:00:00'")(lambda e: e.where(q.condition(q.Query(after=datetime(2024, 1, 5), before=datetime(2024, 1, 6, 12)))).select(_page))
query("query_page_desc", f"{PAGE} tenant_id = 't1' ORDER BY timestamp DESC, id LIMIT 100")(lambda e: q.page_of(e, q.Query(tenant_id="t1")).select(_page))
query("query_page_asc_offset", f"{PAGE} category IN ('auth') ORDER BY timestamp, id LIMIT 25 OFFSET 50")(lambda e: q.page_of(e, q.Query(categories=["auth"], limit=25, offset=50, order="asc")).select(_page))
query("query_offset_past_end", f"{PAGE} false")(lambda e: q.page_of(e, q.Query(tenant_id="t1", offset=10**7)).select(_page))
query("query_offset_last_page", f"{PAGE} user_id = 'u7' QUALIFY row_number() OVER (ORDER BY timestamp DESC, id) > 3")(lambda e: q.page_of(e, q.Query(user_id="u7", offset=3, limit=10**6)).select(_page))
query("query_deep_page", f"{PAGE} category <> 'ai' ORDER BY timestamp DESC, id LIMIT 50 OFFSET 500")(lambda e: q.deep_page(e.where("category <> 'ai'"), q.Query(limit=50, offset=500)).select(_page))
query("query_total_has_more", "SELECT count(*) AS total, CAST(greatest(0, least(20, count(*) - 40)) AS BIGINT) AS page, count(*) > 40 + greatest(0, least(20, count(*) - 40)) AS has_more FROM audit WHERE category = 'auth'")(lambda e: q.page_report(e, q.Query(categories=["auth"], limit=20, offset=40)))
query("by_user", f"{PAGE} user_id = 'u7' AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp <= TIMESTAMP '2024-01-20'")(lambda e: q.by_user(e, "u7", datetime(2024, 1, 3), datetime(2024, 1, 20)).select(_page))
query("tenant_scope_forced", f"{PAGE} app_id = 'app0' AND tenant_id = 't1' AND category IN ('data')")(lambda e: e.where(q.condition(MEMBER.apply(q.Query(tenant_id="t5", categories=["data"])))).select(_page))
query("recent_critical", f"{PAGE} severity = 'critical' ORDER BY timestamp DESC, id LIMIT 10")(lambda e: q.recent(e, 10, True).select(_page))
query("id_validity", "SELECT regexp_matches(id, '^audit_[0-7][0-9a-hjkmnp-tv-z]{25}$') AS valid, split_part(id, '_', 1) AS prefix, count(*) AS count FROM audit GROUP BY ALL")(lambda e: e.groupBy(is_id(F.col("id"), "audit").alias("valid"), id_prefix(F.col("id")).alias("prefix")).count())

CURSOR = (datetime(2024, 1, 20, 7, 30), "audit_00000000000000000000005000")
query("query_cursor_desc", f"{PAGE} tenant_id = 't1' AND (timestamp < TIMESTAMP '2024-01-20 07:30:00' OR (timestamp = TIMESTAMP '2024-01-20 07:30:00' AND id > '{CURSOR[1]}')) ORDER BY timestamp DESC, id LIMIT 30")(
    lambda e: q.page_of(e, q.Query(tenant_id="t1", limit=30, cursor=CURSOR)).select(_page)
)
query("query_cursor_asc", f"{PAGE} category IN ('ai') AND timestamp > TIMESTAMP '2024-01-20 07:30:00' ORDER BY timestamp, id LIMIT 30")(lambda e: q.page_of(e, q.Query(categories=["ai"], limit=30, order="asc", cursor=(CURSOR[0], "z"))).select(_page))

# group counts
for _dims in [*([d] for d in DIMENSIONS), ["outcome", "severity"], list(DIMENSIONS)]:
    _name = "agg_" + ("all_dims" if len(_dims) == 5 else "_".join(_dims))
    query(_name, f"SELECT {', '.join(_dims)}, count(*) AS count FROM audit GROUP BY ALL")(partial(lambda e, dims: q.aggregate(e, q.AggregateQuery(group_by=dims)), dims=_dims))
query("agg_scoped_range", "SELECT category, count(*) AS count FROM audit WHERE app_id = 'app0' AND tenant_id = 't1' AND timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY category")(
    lambda e: q.aggregate(e, MEMBER.apply(q.AggregateQuery(after=datetime(2024, 1, 10), before=datetime(2024, 1, 20), group_by=["category"])))
)
query("agg_total_scoped", "SELECT count(*) AS total FROM audit WHERE app_id = 'app0' AND tenant_id = 't1'")(lambda e: q.aggregate_total(e, MEMBER.apply(q.AggregateQuery(group_by=["category"]))))
query("agg_ranked", "SELECT category, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, category) AS place FROM audit GROUP BY category")(lambda e: q.ranked(e, q.AggregateQuery(group_by=["category"])))
query("count_scoped", "SELECT count(*) AS count FROM audit WHERE app_id = 'app0' AND tenant_id = 't1' AND category = 'auth'")(lambda e: q.count(e, MEMBER.apply(q.CountQuery(category="auth"))))
query("count_by_subject", "SELECT count(*) AS count FROM audit WHERE subject_id = 'subj-5'")(lambda e: erasure.count_by_subject(e, "subj-5"))
query("stats_bundle", "SELECT 'total' AS kind, '' AS value, count(*) AS count FROM audit UNION ALL SELECT 'category', category, count(*) FROM audit GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM audit GROUP BY 2 UNION ALL SELECT 'outcome', outcome, count(*) FROM audit GROUP BY 2")(
    lambda e: q.stats_bundle(e, q.AggregateQuery())
)
query("dashboard_tiles", "SELECT count(*) AS total, count(*) FILTER (fresh AND severity = 'critical') AS critical, count(*) FILTER (fresh AND outcome IN ('failure', 'denied')) AS failed FROM (SELECT *, timestamp BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-02-01' AS fresh FROM audit)")(lambda e: q.dashboard_tiles(e, NOW))


# chains
CHAINED = "SELECT id, app_id, tenant_id, sequence, prev_hash, hash FROM chain"
_chained = ["id", "app_id", "tenant_id", "sequence", "prev_hash", "hash"]
query("chain_append", CHAINED, True)(lambda e: chain.append_chain(e).select(_chained))


@query("chain_append_resumed", CHAINED, True)
def _resumed(e: DataFrame) -> DataFrame:
    """Half a month is stored, the rest goes on from its heads."""
    old, new = (e.where(f"timestamp {op} TIMESTAMP_NTZ '2024-01-15'") for op in ("<", ">="))
    stored = chain.append_chain(old)
    return stored.select(_chained).unionByName(chain.append_chain(new, chain.heads(stored)).select(_chained))


query("stream_heads", f"SELECT app_id, tenant_id, {STREAM} AS stream_id, max(sequence) AS head_seq, max_by(hash, sequence) AS head_hash FROM chain GROUP BY app_id, tenant_id", True)(lambda e: chain.heads(chain.append_chain(e)))
query("last_sequence", "SELECT app_id, tenant_id, max(sequence) AS last_sequence FROM chain GROUP BY ALL", True)(lambda e: chain.heads(chain.append_chain(e)).select("app_id", "tenant_id", F.col("head_seq").alias("last_sequence")))
query("last_hash", "SELECT app_id, tenant_id, max_by(hash, sequence) AS last_hash FROM chain GROUP BY ALL", True)(lambda e: chain.heads(chain.append_chain(e)).select("app_id", "tenant_id", F.col("head_hash").alias("last_hash")))
query("stream_by_scope", f"SELECT {STREAM} AS stream_id, max(sequence) AS head_seq FROM chain WHERE app_id = 'app1' AND tenant_id = 't2' GROUP BY 1", True)(lambda e: chain.heads(chain.append_chain(e)).where(Scope("app1", "t2").owns()).select("stream_id", "head_seq"))
query("streams_page", f"SELECT {STREAM} AS id, min(timestamp) AS created_at FROM chain GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5 OFFSET 3", True)(lambda e: q.listing(_stream_times(chain.append_chain(e)), 5, 3))
query("event_range", f"SELECT id, sequence FROM chain WHERE {STREAM} = 'stream_' || left(sha256('app1|t3'), 26) AND sequence BETWEEN 10 AND 30", True)(lambda e: _range(chain.append_chain(e)))
query("verify_event", "SELECT id, true AS valid FROM audit")(lambda e: chain.verify_events(chain.append_chain(e)))


def _stream_times(chained: DataFrame) -> DataFrame:
    return chained.groupBy(F.col("stream_id").alias("id")).agg(F.min("timestamp").alias("created_at"))


def _range(chained: DataFrame) -> DataFrame:
    import hashlib

    return chain.event_range(chained, "stream_" + hashlib.sha256(b"app1|t3").hexdigest()[:26], 10, 30).select("id", "sequence")


def _tampered(e: DataFrame) -> DataFrame:
    """Every 50th event of a chain is missing, every 30th edited."""
    c = chain.append_chain(e)
    return c.where("sequence % 50 <> 0").withColumn("metadata", F.when(F.col("sequence") % 30 == 0, '{"k": -1}').otherwise(F.col("metadata")))


REPORTED = """SELECT app_id, tenant_id, missing = 0 AND altered = 0 AS valid, verified, first_event, last_event, missing, altered, gaps, tampered FROM (
 SELECT app_id, tenant_id, count(*) FILTER (here) AS verified, min(sequence) FILTER (here) AS first_event, max(sequence) FILTER (here) AS last_event,
  count(*) FILTER (NOT here AND sequence < last_here) AS missing, count(*) FILTER (here AND bad) AS altered,
  coalesce(list(sequence ORDER BY sequence) FILTER (NOT here AND sequence < last_here), []) AS gaps, coalesce(list(sequence ORDER BY sequence) FILTER (here AND bad), []) AS tampered
 FROM (SELECT *, {here} AS here, {bad} AS bad, max(CASE WHEN {here} THEN sequence END) OVER (PARTITION BY app_id, tenant_id) AS last_here FROM chain) GROUP BY app_id, tenant_id)"""
query("verify_chain_clean", REPORTED.format(here="true", bad="false"), True)(lambda e: chain.verify_chains(chain.append_chain(e), listed=None))
query("verify_chain_tampered", REPORTED.format(here="sequence % 50 <> 0", bad="(sequence % 30 = 0 OR (sequence > 1 AND (sequence - 1) % 50 = 0))"), True)(lambda e: chain.verify_chains(_tampered(e), listed=None))
query("sequence_gaps", "SELECT app_id, tenant_id, sequence FROM (SELECT *, max(CASE WHEN sequence % 50 <> 0 THEN sequence END) OVER (PARTITION BY app_id, tenant_id) AS top FROM chain) WHERE sequence % 50 = 0 AND sequence < top", True)(lambda e: chain.gaps(_tampered(e)))
query("sequence_holes", "SELECT app_id, tenant_id, sequence AS first, sequence + 1 AS last FROM (SELECT *, max(CASE WHEN sequence % 50 > 1 THEN sequence END) OVER (PARTITION BY app_id, tenant_id) AS top FROM chain) WHERE sequence % 50 = 0 AND sequence < top UNION ALL SELECT DISTINCT app_id, tenant_id, 1, 1 FROM chain", True)(
    lambda e: chain.holes(chain.append_chain(e).where("sequence % 50 > 1")).select("app_id", "tenant_id", F.col("first").cast("bigint"), F.col("last").cast("bigint"))
)
query("verify_event_tampered", "SELECT id, sequence % 30 <> 0 AS valid FROM chain WHERE sequence % 50 <> 0", True)(lambda e: chain.verify_events(_tampered(e)))
query("sequence_gaps_range", "SELECT h.app_id, h.tenant_id, s.sequence FROM (SELECT DISTINCT app_id, tenant_id FROM chain) h, (SELECT unnest(range(40, 161)) AS sequence) s WHERE NOT EXISTS (SELECT 1 FROM chain c WHERE c.app_id = h.app_id AND c.tenant_id = h.tenant_id AND c.sequence = s.sequence AND c.sequence % 50 <> 0)", True)(lambda e: chain.gaps(_tampered(e), 40, 160))
query("tampered_events", "SELECT id, sequence FROM chain WHERE sequence % 50 <> 0 AND (sequence % 30 = 0 OR (sequence > 1 AND (sequence - 1) % 50 = 0))", True)(lambda e: chain.chain_marks(_tampered(e)).where("tampered").select("id", "sequence"))


# compliance
def _match(s: compliance.SectionDef) -> str:
    lists = (("category", s.categories), ("action", s.actions), ("severity", s.severities))
    return " AND ".join(f"{c} IN ({', '.join(map(repr, xs))})" for c, xs in lists if xs)


CUSTOM = (compliance.SectionDef("Denied or failed admin", ("access", "config"), (), ("warning", "critical"), "note"), compliance.SectionDef("Deploys", (), ("deploy",)))
TENANT = "app_id = 'app1' AND timestamp >= TIMESTAMP '2024-01-01' AND timestamp <= TIMESTAMP '2024-01-31'"


def _sections_sql(sections: tuple[compliance.SectionDef, ...], columns: str, cap: int = compliance.SECTION_CAP) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS section_no, '{s.title}' AS section, {columns} FROM (SELECT * FROM audit WHERE {TENANT} AND {_match(s)} ORDER BY timestamp, id LIMIT {cap})" for i, s in enumerate(sections))


def _period(e: DataFrame) -> DataFrame:
    return compliance.in_period(e, FROM, TO, "app1")


for _name, _defs in (*compliance.TEMPLATES.items(), ("custom", CUSTOM)):
    query(f"{_name}_sections", _sections_sql(_defs, "id, timestamp, outcome"))(partial(lambda e, defs: compliance.section_events(_period(e), defs).select("section_no", "section", "id", "timestamp", "outcome"), defs=_defs))
    query(f"{_name}_report_stats", f"SELECT count(*) AS total_events, count(*) FILTER (severity = 'critical') AS critical_events, count(*) FILTER (outcome = 'failure') AS failed_events, count(*) FILTER (outcome = 'denied') AS denied_events FROM (SELECT DISTINCT id, severity, outcome FROM ({_sections_sql(_defs, 'id, severity, outcome')}))")(
        partial(lambda e, defs: compliance.report_stats(compliance.section_events(_period(e), defs)), defs=_defs)
    )
query("section_counts", " UNION ALL ".join(f"SELECT {i} AS section_no, '{s.title}' AS section, count(*) AS events, count(*) > 1000 AS truncated FROM audit WHERE {TENANT} AND {_match(s)}" for i, s in enumerate(compliance.SOC2)))(lambda e: compliance.section_counts(_period(e), compliance.SOC2))
query("section_stats", f"SELECT outcome, severity, count(*) AS count FROM audit WHERE {TENANT} GROUP BY ALL")(lambda e: compliance.group_counts(_period(e)))
query("report_csv_rows", f"SELECT section, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, {', '.join(export.CSV_COLUMNS[2:])} FROM ({_sections_sql(compliance.HIPAA, '*')})")(lambda e: export.csv_rows(compliance.section_events(_period(e), compliance.HIPAA)))


# erasure
def _erasures(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('erasure_1', 'subj-0', TIMESTAMP_NTZ '2024-01-10'), ('erasure_2', 'subj-0', TIMESTAMP_NTZ '2024-01-20'), ('erasure_3', 'subj-5', TIMESTAMP_NTZ '2024-01-15') AS t(id, subject_id, created_at)")


query("erasures_listed", "SELECT id, subject_id FROM audit WHERE subject_id <> '' ORDER BY timestamp DESC, id LIMIT 40 OFFSET 15")(lambda e: q.listing(_requests(e), 40, 15).select("id", "subject_id"))
query("erasure_tile", "SELECT least(count(*), 150) AS erasures FROM audit WHERE subject_id <> ''")(lambda e: q.erasure_tile(_requests(e), 150))


def _requests(e: DataFrame) -> DataFrame:
    """Every event of a subject as a request to erase it."""
    return e.where("subject_id <> ''").select("id", "subject_id", F.col("timestamp").alias("created_at"))


SCOPED = "('erasure_1', 'subj-0', 'app0', 't1', '2024-01-10'), ('erasure_2', 'subj-0', 'app0', '', '2024-01-20'), ('erasure_3', 'subj-5', '', '', '2024-01-15'), ('erasure_4', 'subj-5', 'app1', 't2', '2024-01-12'), ('erasure_5', 'subj-5', 'app1', 't2', '2024-01-25')"
query("erasure_scoped", f"SELECT a.id, subject_id, x.i IS NOT NULL AS erased, x.w AS erased_at, coalesce(x.i, '') AS erasure_id FROM audit a LEFT JOIN LATERAL (SELECT i, CAST(w AS TIMESTAMP) AS w FROM (VALUES {SCOPED}) t(i, s, p, n, w) WHERE s = a.subject_id AND p IN ('', a.app_id) AND n IN ('', a.tenant_id) AND CAST(w AS TIMESTAMP) >= a.timestamp ORDER BY w, i LIMIT 1) x ON true")(
    lambda e: erasure.erasure_overlay(e, e.sparkSession.sql(f"SELECT id, subject_id, app_id, tenant_id, CAST(at AS TIMESTAMP_NTZ) AS created_at FROM VALUES {SCOPED} AS t(id, subject_id, app_id, tenant_id, at)")).select("id", "subject_id", "erased", "erased_at", "erasure_id")
)
ERASED = "(VALUES ('erasure_1', 'subj-0', TIMESTAMP '2024-01-10'), ('erasure_2', 'subj-0', TIMESTAMP '2024-01-20'), ('erasure_3', 'subj-5', TIMESTAMP '2024-01-15'))"
query("erasure_overlay", f"SELECT a.id, subject_id, x.i IS NOT NULL AS erased, x.w AS erased_at, coalesce(x.i, '') AS erasure_id FROM audit a LEFT JOIN LATERAL (SELECT i, w FROM {ERASED} t(i, s, w) WHERE s = a.subject_id AND w >= a.timestamp ORDER BY w LIMIT 1) x ON true")(
    lambda e: erasure.erasure_overlay(e, _erasures(e.sparkSession)).select("id", "subject_id", "erased", "erased_at", "erasure_id")
)
query("crypto_roundtrip", "SELECT id, metadata AS plain, true AS wrong_key_null, 28 + strlen(metadata) AS cipher_bytes FROM audit")(
    lambda e: e.withColumn("c", erasure.encrypt(F.col("metadata"), F.lit(KEY))).select("id", erasure.decrypt(F.col("c"), F.lit(KEY)).cast("string").alias("plain"), erasure.decrypt(F.col("c"), F.lit(KEY[::-1])).isNull().alias("wrong_key_null"), F.octet_length("c").cast("bigint").alias("cipher_bytes"))
)


@query("crypto_erased_subjects", "SELECT id, CASE WHEN subject_id = 'subj-0' THEN NULL ELSE reason END AS reason FROM audit WHERE subject_id <> ''")
def _sealed(e: DataFrame) -> DataFrame:
    """Sealed under a key per subject; one subject's key is destroyed before opening."""
    keys = e.where("subject_id <> ''").select("subject_id").distinct().withColumn("key", F.unhex(F.sha2("subject_id", 256)))
    sealed = erasure.sealed(e.where("subject_id <> ''"), keys, ["reason"])
    return erasure.opened(sealed, keys.where("subject_id <> 'subj-0'"), ["reason"]).select("id", "reason")


# retention
def _policies(spark: SparkSession) -> DataFrame:
    day = 86_400 * 10**9
    at = lambda n: FROM + timedelta(n)
    rows = [("retpol_1", "auth", 20 * day, True, "", at(0), at(0), False), ("retpol_2", "data", 10 * day, False, "app1", at(1), at(1), False), ("retpol_3", "*", 25 * day, True, "", at(2), at(2), False)]
    return spark.createDataFrame(rows, POLICIES)


EXPIRED = """expired AS (SELECT *, CASE WHEN category = 'auth' AND timestamp < TIMESTAMP '2024-01-12' THEN 'retpol_1' WHEN category = 'data' AND app_id = 'app1' AND timestamp < TIMESTAMP '2024-01-22' THEN 'retpol_2' WHEN timestamp < TIMESTAMP '2024-01-07' THEN 'retpol_3' END AS policy_id FROM audit)"""


def _expired(e: DataFrame) -> DataFrame:
    return retention.assigned(e, _policies(e.sparkSession), NOW)


query("retention_older_than", "SELECT id FROM audit WHERE category = 'auth' AND timestamp < TIMESTAMP '2024-01-12'")(lambda e: retention.older_than(e, "auth", datetime(2024, 1, 12)).select("id"))
for _name, _sql, _f in (
    ("retention_expired", "SELECT id, policy_id FROM expired WHERE policy_id IS NOT NULL", lambda e: _expired(e).select("id", "policy_id")),
    ("retention_survivors", "SELECT id FROM expired WHERE policy_id IS NULL", lambda e: retention.survivors(retention.marked(e, _policies(e.sparkSession), NOW)).select("id")),
    ("retention_archive_summary", "SELECT policy_id, CASE policy_id WHEN 'retpol_1' THEN 'auth' ELSE '*' END AS category, count(*) AS event_count, min(timestamp) AS from_timestamp, max(timestamp) AS to_timestamp FROM expired WHERE policy_id IN ('retpol_1', 'retpol_3') GROUP BY 1", lambda e: retention.archive_summary(_expired(e))),
    ("retention_enforce_counts", "SELECT p AS policy_id, CAST(CASE WHEN p = 'retpol_2' THEN 0 ELSE count(policy_id) END AS BIGINT) AS archived, count(policy_id) AS purged FROM (VALUES ('retpol_1'), ('retpol_2'), ('retpol_3')) v(p) LEFT JOIN expired ON policy_id = p GROUP BY p", lambda e: retention.enforce_counts(_expired(e), _policies(e.sparkSession))),
):
    query(_name)(_f)
    ORACLES[_name] = f"WITH audit AS ({AUDIT}), {EXPIRED} {_sql}"



query("policies_latest", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY app_id, category ORDER BY timestamp DESC, id DESC) AS n FROM audit) WHERE n = 1 AND outcome <> 'denied'")(
    lambda e: retention.latest_policies(e.select("id", "app_id", "category", F.col("timestamp").alias("updated_at"), (F.col("outcome") == "denied").alias("deleted"))).select("id")
)


# ingest, alerts, sinks
RULES = "(VALUES ('critical', 'critical', '', '', ''), ('denied-access', '', 'access', '', 'denied'), ('exact', 'warning', 'data', 'delete', 'failure'), ('all', '', '', '', ''))"
ALERTED = f"SELECT rule_id, id FROM audit a JOIN {RULES} r(rule_id, s, c, t, o) ON (s = '' OR s = a.severity) AND (c = '' OR c = a.category) AND (t = '' OR t = a.action) AND (o = '' OR o = a.outcome)"


@query("alert_matches", ALERTED)
def _alerts(e: DataFrame) -> DataFrame:
    rules = e.sparkSession.sql("SELECT * FROM VALUES ('critical', 'critical', '', '', ''), ('denied-access', '', 'access', '', 'denied'), ('exact', 'warning', 'data', 'delete', 'failure'), ('all', '', '', '', '') AS t(rule_id, severity, category, action, outcome)")
    return alerts.alert_matches(e, rules).select("rule_id", "id")


def _broken(e: DataFrame) -> DataFrame:
    return e.withColumns({"action": F.when(F.expr("right(id, 1) = '3'"), "").otherwise(F.col("action")), "category": F.when(F.expr("right(id, 2) = '13'"), None).otherwise(F.col("category"))})


query("validation_quarantine", "SELECT id, array_to_string(CASE WHEN right(id, 2) = '13' THEN ['action is required', 'category is required'] ELSE ['action is required'] END, '; ') AS problems FROM audit WHERE right(id, 1) = '3'")(
    lambda e: validated(_broken(e))[1].select("id", F.array_join("problems", "; ").alias("problems"))
)
query("validation_accepted", "SELECT id FROM audit WHERE right(id, 1) <> '3'")(lambda e: validated(_broken(e))[0].select("id", F.size(problems()).alias("n")).where("n = 0").drop("n"))
query("scope_fill", "SELECT id, CASE WHEN right(id, 1) = '1' THEN 't9' ELSE tenant_id END AS tenant_id, app_id FROM audit")(lambda e: Scope("appX", "t9").fill(e.withColumn("tenant_id", F.when(F.expr("right(id, 1) = '1'"), "").otherwise(F.col("tenant_id")))).select("id", "tenant_id", "app_id"))
query("jsonl_payload", """SELECT id, '{"id":"' || id || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(timestamp, '.%f'), '0'), '.') || 'Z","app_id":"' || app_id || '","tenant_id":"' || tenant_id || '","user_id":"' || user_id || '","ip":"' || ip || '","action":"' || action || '","resource":"' || resource || '","category":"' || category || '","resource_id":"' || resource_id || '","metadata":' || metadata || ',"outcome":"' || outcome || '","severity":"' || severity || '"' || CASE WHEN reason <> '' THEN ',"reason":"' || reason || '"' ELSE '' END || CASE WHEN subject_id <> '' THEN ',"subject_id":"' || subject_id || '"' ELSE '' END || '}' AS line FROM audit""")(
    lambda e: e.select("id", sinks.payload(e).alias("line"))
)
query("archive_partitions", "SELECT category, year(timestamp) AS year, strftime(timestamp, '%m') AS month, strftime(timestamp, '%d') AS day, count(*) AS count FROM audit GROUP BY ALL")(lambda e: e.groupBy(*sinks.partition_columns()).count().withColumn("year", F.col("year").cast("bigint")))

SINK_ROWS = "SELECT category, count(*) AS count, count(DISTINCT id) AS ids FROM audit GROUP BY category"


@query("sink_jsonl_read_back", SINK_ROWS)
def _jsonl(e: DataFrame) -> DataFrame:
    """Written as JSON lines and read again."""
    path = scratch(e.sparkSession, "jsonl")
    sinks.FileSink(path, 2000).write(e)
    return _sunk(e.sparkSession.read.schema("id string, category string").json(path))


@query("sink_partitioned_read_back", SINK_ROWS)
def _partitioned(e: DataFrame) -> DataFrame:
    """Written as gzip JSON lines by category and day, in two flushes, through a fan-out; and read again."""
    path = scratch(e.sparkSession, "gzip")
    for half in (e.where("timestamp < TIMESTAMP_NTZ '2024-01-15'"), e.where("timestamp >= TIMESTAMP_NTZ '2024-01-15'")):
        sinks.MultiSink(sinks.PartitionedSink(path)).write(half)
    return _sunk(e.sparkSession.read.schema("id string, category string").json(path))


LINE_ROWS = "SELECT category, date_trunc('day', timestamp)::DATE AS day, count(*) AS count, count(DISTINCT id) AS ids, min(resource_id) AS least, sum(CASE WHEN metadata = '{}' THEN 0 ELSE CAST(json_extract_string(metadata, '$.k') AS BIGINT) END)::BIGINT AS total FROM audit WHERE category IN ('auth', 'ai') AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-20' GROUP BY ALL"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of two categories and ten days, from the files that hold them, parsed again."""
    found = lines.read_lines(spark, path).where("category IN ('auth', 'ai') AND day >= DATE '2024-01-10' AND day < DATE '2024-01-20'")
    parsed = found.select("category", "day", F.from_json("value", "id string, resource_id string, metadata struct<k: bigint>").alias("e"))
    return parsed.groupBy("category", "day").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("e.id").alias("ids"), F.min("e.resource_id").alias("least"), F.sum(F.coalesce("e.metadata.k", F.lit(0))).alias("total"))


@query("sink_lines_read_back", LINE_ROWS)
def _lines_written(e: DataFrame) -> DataFrame:
    """Written through the data source of lines, one half twice under one name, and read again."""
    sink = lines.LinesSink(scratch(e.sparkSession, "lines"), max_bytes=1 << 20)
    first, second = _halves(e)
    sink.write(first)
    for _ in range(2):
        sink.write_named(second, "second half")
    return _lines(e.sparkSession, sink.path)


def _sunk(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("id").alias("ids"))


def stream_query(name: str, sql: str):
    """A query whose function takes the audit events as a stream."""

    def add(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            raw = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
            return f(spark, audit_view(spark, raw), scratch(spark, name))

        QUERIES[name], ORACLES[name] = run, f"WITH RECURSIVE audit AS ({AUDIT}), {CHAIN} {sql}"

    return add


@stream_query("ingest_stream_chain", CHAINED)
def _stream_chain(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """The chain, batch by batch onto stored heads."""
    store = Store(spark, f"{path}/store")
    append_stream(stream, store, f"{path}/state").awaitTermination()
    return store.events().select(_chained)


@stream_query("ingest_stream_record", "SELECT app_id, tenant_id, true AS valid, count(*) AS verified FROM chain GROUP BY app_id, tenant_id")
def _stream_record(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """Recorded batch by batch into a store, then verified there."""
    store = Store(spark, f"{path}/store")
    Recorder(store).stream(stream, f"{path}/state", None).awaitTermination()
    return chain.verify_chains(store.events()).select("app_id", "tenant_id", "valid", "verified")


@stream_query("stream_lines_read_back", LINE_ROWS)
def _stream_lines(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """A stream written through the data source of lines, and read again."""
    lines.stream_lines(stream, f"{path}/lines", f"{path}/state", "audit").awaitTermination()
    return _lines(spark, f"{path}/lines")


# the store: writers at once, purges and compaction by file, counts beside the events
def store_query(name: str, sql: str, chained: bool = False):
    """A query whose function takes the audit events and an empty store."""
    return lambda f: query(name, sql, chained)(lambda e: f(e, Store(e.sparkSession, scratch(e.sparkSession, name))))


def _halves(e: DataFrame) -> list[DataFrame]:
    return [e.where(f"timestamp {op} TIMESTAMP_NTZ '2024-01-15'") for op in ("<", ">=")]


@store_query("concurrent_append", "SELECT app_id, tenant_id, true AS valid, count(*) AS verified, 1 AS first_event, count(*) AS last_event FROM audit GROUP BY app_id, tenant_id")
def _concurrent(e: DataFrame, store: Store) -> DataFrame:
    """Two writers at once; every event is in its chain once, whoever came first."""
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda half: Store(e.sparkSession, store.path).append(half), _halves(e)))
    return chain.verify_chains(store.events()).select("app_id", "tenant_id", "valid", "verified", F.col("first_event").cast("int"), "last_event")


@store_query("store_append", CHAINED, True)
def _appended(e: DataFrame, store: Store) -> DataFrame:
    """Appended in two batches, compacted, read back."""
    for half in _halves(e):
        store.append(half)
    store.compact()
    return store.events().select(_chained)


@store_query("store_lookup", "SELECT id, timestamp, action FROM audit WHERE subject_id = 'subj-5' AND app_id = 'app1' AND timestamp >= TIMESTAMP '2024-01-15'")
def _looked_up(e: DataFrame, store: Store) -> DataFrame:
    """Events of a subject, from the files whose ranges and filters may hold them."""
    for half in _halves(e):
        store.append(half)
    found = store.events("app1", after=datetime(2024, 1, 15), subject_id="subj-5")
    return found.where("subject_id = 'subj-5' AND app_id = 'app1' AND timestamp >= TIMESTAMP_NTZ '2024-01-15'").select("id", "timestamp", "action")


@store_query("store_heads", f"SELECT app_id, tenant_id, {STREAM} AS stream_id, max(sequence) AS head_seq, max_by(hash, sequence) AS head_hash, min(timestamp) AS created_at, max(timestamp) AS updated_at FROM chain GROUP BY app_id, tenant_id", True)
def _store_heads(e: DataFrame, store: Store) -> DataFrame:
    """Heads as commits tell them, also after a purge of what was first."""
    for half in _halves(e):
        store.append(half)
    store.purge(_halves(e)[0].where("category = 'auth'").select("id", "timestamp"))
    return store.heads()


PURGED = "audit WHERE NOT (category = 'auth' AND timestamp < TIMESTAMP '2024-01-12')"


def _purged(e: DataFrame, store: Store) -> Store:
    for half in _halves(e):
        store.append(half)
    store.purge(e.where("category = 'auth' AND timestamp < TIMESTAMP_NTZ '2024-01-12'").select("id", "timestamp"))
    return store


store_query("store_purge", f"SELECT id FROM {PURGED}")(lambda e, store: _purged(e, store).events().select("id"))
store_query("stats_kept", f"SELECT 'total' AS kind, '' AS value, count(*) AS count FROM {PURGED} UNION ALL SELECT 'category', category, count(*) FROM {PURGED} GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM {PURGED} GROUP BY 2 UNION ALL SELECT 'outcome', outcome, count(*) FROM {PURGED} GROUP BY 2")(lambda e, store: cube.stats(_purged(e, store).cube()))
store_query("counts_kept", f"SELECT date_trunc('day', timestamp)::TIMESTAMP AS day, app_id, tenant_id, category, action, outcome, severity, resource, count(*) AS n FROM {PURGED} GROUP BY ALL")(lambda e, store: _purged(e, store).cube())


@query("tiles_kept", "SELECT count(*) AS total, count(*) FILTER (fresh AND severity = 'critical') AS critical, count(*) FILTER (fresh AND outcome IN ('failure', 'denied')) AS failed FROM (SELECT *, timestamp BETWEEN TIMESTAMP '2024-01-10 07:30:00' AND TIMESTAMP '2024-01-20 07:30:00' AS fresh FROM audit)")
def _tiles(e: DataFrame) -> DataFrame:
    """Whole days from counts, the two cut days from events."""
    return cube.tiles(cube.merged(cube.cube_of(e)), e, datetime(2024, 1, 20, 7, 30), 10)


# scalar functions
query("client_ip_events", "SELECT id, CASE WHEN outcome = 'success' THEN action WHEN severity = 'info' THEN resource ELSE category END AS ip FROM audit")(
    lambda e: e.select("id", client_ip(F.when(F.col("outcome") == "success", F.concat("action", F.lit(", 10.0.0.1"))).otherwise(""), F.when(F.col("severity") == "info", F.col("resource")).otherwise(""), F.concat("category", F.lit(":443"))).alias("ip"))
)
query("time_ago", "SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' WHEN s < 31536000 THEN s // 2592000 || 'mo ago' ELSE s // 31536000 || 'y ago' END AS ago FROM (SELECT id, abs(epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(timestamp)) // 1000000 AS s FROM audit)")(
    lambda e: e.select("id", fx.time_ago(F.col("timestamp"), F.lit(datetime(2024, 1, 15, 12)).cast("timestamp_ntz")).alias("ago"))
)
query("truncated_ids", "SELECT id, left(id, 12) || '...' AS short, CASE WHEN length(reason) > 8 THEN left(reason, 8) || '...' ELSE reason END AS reason FROM audit")(lambda e: e.select("id", fx.truncate(F.col("id"), 12).alias("short"), fx.truncate(F.col("reason"), 8).alias("reason")))
query("rfc3339_nano", "SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(timestamp, '.%f'), '0'), '.') || 'Z' AS t, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS s FROM audit")(lambda e: e.select("id", fx.rfc3339_nano(F.col("timestamp")).alias("t"), fx.rfc3339(F.col("timestamp")).alias("s")))
query("list_split_events", "SELECT id, string_split(action || ',' || reason || ',' || outcome, ',') AS parts FROM audit")(lambda e: e.select("id", fx.split_list(F.concat_ws(",", "action", "reason", "outcome")).alias("parts")))
query("sequence_clamp_events", "SELECT id, CAST(greatest(day(timestamp) - 15, 0) AS BIGINT) AS clamped FROM audit")(lambda e: e.select("id", fx.clamp_sequence((F.day("timestamp") - 15).cast("bigint")).alias("clamped")))
query("exact_seconds", "SELECT id, epoch_us(timestamp) / 1e6 AS seconds FROM audit")(lambda e: e.select("id", fx.seconds(F.col("timestamp")).alias("seconds")))

_CLOCK = datetime(2024, 1, 18, 15, 30)
_RANGES: dict[str, tr.TimeRange] = {"today": tr.today(_CLOCK), "yesterday": tr.yesterday(_CLOCK), "this_week": tr.this_week(_CLOCK), "this_month": tr.this_month(_CLOCK), "last_month": tr.last_month(_CLOCK), "last_year": tr.last_year(_CLOCK), "last_36h": tr.last(timedelta(hours=36), _CLOCK)}


def _in_ranges(e: DataFrame) -> DataFrame:
    """Events in each named range, in one pass."""
    hit: Callable[[tr.TimeRange], Column] = lambda r: q.condition(q.Query(after=r.after, before=r.before))
    one = e.agg(*(F.count_if(hit(r)).alias(k) for k, r in _RANGES.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("range"), F.col(k).alias("count")) for k in _RANGES))).alias("x")).select("x.*")


query("time_ranges", """SELECT v.n AS range, (SELECT count(*) FROM audit WHERE timestamp >= v.a AND timestamp <= v.b) AS count FROM (VALUES
 ('today', TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-18 15:30:00'), ('yesterday', TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-18'), ('this_week', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-18 15:30:00'), ('this_month', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-18 15:30:00'),
 ('last_month', TIMESTAMP '2023-12-01', TIMESTAMP '2024-01-01'), ('last_year', TIMESTAMP '2023-01-01', TIMESTAMP '2024-01-01'), ('last_36h', TIMESTAMP '2024-01-17 03:30:00', TIMESTAMP '2024-01-18 15:30:00')) v(n, a, b)""")(_in_ranges)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest authentication events of a tenant."""
    return q.page_of(audit_events(spark, sf_dir), Scope("", "t1").apply(q.Query(categories=["auth"], limit=20)))
