"""SQL for DuckDB that must give the rows of the registered queries.

Written from the definitions, independently of the operators; only the bound
input views are shared.
"""

from __future__ import annotations

from ..sources.bindings import with_views

_SCHEMAS = "('NATION_3','NATION_11','NATION_1','NATION_7','NATION_20')"
# All 25 schemas in an order of their own: the position in the list.
_ALL = [f"NATION_{7 * i % 25}" for i in range(25)]
_PLACE = "CASE schema_name " + " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(_ALL)) + " END"
_LISTED = "(" + ",".join(f"'{name}'" for name in _ALL) + ")"
_EXCLUDED = "('Supplier#000000001_p3','part_77_idx','Supplier#000000004_p13_ccnew','Part_78_idx')"
_NOW = "TIMESTAMP '2002-01-01 00:00:00'"
_NOW_S = 1009843200

_USER = (
    "nspname NOT IN ('pg_catalog','information_schema','pg_toast','pg_temp_1','pg_toast_temp_1')"
    " AND nspname NOT LIKE 'pg_temp_%' AND nspname NOT LIKE 'pg_toast_temp_%'"
)

# Every index with everything known about it, in user schemas.
_INV = f"""inv AS MATERIALIZED (
  SELECT n.nspname AS schema_name, t.relname AS table_name, i.relname AS index_name, am.amname AS index_type,
    i.relsize AS size_bytes, i.oid AS index_oid, t.oid AS table_oid, x.indisprimary AS pk, x.indisunique AS uq,
    x.indisvalid AND x.indisready AND x.indislive AS healthy, i.relpages AS ip, i.reltuples AS it, t.relpages AS tp,
    t.reltuples AS tt, t.relsize AS ts
  FROM {{cat_index}} x JOIN {{cat_class}} i ON i.oid = x.indexrelid JOIN {{cat_class}} t ON t.oid = x.indrelid
  JOIN {{cat_namespace}} n ON n.oid = t.relnamespace JOIN {{cat_am}} am ON am.oid = i.relam
  WHERE i.relkind = 'i' AND {_USER})"""


def _gb(size: str) -> str:
    hundredths = f"((CAST({size} AS HUGEINT) * 200 + 1073741824) // 2147483648)"
    return (
        f"(CAST({hundredths} // 100 AS VARCHAR) || '.' || lpad(CAST({hundredths} % 100 AS VARCHAR), 2, '0') || ' GB')"
    )


def _pretty(size: str) -> str:
    def unit(shift: int, name: str) -> str:
        return f"CAST((({size}) // {1 << shift} + 1) // 2 AS VARCHAR) || ' {name}'"

    return (
        f"CASE WHEN {size} < 10240 THEN CAST({size} AS VARCHAR) || ' bytes'"
        f" WHEN ({size}) // {1 << 9} < 20479 THEN {unit(9, 'kB')} WHEN ({size}) // {1 << 19} < 20479 THEN {unit(19, 'MB')}"
        f" WHEN ({size}) // {1 << 29} < 20479 THEN {unit(29, 'GB')} WHEN ({size}) // {1 << 39} < 20479 THEN {unit(39, 'TB')}"
        f" ELSE {unit(49, 'PB')} END"
    )


_GB = 1 << 30
_KIND = {
    "btree": "NOT pk AND NOT uq AND index_type = 'btree'",
    "constraint": "(pk OR uq)",
    "all": "NOT pk AND NOT uq",
}
_BASE = f"schema_name, table_name, index_name, {_gb('size_bytes')} AS index_size, index_type, size_bytes"


def _band(low: int, high: int | None = None, column: str = "size_bytes") -> str:
    return f"{column} >= {low * _GB}" + (f" AND {column} < {high * _GB}" if high is not None else "")


def _inv(kind: str, extra: str = "true", low: int = 0, high: int | None = None) -> str:
    return f"WITH {_INV} SELECT {_BASE} FROM inv WHERE {_KIND[kind]} AND {_band(low, high)} AND {extra}"


_PARTS = f"""parts AS MATERIALIZED (
  SELECT pn.nspname AS parent_schema, p.relname AS parent_table_name, cn.nspname AS partition_schema,
    c.relname AS partition_name, c.oid AS partition_oid
  FROM {{cat_inherits}} h JOIN {{cat_class}} p ON p.oid = h.inhparent JOIN {{cat_namespace}} pn ON pn.oid = p.relnamespace
  JOIN {{cat_class}} c ON c.oid = h.inhrelid JOIN {{cat_namespace}} cn ON cn.oid = c.relnamespace
  WHERE p.relkind = 'p')"""
_PIDX = f"""pidx AS MATERIALIZED (
  SELECT q.partition_schema AS schema_name, q.partition_name AS table_name, i.relname AS index_name,
    am.amname AS index_type, i.relsize AS size_bytes, q.parent_table_name, q.parent_schema, i.oid AS index_oid
  FROM parts q JOIN {{cat_index}} x ON x.indrelid = q.partition_oid JOIN {{cat_class}} i ON i.oid = x.indexrelid
  JOIN {{cat_am}} am ON am.oid = i.relam WHERE i.relkind = 'i' AND NOT x.indisprimary AND NOT x.indisunique)"""

_UNION = f"""WITH {_INV}, {_PARTS}, {_PIDX}, u AS (
  SELECT 0 AS pass, {_BASE}, CAST(NULL AS VARCHAR) AS parent_table_name FROM inv WHERE {{kind}} AND {_band(0)}
  UNION ALL SELECT 1, {_BASE}, parent_table_name FROM pidx WHERE {_band(0)})"""


def _union(kind: str) -> str:
    return _UNION.replace("{kind}", _KIND[kind])


# --- ranked plan -----------------------------------------------------------------------------------------------------

_PLAN = f"""p AS (
  SELECT schema_name, table_name, index_name, index_type, size_bytes, {_pretty('size_bytes')} AS size_pretty,
    CASE WHEN s.idx_scan IS NULL THEN 0 ELSE s.idx_scan END AS scan_count,
    strftime(s.last_idx_scan, '%Y-%m-%dT%H:%M:%SZ') AS last_scan,
    CASE WHEN tp > 0 AND tt > 0 THEN greatest(0.0::DOUBLE, ip::DOUBLE / tp::DOUBLE * 100.0::DOUBLE - it::DOUBLE / tt::DOUBLE * 100.0::DOUBLE)
      ELSE 0.0::DOUBLE END AS estimated_bloat_percent,
    CAST(round(epoch_us(s.last_idx_scan) / 1000000.0) AS BIGINT) AS scan_s
  FROM inv LEFT JOIN {{cat_stat_index}} s ON s.indexrelid = inv.index_oid),
m AS (SELECT *, estimated_bloat_percent AS m_bloat, size_bytes::DOUBLE AS m_size, 0.0::DOUBLE - scan_count::DOUBLE AS m_scan,
    CASE WHEN scan_s IS NULL THEN 1.7976931348623157e308::DOUBLE ELSE ({_NOW_S} - scan_s)::DOUBLE END AS m_age FROM p),
b AS (SELECT min(m_bloat) AS lo_bloat, max(m_bloat) AS hi_bloat, min(m_size) AS lo_size, max(m_size) AS hi_size,
    min(m_scan) AS lo_scan, max(m_scan) AS hi_scan, min(m_age) AS lo_age, max(m_age) AS hi_age,
    min(CASE WHEN scan_s IS NOT NULL THEN m_age END) AS lo_seen, max(CASE WHEN scan_s IS NOT NULL THEN m_age END) AS hi_seen
  FROM m)"""
_PLAN_OUT = (
    "schema_name, table_name, index_name, index_type, size_bytes, size_pretty, scan_count, last_scan,"
    " estimated_bloat_percent, score"
)


def _scaled(name: str) -> str:
    return (
        f"CASE WHEN hi_{name} = lo_{name} THEN 0.0::DOUBLE ELSE (m_{name} - lo_{name}) / (hi_{name} - lo_{name}) END"
    )


def _plan(score: str, columns: str = _PLAN_OUT) -> str:
    return f"""WITH {_INV}, {_PLAN}, s AS (SELECT *, {score} AS score FROM m CROSS JOIN b)
SELECT row_number() OVER (ORDER BY score DESC, schema_name, index_name) AS rank, {columns} FROM s"""


_SEEN_AGE = (
    "CASE WHEN scan_s IS NULL THEN 1.0::DOUBLE WHEN hi_seen = lo_seen THEN 0.0::DOUBLE"
    " ELSE (m_age - lo_seen) / (hi_seen - lo_seen) END"
)

_REPEATED = f"""WITH {_INV}, {_PLAN},
l AS (SELECT m.*, x.o FROM m JOIN (VALUES ('NATION_3', 1), ('NATION_1', 2), ('NATION_3', 3)) AS x(nm, o) ON x.nm = m.schema_name),
b2 AS (SELECT min(m_bloat) AS lo_bloat, max(m_bloat) AS hi_bloat, min(m_size) AS lo_size, max(m_size) AS hi_size FROM l),
s AS (SELECT *, {_scaled('size')} + {_scaled('bloat')} + {_scaled('size')} AS score FROM l CROSS JOIN b2)
SELECT row_number() OVER (ORDER BY score DESC, o, schema_name, index_name) AS rank, {_PLAN_OUT} FROM s"""

_OLD_SERVER = f"""WITH {_INV}, {_PLAN},
l AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS last_scan),
    {_PLACE} AS o
  FROM m WHERE schema_name IN {_LISTED}),
b2 AS (SELECT min(m_scan) AS lo_scan, max(m_scan) AS hi_scan FROM l),
s AS (SELECT *, 0.0::DOUBLE + {_scaled('scan')} AS score FROM l CROSS JOIN b2)
SELECT row_number() OVER (ORDER BY score DESC, o, schema_name, index_name) AS rank, {_PLAN_OUT} FROM s"""

_FLEET = f"""WITH {_INV}, {_PLAN}, f AS (SELECT *, length(schema_name) AS instance_id FROM m),
b2 AS (SELECT instance_id, min(m_scan) AS lo_scan, max(m_scan) AS hi_scan, min(m_size) AS lo_size, max(m_size) AS hi_size
  FROM f GROUP BY instance_id),
s AS (SELECT f.*, {_scaled('size')} + {_scaled('scan')} AS score FROM f JOIN b2 ON b2.instance_id = f.instance_id)
SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, schema_name, index_name) AS rank,
  {_PLAN_OUT} FROM s"""

_DRIFT_CORE = "((CAST(ip AS HUGEINT) * ts - CAST(size_bytes AS HUGEINT) * tp) * 100)"
_DRIFT = f"""CASE WHEN tp > 0 AND ip > 0 AND ts > 0 THEN
  (sign({_DRIFT_CORE}) * ((abs({_DRIFT_CORE}) * 200 + CAST(tp AS HUGEINT) * ts) // (2 * CAST(tp AS HUGEINT) * ts)))::DOUBLE / 100
  ELSE 0.0::DOUBLE END"""

#: Bloat with two decimals: the digits of the number as text, half up.
_BLOAT_2 = "round(CAST(CAST(m_bloat AS VARCHAR) AS DECIMAL(38,18)), 2)"
_PLAN_FILE = "schema_name, table_name, index_name, index_type, size_bytes, size_pretty, scan_count, last_scan"

# --- state -----------------------------------------------------------------------------------------------------------

_STATE = "schema_name, table_name, index_name, index_type, state, session_id, created_at, updated_at"


def _merge(new: str) -> str:
    done = "o.state IN ('completed','skipped')"
    return f""", r AS (SELECT * REPLACE (CASE WHEN state = 'in_progress' THEN 'pending' ELSE state END AS state,
    CASE WHEN state = 'in_progress' THEN NULL ELSE session_id END AS session_id) FROM {{state_prev}}),
n AS ({new})
SELECT o.schema_name, coalesce(n.table_name, o.table_name) AS table_name, o.index_name,
  coalesce(n.index_type, o.index_type) AS index_type,
  CASE WHEN n.index_name IS NULL OR {done} THEN o.state ELSE 'pending' END AS state,
  CASE WHEN n.index_name IS NULL OR {done} THEN o.session_id ELSE 'session-1' END AS session_id, o.created_at,
  CASE WHEN n.index_name IS NULL THEN o.updated_at ELSE {_NOW} END AS updated_at
FROM r o LEFT JOIN n ON n.schema_name = o.schema_name AND n.index_name = o.index_name
UNION ALL
SELECT n.schema_name, n.table_name, n.index_name, n.index_type, 'pending', 'session-1', {_NOW}, {_NOW}
FROM n LEFT JOIN r o ON n.schema_name = o.schema_name AND n.index_name = o.index_name WHERE o.index_name IS NULL"""


_ALL_LIST = f"SELECT schema_name, table_name, index_name, index_type FROM inv WHERE {_KIND['all']} AND {_band(0)}"
_LATEST = (
    "l AS (SELECT schema_name, index_name, state, session_id FROM {state_updates}"
    " QUALIFY row_number() OVER (PARTITION BY schema_name, index_name ORDER BY seq DESC) = 1)"
)
_APPLY = f"""SELECT o.schema_name, o.table_name, o.index_name, o.index_type, coalesce(l.state, o.state) AS state,
  {{session}} AS session_id, o.created_at, CASE WHEN l.state IS NULL THEN o.updated_at ELSE {_NOW} END AS updated_at
FROM {{state_prev}} o LEFT JOIN l ON l.schema_name = o.schema_name AND l.index_name = o.index_name"""


def _reset(hit: str) -> str:
    return f"""SELECT * REPLACE (CASE WHEN {hit} THEN 'pending' ELSE state END AS state,
  CASE WHEN {hit} THEN {_NOW} ELSE updated_at END AS updated_at) FROM {{state_prev}}"""


# --- outcomes --------------------------------------------------------------------------------------------------------

_RETRYABLE = "(lower(error) LIKE '%lock timeout%' OR lower(error) LIKE '%deadlock detected%' OR lower(error) LIKE '%connection reset%')"
_FOLD = f"""fa AS (SELECT *, error IS NULL OR NOT {_RETRYABLE} OR attempt >= 3 AS final FROM {{attempts}}),
ff AS (SELECT index_oid, min(CASE WHEN final THEN attempt END) AS number, max(attempt) AS seen FROM fa GROUP BY index_oid),
fold AS (SELECT ff.index_oid,
    CASE WHEN number IS NULL THEN 'incomplete' WHEN e.error IS NULL THEN 'ok' ELSE 'failed' END AS outcome,
    CAST(coalesce(number, seen) + 1 AS INT) AS attempts_used, e.error,
    epoch_us(e.started_at) / 1000000.0::DOUBLE + e.duration_s - epoch_us(f.started_at) / 1000000.0::DOUBLE AS duration_secs
  FROM ff LEFT JOIN fa e ON e.index_oid = ff.index_oid AND e.attempt = ff.number
  JOIN fa f ON f.index_oid = ff.index_oid AND f.attempt = 0)"""

_VAC = "state = 'active' AND lower(query) LIKE 'vacuum%'"
_GATES = f"""g AS (SELECT i.instance_id,
    i.instance_id IN (SELECT instance_id FROM {{activity}} WHERE {_VAC}) AS active_vacuum,
    i.instance_id IN (SELECT instance_id FROM {{slots}} WHERE NOT active) AS inactive_replication_slots,
    i.instance_id IN (SELECT instance_id FROM {{repl_samples}} WHERE sync_state = 'sync') AS sync_replication_connection
  FROM (SELECT instance_id FROM {{activity}} UNION SELECT instance_id FROM {{slots}} UNION SELECT instance_id FROM {{repl_samples}}) i)"""
_WAIVED = (
    "CASE WHEN active_vacuum AND inactive_replication_slots THEN 'active vacuum, inactive replication slots'"
    " WHEN active_vacuum THEN 'active vacuum' WHEN inactive_replication_slots THEN 'inactive replication slots' END"
)

_CHANGE = "CASE WHEN before_size > 0 THEN (before_size - after_size)::DOUBLE / before_size::DOUBLE * 100.0::DOUBLE ELSE 0.0::DOUBLE END"
_OUT = f"""{_INV}, {_PARTS}, {_PIDX}, {_FOLD}, {_GATES},
j AS (SELECT w.index_oid, w.schema_name, w.table_name, w.index_name, w.before_size, v.healthy,
    {_DRIFT} AS drift, gg.reason, f.outcome, f.duration_secs, a.after_size, a.healthy_after
  FROM (SELECT index_oid, schema_name, table_name, index_name, size_bytes AS before_size FROM pidx) w JOIN inv v ON v.index_oid = w.index_oid LEFT JOIN fold f ON f.index_oid = w.index_oid
  LEFT JOIN {{after_snapshot}} a ON a.oid = w.index_oid
  LEFT JOIN (SELECT instance_id, {_WAIVED} AS reason FROM g) gg ON gg.instance_id = w.index_oid % 20),
k AS (SELECT *, CASE WHEN NOT healthy THEN 'invalid_index' WHEN drift < 4 THEN 'below_bloat_threshold'
    WHEN reason IS NOT NULL THEN 'skipped' WHEN outcome IS NULL OR outcome = 'incomplete' THEN 'open'
    WHEN outcome = 'failed' THEN 'failed' WHEN after_size IS NULL THEN 'unread'
    WHEN healthy_after THEN 'success' ELSE 'validation_failed' END AS st FROM j),
outc AS (SELECT index_oid, schema_name, table_name, index_name,
    CASE WHEN st NOT IN ('open','unread') THEN st END AS reindex_status,
    CASE st WHEN 'open' THEN NULL WHEN 'success' THEN 'completed' WHEN 'failed' THEN 'failed' WHEN 'unread' THEN 'failed'
      WHEN 'validation_failed' THEN 'failed' ELSE 'skipped' END AS state,
    CASE WHEN st IN ('failed','validation_failed','success') THEN before_size END AS before_size,
    CASE WHEN st IN ('validation_failed','success') THEN after_size END AS after_size,
    CASE st WHEN 'success' THEN ({_CHANGE})::FLOAT::DOUBLE WHEN 'validation_failed' THEN (round(({_CHANGE}) * 10) / 10)::FLOAT::DOUBLE END AS size_change,
    CASE WHEN st IN ('failed','validation_failed','success') THEN (round(duration_secs * 10) / 10)::FLOAT::DOUBLE END AS reindex_duration
  FROM k)"""
_LOG = f"""{_OUT}, lg AS (SELECT schema_name, index_name, 'all' AS index_type,
    {_NOW} - to_days(CAST(index_oid % 30 AS INT)) AS reindex_time, reindex_status, before_size, after_size, size_change, reindex_duration
  FROM outc WHERE reindex_status IS NOT NULL)"""

# --- lag -------------------------------------------------------------------------------------------------------------


def _lsn(column: str) -> str:
    return (
        f"(('0x' || split_part({column}, '/', 1))::BIGINT * 4294967296 + ('0x' || split_part({column}, '/', 2))::BIGINT)"
    )


_LAG = f"""lag AS (SELECT instance_id, ts, CAST(coalesce(max({_lsn('sent_lsn')} - {_lsn('replay_lsn')}), 0) AS BIGINT) AS max_lag_bytes
  FROM {{repl_samples}} GROUP BY instance_id, ts)"""


# The largest lag per ten minutes, at their last microsecond.
_POLLED = f"""lag AS (SELECT instance_id, time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '599999999 microseconds' AS ts,
  CAST(coalesce(max({_lsn('sent_lsn')} - {_lsn('replay_lsn')}), 0) AS BIGINT) AS max_lag_bytes
  FROM {{repl_samples}} GROUP BY instance_id, time_bucket(INTERVAL '10 minutes', ts))"""


def _pauses(limit: int, wait: int, where: str = "true", lag: str = _LAG) -> str:
    return f"""WITH {lag},
o AS (SELECT *, max_lag_bytes > {limit} AS over,
    sum(CASE WHEN max_lag_bytes > {limit} THEN 0 ELSE 1 END) OVER (PARTITION BY instance_id ORDER BY ts) AS island FROM lag),
w AS (SELECT *, CASE WHEN over THEN (epoch_us(ts) - epoch_us(min(CASE WHEN over THEN ts END) OVER (PARTITION BY instance_id, island))) // 1000000 END AS waited FROM o),
z AS (SELECT *, min(CASE WHEN waited >= {wait} THEN ts END) OVER (PARTITION BY instance_id) AS stop_ts FROM w),
a AS (SELECT *, CASE WHEN ts > stop_ts THEN 'stopped' WHEN ts = stop_ts THEN 'stop' WHEN over THEN 'pause' ELSE 'proceed' END AS action FROM z)
SELECT instance_id, ts, max_lag_bytes, action, CASE WHEN action IN ('pause','stop') THEN waited END AS waited_s,
  action = 'pause' AND waited % 60 = 0 AS warn FROM a WHERE {where}"""


_POLLS = f"""SELECT instance_id, time_bucket(INTERVAL '5 seconds', ts) AS poll_start,
  CAST(coalesce(max({_lsn('sent_lsn')} - {_lsn('replay_lsn')}), 0) AS BIGINT) AS max_lag_bytes
FROM {{repl_samples}} {{where}} GROUP BY instance_id, time_bucket(INTERVAL '5 seconds', ts)"""
# One minute of delay behind the latest sample, in whole milliseconds.
_WATERMARK = "(SELECT epoch_ms(max(ts)) - 60000 FROM {repl_samples})"

# --- logs ------------------------------------------------------------------------------------------------------------

_LOG_TIME = "date_trunc('milliseconds', timestamp)"


def _settings(threads: int, pmw: int) -> str:
    effective = pmw or 2
    return f"""WITH v AS (SELECT instance_id, max(CASE WHEN name = 'max_parallel_workers' THEN CAST(setting AS BIGINT) END) AS max_parallel_workers,
  max(CASE WHEN name = 'temp_file_limit' THEN CAST(setting AS BIGINT) END) AS temp_file_limit,
  max(CASE WHEN name = 'maintenance_io_concurrency' THEN CAST(setting AS BIGINT) END) AS maintenance_io_concurrency
  FROM {{settings}} GROUP BY instance_id)
SELECT *, {threads * effective} <= max_parallel_workers AS total_workers_ok,
  {pmw} < max_parallel_workers AND {pmw} < max_parallel_workers // 2 AS maintenance_workers_ok,
  maintenance_io_concurrency <= 512 AS io_concurrency_ok, temp_file_limit = -1 AS temp_file_unlimited FROM v"""


_TEMP = r"regexp_matches(substr(index_name, instr(index_name, '_ccnew')), '^_ccnew[0-9]*$')"
_IS_TEMP = f"(instr(index_name, '_ccnew') > 0 AND {_TEMP})"

_WAVES = f"""WITH {_INV} SELECT schema_name, table_name, index_name,
  row_number() OVER (PARTITION BY schema_name, table_name ORDER BY size_bytes, index_name) AS wave,
  CAST(('0x' || substr(md5(schema_name || '.' || table_name), 1, 8))::BIGINT % 8 AS INT) AS lane
FROM inv WHERE {_KIND['all']} AND {_band(0)}"""


def _ordered(direction: str) -> str:
    return f"""WITH {_INV} SELECT row_number() OVER (ORDER BY size_bytes {direction}, {_PLACE}, index_name) AS position,
  schema_name, index_name, size_bytes FROM inv WHERE {_KIND['all']} AND schema_name IN {_LISTED} AND {_band(0)}"""


def _exists(probe: str) -> str:
    return f"""SELECT w.nm AS schema_name, w.o AS schema_ord, '{probe}' AS probe,
  EXISTS (SELECT 1 FROM {{cat_namespace}} n WHERE n.nspname = w.nm) AS schema_exists,
  EXISTS (SELECT 1 FROM {{cat_class}} c JOIN {{cat_namespace}} n ON n.oid = c.relnamespace
    WHERE n.nspname = w.nm AND c.relname = '{probe}' AND c.relkind = 'r') AS table_exists,
  EXISTS (SELECT 1 FROM {{cat_inherits}} h JOIN {{cat_class}} c ON c.oid = h.inhparent JOIN {{cat_namespace}} n ON n.oid = c.relnamespace
    WHERE n.nspname = w.nm AND c.relname = '{probe}' AND c.relkind = 'p') AS is_partitioned
FROM (VALUES ('NATION_3',1),('NATION_11',2),('NATION_1',3),('NATION_7',4),('NATION_20',5),('NATION_2',6),('NATION_16',7),
  ('nation_3',8),('NO_SUCH',9)) AS w(nm, o)"""


_WORK_KEYS = "schema_name, table_name, index_name, index_type"

_PREPARED_LIST = f"""{_INV}, {_PARTS}, {_PIDX}, u AS (
  SELECT 0 AS pass, {_WORK_KEYS}, size_bytes, CAST(NULL AS VARCHAR) AS parent_table_name FROM inv
    WHERE {_KIND['all']} AND {_band(1, 8)} AND schema_name IN {_SCHEMAS}
  UNION ALL SELECT 1, {_WORK_KEYS}, size_bytes, parent_table_name FROM pidx
    WHERE {_band(1, 8)} AND parent_schema IN {_SCHEMAS}),
work AS (SELECT * FROM u WHERE index_name NOT IN {_EXCLUDED} AND NOT {_IS_TEMP}
  QUALIFY row_number() OVER (PARTITION BY schema_name, index_name ORDER BY pass DESC) = 1)"""

_ORACLES = {
    "inv_btree": _inv("btree"),
    "inv_constraint": _inv("constraint"),
    "inv_all": _inv("all"),
    "inv_size_band": _inv("all", f"schema_name IN {_SCHEMAS}", 1, 5),
    "inv_huge": f"""WITH {_INV}, h AS (SELECT * REPLACE (size_bytes * 1000 AS size_bytes) FROM inv)
SELECT {_BASE} FROM h WHERE {_KIND['all']}""",
    "commands_fleet": f"""WITH {_INV}, l AS (SELECT *, substr(schema_name, 1, 8) AS database_name, {_PLACE} AS o
  FROM inv WHERE {_KIND['btree']} AND schema_name IN {_LISTED}),
n AS (SELECT *, row_number() OVER (PARTITION BY database_name ORDER BY o, index_name) AS position, count(*) OVER (PARTITION BY database_name) AS total FROM l)
SELECT database_name, position, total, '[' || position || '/' || total || '] REINDEX INDEX CONCURRENTLY "' || schema_name || '"."' || index_name || '"' AS command FROM n""",
    "state_merge_fleet": f"""WITH {_INV} SELECT substr(schema_name, 1, 8) AS database_name, schema_name, index_name, 'pending' AS state,
  'session-1' AS session_id FROM inv WHERE {_KIND['all']}""",
    "resume_fleet": f"""WITH {_INV}, o AS MATERIALIZED (SELECT substr(schema_name, 1, 8) AS database_name, schema_name, index_name,
  CASE WHEN substr(schema_name, 1, 8) IN ('NATION_1', 'NATION_3') THEN 'completed' ELSE state END AS state FROM {{state_prev}}),
busy AS MATERIALIZED (SELECT DISTINCT database_name FROM o WHERE state IN ('pending', 'failed', 'in_progress'))
SELECT database_name, schema_name, index_name FROM o WHERE database_name IN (FROM busy) AND state NOT IN ('completed', 'skipped')
UNION ALL SELECT substr(schema_name, 1, 8), schema_name, index_name FROM inv WHERE {_KIND['all']} AND substr(schema_name, 1, 8) NOT IN (FROM busy)
  AND NOT EXISTS (SELECT 1 FROM o WHERE o.schema_name = inv.schema_name AND o.index_name = inv.index_name AND o.state IN ('completed', 'skipped'))""",
    "inv_one_table": _inv("btree", "table_name = 'Supplier#000000007'"),
    "user_schemas": f"SELECT nspname AS schema_name FROM {{cat_namespace}} WHERE {_USER}",
    "exists_verdicts": " UNION ALL ".join(_exists(p) for p in ("Supplier#000000007", "Customer#000000010", "part_5")),
    "schema_dedupe": "SELECT schema_name, min(schema_ord) AS schema_ord FROM {requested_schemas} GROUP BY schema_name",
    "schema_duplicates": "SELECT count(*) - count(DISTINCT schema_name) AS duplicate_count, count(DISTINCT schema_name) AS distinct_count FROM {requested_schemas}",
    "partitions": f"WITH {_PARTS} SELECT parent_schema, parent_table_name, partition_schema, partition_name FROM parts WHERE {_USER.replace('nspname', 'parent_schema')}",
    "partitioned_tables": f"""SELECT n.nspname AS schema_name, c.relname AS table_name,
  (SELECT count(*) FROM {{cat_inherits}} h WHERE h.inhparent = c.oid) AS partition_count
FROM {{cat_class}} c JOIN {{cat_namespace}} n ON n.oid = c.relnamespace WHERE c.relkind = 'p' AND {_USER}""",
    "partition_indexes": f"WITH {_PARTS}, {_PIDX} SELECT {_BASE}, parent_table_name FROM pidx WHERE parent_schema IN {_SCHEMAS} AND {_band(1, 4)}",
    "inv_with_partitions": f"{_union('btree')} SELECT * FROM u",
    "inv_with_partitions_dedup": f"""{_union('btree')} SELECT * EXCLUDE (pass) FROM u
QUALIFY row_number() OVER (PARTITION BY schema_name, index_name ORDER BY pass DESC) = 1""",
    "inv_one_partitioned_table": f"""WITH {_PARTS}, {_PIDX} SELECT 1 AS pass, {_BASE}, parent_table_name FROM pidx
WHERE parent_table_name = 'Customer#000000010' AND {_band(0)}""",
    "order_size_desc": _ordered("DESC"),
    "order_size_asc": _ordered("ASC"),
    "index_size": f"""WITH {_INV}, k AS (SELECT DISTINCT schema_name, index_name FROM {{state_updates}}),
kk AS (SELECT * FROM k UNION ALL SELECT schema_name, index_name || '_gone' FROM k)
SELECT kk.schema_name, kk.index_name, i.size_bytes AS current_size, i.size_bytes IS NULL AS missing
FROM kk LEFT JOIN inv i ON i.schema_name = kk.schema_name AND i.index_name = kk.index_name""",
    "integrity": f"""WITH {_INV} SELECT schema_name, index_name, healthy FROM inv WHERE {_KIND['all']} AND {_band(0)}
UNION ALL SELECT schema_name, index_name || '_gone', false FROM inv WHERE {_KIND['all']} AND {_band(0)}""",
    "temp_rebuild_candidates": f"WITH {_INV} SELECT schema_name, table_name, index_name, healthy FROM inv WHERE {_KIND['all']} AND {_band(0)} AND {_IS_TEMP}",
    "drop_excluded": f"WITH {_INV} SELECT schema_name, index_name FROM inv WHERE {_KIND['all']} AND {_band(0)} AND index_name NOT IN {_EXCLUDED} AND NOT {_IS_TEMP}",
    "excluded_split": f"""WITH {_INV}, l AS (SELECT * FROM inv WHERE {_KIND['all']} AND {_band(0)})
SELECT 'logbook' AS part, schema_name, index_name, 'all' AS index_type, 'excluded' AS status, CAST(NULL AS BIGINT) AS before_size FROM l WHERE index_name IN {_EXCLUDED}
UNION ALL SELECT 'state', schema_name, index_name, NULL, 'skipped', NULL FROM l WHERE index_name IN {_EXCLUDED}
UNION ALL SELECT 'worklist', schema_name, index_name, index_type, NULL, NULL FROM l WHERE index_name NOT IN {_EXCLUDED} AND NOT {_IS_TEMP}""",
    "plan_bloat": _plan("m_bloat"),
    "plan_size": _plan("m_size"),
    "plan_scan_frequency": _plan("m_scan"),
    "plan_age": _plan("m_age"),
    "plan_bloat_size": _plan(f"{_scaled('bloat')} + {_scaled('size')}"),
    "plan_all_code": _plan(f"{_scaled('bloat')} + {_scaled('size')} + {_scaled('scan')} + {_scaled('age')}"),
    "plan_all_documented": _plan(f"{_scaled('bloat')} + {_scaled('size')} + {_scaled('scan')} + {_SEEN_AGE}"),
    "plan_repeated": _REPEATED,
    "plan_old_server": _OLD_SERVER,
    "plan_fleet": _FLEET,
    "criterion_bounds": f"""WITH {_INV}, {_PLAN} SELECT lo_bloat, hi_bloat, lo_size, hi_size, lo_scan AS lo_scan_frequency,
  hi_scan AS hi_scan_frequency, lo_seen AS lo_age, hi_seen AS hi_age FROM b""",
    "page_drift_bloat": f"WITH {_INV} SELECT schema_name, table_name, index_name, {_DRIFT} AS bloat_percentage FROM inv",
    "plan_json_file": _plan("m_size", _PLAN_FILE + ", CAST(floor(estimated_bloat_percent * 100 + 0.5) AS BIGINT) AS bloat_hundredths"),
    "plan_csv_file": _plan("m_size", f"{_PLAN_FILE}, CAST({_BLOAT_2} * 100 AS BIGINT) AS bloat_hundredths"),
    "plan_csv_text": f"""WITH q AS ({_plan("m_size", f"{_PLAN_FILE}, CAST({_BLOAT_2} AS DECIMAL(20,2)) AS bloat")})
SELECT rank, concat_ws(',', rank, schema_name, table_name, index_name, index_type, size_bytes, size_pretty, scan_count, coalesce(last_scan, ''), bloat) AS line FROM q""",
    "size_text": f"""SELECT oid, {_gb('relsize')} AS size_gb, {_pretty('relsize')} AS pretty, {_pretty('(relsize // 1048576)')} AS pretty_small,
  {_pretty('(relsize * 4096)')} AS pretty_large FROM {{cat_class}}""",
    "last_scan_iso": """SELECT indexrelid, strftime(last_idx_scan, '%Y-%m-%dT%H:%M:%SZ') AS iso,
  CAST(round(epoch_us(last_idx_scan) / 1000000.0) AS BIGINT) AS epoch, strftime(last_idx_scan, '%Y-%m-%d %H:%M:%S.%g') AS log_time
FROM {cat_stat_index}""",
    "event_times": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
  (epoch_us(ts) + 500000) // 1000000 AS epoch, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS log_time FROM {events}""",
    "name_rules": "SELECT p_partkey, p_partkey % 6 IN (1, 2) AS is_temp FROM {part}",
    "list_split": "SELECT p_partkey, trim(p_name) || '|' || trim(p_brand) AS parts FROM {part}",
    "csv_quoted": """SELECT message, '"' || replace(message, '"', '""') || '"' AS quoted, index_name AS plain FROM {log_events}""",
    "commands": """SELECT oid, CASE relkind WHEN 'i' THEN 'REINDEX INDEX CONCURRENTLY ' ELSE 'ANALYZE (SKIP_LOCKED) ' END
  || '"' || relnamespace || '"."' || relname || '"' AS command,
  CASE relkind WHEN 'i' THEN 'REINDEX INDEX ' ELSE 'ANALYZE ' END || '"' || relnamespace || '"."' || relname || '"' AS plain_command
FROM {cat_class}""",
    "lsn_decode": """SELECT CAST(user_id % 20 AS BIGINT) AS instance_id, ts, event_id*16777216 + CAST(ROUND(value*100) AS BIGINT)*1024 AS sent,
  CASE WHEN event_type <> 'error' THEN event_id*16777216 END AS replay FROM {events}""",
    "size_changes": """WITH c AS MATERIALIZED (SELECT oid, CASE WHEN relsize > 0 THEN (relsize - after_size)::DOUBLE / relsize::DOUBLE * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS change
  FROM {cat_class} JOIN {after_snapshot} USING (oid))
SELECT oid, CAST(floor(change * 1e6) AS BIGINT) AS change, CAST(floor(change::FLOAT::DOUBLE * 1e6) AS BIGINT) AS change_real,
  CAST(floor((round(change * 10) / 10)::FLOAT::DOUBLE * 1e6) AS BIGINT) AS change_rounded FROM c""",
    "error_classes": """SELECT index_oid, attempt, error <> 'permission denied' AS retryable, error = 'Connection reset by peer' AS connection,
  CASE error WHEN 'Connection reset by peer' THEN 'connection error' WHEN 'ERROR: deadlock detected' THEN 'deadlock'
    WHEN 'canceling statement due to lock timeout' THEN 'lock timeout' END AS kind FROM {attempts} WHERE error IS NOT NULL""",
    "waves": _WAVES,
    "waves_hot_tables": _WAVES,
    "worklist_commands": f"""WITH {_INV}, l AS (SELECT *, {_PLACE} AS o
  FROM inv WHERE {_KIND['btree']} AND schema_name IN {_LISTED} AND {_band(0)}),
n AS (SELECT *, row_number() OVER (ORDER BY o, index_name) AS position, count(*) OVER () AS total FROM l)
SELECT position, total, '[' || position || '/' || total || '] REINDEX INDEX CONCURRENTLY "' || schema_name || '"."' || index_name || '"' AS command FROM n""",
    "preflight": f"""WITH {_GATES} SELECT *,
  CASE WHEN active_vacuum OR inactive_replication_slots OR sync_replication_connection THEN
    concat_ws(', ', CASE WHEN active_vacuum THEN 'active vacuum' END, CASE WHEN inactive_replication_slots THEN 'inactive replication slots' END,
      CASE WHEN sync_replication_connection THEN 'sync replication connection' END) END AS strict_reason, {_WAIVED} AS skip_reason FROM g""",
    "active_vacuum": f"SELECT instance_id, count(CASE WHEN {_VAC} AND pid <> 388 THEN 1 END) > 0 AS active_vacuum FROM {{activity}} GROUP BY instance_id",
    "inactive_slots": "SELECT instance_id, count(CASE WHEN NOT active THEN 1 END) > 0 AS inactive_replication_slots FROM {slots} GROUP BY instance_id",
    "sync_standby": "SELECT instance_id, count(CASE WHEN sync_state = 'sync' THEN 1 END) > 0 AS sync_replication_connection FROM {repl_samples} GROUP BY instance_id",
    "bloat_gate": f"WITH {_INV} SELECT schema_name, index_name, {_DRIFT} < 4 AS below FROM inv",
    "settings_audit": _settings(4, 2),
    "settings_audit_default_workers": _settings(3, 0),
    "replica_lag": f"WITH {_LAG} SELECT * FROM lag",
    "lag_throttle": _pauses(10_000_000, 21_600),
    "lag_throttle_default_wait": _pauses(30_000_000, 1_800),
    "lag_series": _POLLS.replace("{where}", ""),
    "state_merge": f"WITH {_INV}{_merge(_ALL_LIST)}",
    "state_merge_repeats": f"WITH {_INV}{_merge(_ALL_LIST)}",
    "state_apply": f"WITH {_LATEST} {_APPLY.replace('{session}', 'o.session_id')}",
    "state_claim": f"""SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'in_progress' ELSE state END AS state, CASE WHEN hit THEN 'session-1' ELSE session_id END AS session_id,
  CASE WHEN hit THEN {_NOW} ELSE updated_at END AS updated_at)
FROM (SELECT o.*, EXISTS (SELECT 1 FROM {{state_updates}} u WHERE u.schema_name = o.schema_name AND u.index_name = o.index_name AND u.state = 'in_progress') AS hit FROM {{state_prev}} o)""",
    "state_reset": _reset("state = 'in_progress'"),
    "state_reset_session": _reset("(state = 'in_progress' AND session_id = 's3')"),
    "state_reset_count": "SELECT count(*) AS reset_count FROM {state_prev} WHERE state = 'in_progress' AND session_id = 's3'",
    "state_clear": f"SELECT * FROM {{state_prev}} WHERE schema_name NOT IN {_SCHEMAS}",
    "state_pending": f"""SELECT {_WORK_KEYS}, CAST(NULL AS BIGINT) AS size_bytes, CAST(NULL AS VARCHAR) AS parent_table_name FROM {{state_prev}}
WHERE state NOT IN ('completed','skipped') AND schema_name IN {_SCHEMAS}""",
    "state_counts": """SELECT session_id, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'in_progress') AS in_progress,
  count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped
FROM {state_prev} GROUP BY session_id""",
    "pending_flags": """SELECT schema_name, count(*) FILTER (state IN ('pending','failed','in_progress')) > 0 AS has_pending,
  count(*) FILTER (state IN ('pending','failed','in_progress')) AS open_count FROM {state_prev} GROUP BY schema_name""",
    "state_final": "SELECT * REPLACE (CASE WHEN state = 'pending' THEN 'skipped' ELSE state END AS state) FROM {state_prev}",
    "completed_tables": "SELECT DISTINCT schema_name, table_name FROM {state_prev} WHERE state = 'completed'",
    "state_versions": _reset("state = 'in_progress'"),
    "resume_worklist": f"""WITH {_INV}, l AS ({_ALL_LIST})
SELECT 'fresh' AS scenario, * FROM l
UNION ALL SELECT 'open', {_WORK_KEYS} FROM {{state_prev}} WHERE state NOT IN ('completed','skipped') AND schema_name IN {_SCHEMAS}
UNION ALL SELECT 'done', l.* FROM l WHERE l.schema_name IN {_SCHEMAS} AND NOT EXISTS (SELECT 1 FROM {{state_prev}} o
  WHERE o.schema_name = l.schema_name AND o.index_name = l.index_name AND o.state IN ('completed','skipped'))""",
    "prepared_run": f"""WITH {_PREPARED_LIST},
w AS (SELECT schema_name, index_name, parent_table_name, table_name AS t, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY size_bytes, index_name) AS wave,
  CAST(('0x' || substr(md5(schema_name || '.' || table_name), 1, 8))::BIGINT % 4 AS INT) AS lane FROM work),
st AS (SELECT schema_name, index_name, table_name, CASE WHEN state = 'in_progress' THEN 'pending' ELSE state END AS state,
    CASE WHEN state = 'in_progress' THEN NULL ELSE session_id END AS session_id FROM {{state_prev}} WHERE schema_name NOT IN {_SCHEMAS}
  UNION ALL SELECT schema_name, index_name, t, 'pending', 'session-1' FROM w)
SELECT schema_name, index_name, parent_table_name, wave, lane, st.table_name, st.state, st.session_id FROM st LEFT JOIN w USING (schema_name, index_name)""",
    "attempt_fold": f"WITH {_FOLD} SELECT * FROM fold",
    "outcomes": f"WITH {_OUT} SELECT * FROM outc",
    "recorded_state": f"""WITH {_OUT} SELECT o.schema_name, o.table_name, o.index_name, o.index_type, coalesce(c.state, o.state) AS state, o.session_id,
  o.created_at, CASE WHEN c.state IS NULL THEN o.updated_at ELSE {_NOW} END AS updated_at
FROM {{state_prev}} o LEFT JOIN outc c ON c.schema_name = o.schema_name AND c.index_name = o.index_name""",
    "logbook_report": f"""WITH {_LOG} SELECT schema_name, CAST(reindex_time AS DATE) AS reindex_date, reindex_status, count(*) AS n_indexes,
  CAST(sum(before_size) AS BIGINT) AS bytes_before, CAST(sum(after_size) AS BIGINT) AS bytes_after,
  CAST(sum(before_size - after_size) AS BIGINT) AS bytes_reclaimed,
  CAST(sum(CAST(round(reindex_duration * 10) AS BIGINT)) AS BIGINT)::DOUBLE / count(reindex_duration) / 10.0::DOUBLE AS mean_duration
FROM lg GROUP BY ALL""",
    "logbook_append": f"""WITH {_LOG} SELECT * FROM lg
UNION ALL SELECT schema_name, index_name, 'all', {_NOW}, 'excluded', NULL, NULL, NULL, NULL FROM inv WHERE {_KIND['all']} AND {_band(0)} AND index_name IN {_EXCLUDED}""",
    "logbook_rerun": f"""WITH {_LOG}
SELECT 'first' AS run_id, schema_name, reindex_status, CAST(reindex_time AS DATE) AS reindex_date, count(*) AS count FROM lg GROUP BY ALL
UNION ALL SELECT 'second', schema_name, reindex_status, CAST({_NOW} AS DATE), count(*) FROM lg WHERE reindex_status = 'failed' GROUP BY ALL""",
    "state_in_place": f"""WITH {_LATEST}, a AS ({_APPLY.replace('{session}', "CASE WHEN l.state = 'in_progress' THEN l.session_id ELSE o.session_id END")})
SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'in_progress' ELSE state END AS state, CASE WHEN hit THEN 'session-1' ELSE session_id END AS session_id,
  CASE WHEN hit THEN {_NOW} ELSE updated_at END AS updated_at)
FROM (SELECT a.*, EXISTS (SELECT 1 FROM {{state_updates}} u WHERE u.schema_name = a.schema_name AND u.index_name = a.index_name AND u.index_name LIKE '%7%') AS hit FROM a)""",
    "inventory_by_name": f"""WITH {_INV} SELECT row_number() OVER (ORDER BY {_PLACE}, index_name) AS position, schema_name, index_name
FROM inv WHERE {_KIND['all']} AND schema_name IN {_LISTED} AND {_band(0)}""",
    "start_log": f"""WITH {_INV}, l AS (SELECT *, {_PLACE} AS o FROM inv WHERE {_KIND['btree']} AND schema_name IN {_LISTED} AND {_band(0)}),
n AS (SELECT *, row_number() OVER (ORDER BY o, index_name) AS position, count(*) OVER () AS total FROM l)
SELECT {_NOW} AS timestamp, 'INFO' AS level, '[' || position || '/' || total || '] Starting reindex: ' || schema_name || '.' || index_name || ' (' || index_type || ')' AS message,
  schema_name AS schema, index_name, index_type, 'starting' AS status, position AS current_index, total AS total_indexes FROM n""",
    "summary_log": f"""SELECT {_NOW} + to_milliseconds(754250) AS timestamp, 'SUCCESS' AS level, 'Reindexing completed: ' || count(*) || ' total indexes processed, '
  || count(*) FILTER (state = 'failed') || ' failed, Duration: 754.25s (using 4 threads)' AS message, 'completed' AS status,
  count(*) AS total_indexes, count(*) FILTER (state = 'failed') AS failed_count FROM {{state_prev}} GROUP BY session_id""",
    "log_reports_fleet": """WITH e AS (SELECT *, length(message) % 3 AS instance_id FROM {log_events})
SELECT instance_id, level, status, CAST(NULL AS VARCHAR) AS index_name, count(*) AS n FROM e GROUP BY ALL
UNION ALL SELECT instance_id, NULL, 'failures', index_name, count(*) FROM e WHERE status IN ('failed','validation_failed') GROUP BY instance_id, schema, index_name""",
    "analyze_targets": f"""WITH {_INV}, s AS (SELECT * FROM (VALUES ('NATION_3'),('NATION_11'),('NATION_1'),('NATION_7'),('NATION_20')) AS x(nm)),
t AS (SELECT target_ord, s.nm AS schema_name, trim(target) AS table_name FROM {{analyze_names}} CROSS JOIN s WHERE instr(target, '.') = 0
  UNION ALL SELECT target_ord, trim(split_part(target, '.', 1)), trim(substr(target, instr(target, '.') + 1)) FROM {{analyze_names}} WHERE instr(target, '.') > 0),
c AS (SELECT DISTINCT schema_name, table_name FROM inv WHERE index_type <> 'gin'),
e AS (SELECT DISTINCT schema_name, table_name FROM inv WHERE tp > 10)
SELECT target_ord, t.schema_name, t.table_name, CASE WHEN c.table_name IS NULL THEN 'not_reindexed' WHEN e.table_name IS NULL THEN 'missing' ELSE 'run' END AS action
FROM t LEFT JOIN c USING (schema_name, table_name) LEFT JOIN e USING (schema_name, table_name) WHERE t.schema_name <> '' AND t.table_name <> ''""",
    "run_summary": """SELECT session_id, count(*) AS total_indexes, count(*) FILTER (state = 'failed') AS failed_count,
  count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state IN ('skipped','pending')) AS skipped,
  754.25::DOUBLE AS duration_secs, 4 AS thread_count FROM {state_prev} GROUP BY session_id""",
    "log_text_parse": f"SELECT {_LOG_TIME} AS timestamp, level, message FROM {{log_events}}",
    "log_text_multiline": f"""SELECT {_LOG_TIME} AS timestamp, level,
  message || chr(10) || 'DETAIL: [x] ' || coalesce(index_name, '') || chr(10) || chr(10) || '  HINT: none' AS message FROM {{log_events}}""",
    "log_text_reject": "SELECT CAST(NULL AS TIMESTAMP) AS timestamp, CAST(NULL AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS message, CAST(length(text) AS INT) AS n_chars FROM {documents}",
    "log_json_roundtrip": f"SELECT {_LOG_TIME} AS timestamp, level, message, schema, index_name, status, duration_secs, current_index, error FROM {{log_events}}",
    "log_report": "SELECT level, status, count(*) AS n_events, min(timestamp) AS first_at, max(timestamp) AS last_at FROM {log_events} GROUP BY level, status",
    "failure_report": """SELECT schema, index_name, count(*) AS n_failures, arg_max(error, timestamp) AS last_error, max(timestamp) AS last_failed_at
FROM {log_events} WHERE status IN ('failed','validation_failed') GROUP BY schema, index_name""",
    "outcome_log": f"""WITH {_OUT} SELECT {_NOW} AS timestamp, CASE reindex_status WHEN 'success' THEN 'SUCCESS' ELSE 'ERROR' END AS level,
  CASE reindex_status WHEN 'success' THEN 'Reindexed ' || schema_name || '.' || index_name || ' successfully'
    WHEN 'failed' THEN schema_name || '.' || index_name || ' - Reindex failed'
    ELSE schema_name || '.' || index_name || ' - Index integrity check failed after reindexing' END AS message,
  schema_name AS schema, index_name, reindex_status AS status,
  CASE WHEN reindex_status = 'validation_failed' THEN 'Index integrity check failed after reindexing' END AS error
FROM outc WHERE reindex_status IN ('success','failed','validation_failed')""",
    "catalog_load": f"WITH {_INV} SELECT CAST(x.i AS BIGINT) AS instance_id, {_BASE} FROM inv CROSS JOIN (VALUES (1),(2)) AS x(i) WHERE {_KIND['btree']} AND {_band(0)}",
    "lag_series_stream": _POLLS.replace("{where}", f"WHERE epoch_ms(time_bucket(INTERVAL '5 seconds', ts)) + 5000 <= {_WATERMARK}"),
    "lag_throttle_stream": _pauses(10_000_000, 21_600, f"epoch_ms(ts) + 1 <= {_WATERMARK}"),
    "lag_throttle_polled_stream": _pauses(10_000_000, 21_600, f"epoch_ms(ts) + 1 <= {_WATERMARK}", _POLLED),
    "state_changelog_stream": f"""WITH {_LATEST} {_APPLY.replace('{session}', "CASE WHEN l.state = 'in_progress' THEN l.session_id ELSE o.session_id END")}""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _ORACLES.items()}
