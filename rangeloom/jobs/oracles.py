"""DuckDB SQL of the registered queries."""

from __future__ import annotations

_REC = """
rec AS (
  SELECT unhex(substr(md5(CAST(event_id AS VARCHAR)), 1, 20)) AS key, event_id AS id, event_id AS w0, user_id AS w1, CAST(round(value * 100) AS BIGINT) AS w2
  FROM events),
idx AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM rec),
samp AS (
  SELECT key, id, idx, row_number() OVER (ORDER BY key) - 1 AS k FROM idx
  WHERE idx % (n // least(1000, n)) = 0 AND idx // (n // least(1000, n)) < least(1000, n))"""


def _spl(p: int | str, name: str = "spl") -> str:
    return f"""{name} AS (
  SELECT CAST(k // ((SELECT count(*) FROM samp) // {p}) AS INTEGER) AS i, key AS splitter FROM samp
  WHERE k % ((SELECT count(*) FROM samp) // {p}) = 0 AND k // ((SELECT count(*) FROM samp) // {p}) BETWEEN 1 AND {p} - 1)"""


_HEX = "regexp_replace(lower(hex({0})), '(..)', '\\1 ', 'g')"


def _asg(name: str = "asg") -> str:
    return f"""{name} AS (
  SELECT idx.*, CAST((SELECT count(*) FROM spl WHERE spl.splitter <= idx.key) AS INTEGER) AS pid FROM idx)"""


#: Partitions of 128 MiB of records, 6 at least; a sample of 16 rows for each, 1000 at least.
_BY_SIZE = "(SELECT greatest(6, (count(*) * 100 + 134217727) // 134217728) FROM rec)"
_SIZED = f"least(greatest(1000, 16 * {_BY_SIZE}), n)"
_SORT = f"""WITH {_REC.replace("least(1000, n)", _SIZED)}, {_spl(_BY_SIZE)}, {_asg()}
SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY key, id) - 1 AS pos, {_HEX.format("key")} AS key_hex, id FROM asg"""

_SKEW = _SORT.replace("CAST(event_id AS VARCHAR)", "event_type")

_CODED = f"""WITH {_REC}, {_spl(6)}, {_asg()},
m AS (SELECT unnest(range(0, 64)) AS mask),
fil AS (
  SELECT row_number() OVER (ORDER BY mask) AS file_id, mask, list_filter(range(1, 7), lambda x: (mask >> CAST(x - 1 AS INTEGER)) & 1 = 1) AS nodes FROM m WHERE bit_count(mask) = 3),
grp AS (
  SELECT row_number() OVER (ORDER BY mask) - 1 AS group_id, mask, list_filter(range(1, 7), lambda x: (mask >> CAST(x - 1 AS INTEGER)) & 1 = 1) AS nodes FROM m WHERE bit_count(mask) = 4),
dem AS (
  SELECT g.group_id, g.dest, f.file_id, f.nodes
  FROM (SELECT group_id, mask, unnest(nodes) AS dest FROM grp) g JOIN fil f ON f.mask = g.mask - (1 << CAST(g.dest - 1 AS INTEGER))),
pla AS (SELECT file_id, unnest(nodes) AS node FROM fil),
plc AS (SELECT asg.*, least(idx // (n // 20), 19) + 1 AS file_id, pid + 1 AS dest FROM asg),
loc AS (SELECT plc.* FROM plc JOIN pla ON plc.file_id = pla.file_id AND plc.dest = pla.node),
rem AS (
  SELECT plc.*, dem.group_id, dem.nodes, count(*) OVER (PARTITION BY plc.file_id, plc.dest) AS bn, row_number() OVER (PARTITION BY plc.file_id, plc.dest ORDER BY plc.id) - 1 AS pos
  FROM plc JOIN dem ON plc.file_id = dem.file_id AND plc.dest = dem.dest),
prt AS (SELECT *, CASE WHEN bn < 3 THEN 2 ELSE least(pos // (bn // 3), 2) END AS part FROM rem),
chk AS (SELECT *, pos - part * (bn // 3) AS "offset", nodes[CAST(part + 1 AS INTEGER)] AS sender FROM prt),
met AS (
  SELECT e.group_id, e.sender, e.dest, e.file_id, e.part, coalesce(c.size, 0) AS size
  FROM (SELECT group_id, dest, file_id, unnest(nodes) AS sender, unnest(range(0, 3)) AS part FROM dem) e
  LEFT JOIN (SELECT group_id, sender, dest, file_id, part, count(*) AS size FROM chk GROUP BY ALL) c USING (group_id, sender, dest, file_id, part)),
pkt AS (SELECT group_id, sender, "offset", bit_xor(w0) AS w0, bit_xor(w1) AS w1, bit_xor(w2) AS w2 FROM chk GROUP BY ALL)
"""

_PAIRS = """WITH num AS (
  SELECT user_id AS source, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS k
  FROM events WHERE event_type IN ('click', 'purchase')),
prs AS (
  SELECT m.source, m.k, m.value * 5e6 AS map, s.value AS shuffle
  FROM num m JOIN num s ON m.source = s.source AND m.k = s.k AND m.event_type = 'click' AND s.event_type = 'purchase')
"""

_SLOTS = """slo AS (
  SELECT event_id AS id, user_id AS key, ts, 5e6 * (value / 1e7) + event_id % 100 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
cyc AS (SELECT *, CAST(seq // 14 AS INTEGER) AS cycle, seq % 14 AS slot FROM slo),
tri AS (
  SELECT key, cycle, max(CASE WHEN slot = 10 THEN cost END) AS a1, max(CASE WHEN slot = 11 THEN cost END) AS b1, max(CASE WHEN slot = 12 THEN cost END) AS a2, max(CASE WHEN slot = 13 THEN cost END) AS b2
  FROM cyc WHERE slot >= 10 GROUP BY key, cycle HAVING count(*) = 4),
dec AS (
  SELECT key, cycle, CASE WHEN a1 < b1 AND a2 < b2 THEN 1 WHEN b1 < a1 AND b2 < a2 THEN -1 ELSE 0 END AS decision FROM tri),
trj AS (
  SELECT key, CAST(0 AS INTEGER) AS cycle, CAST(1 AS INTEGER) AS r FROM (SELECT DISTINCT key FROM dec)
  UNION ALL
  SELECT t.key, t.cycle + 1, least(greatest(t.r + d.decision, 1), 5) FROM trj t JOIN dec d ON t.key = d.key AND t.cycle = d.cycle),
asn AS (
  SELECT c.id, c.key, c.seq, c.cycle, c.slot,
         CASE WHEN c.slot < 10 THEN coalesce(t.r, 1) WHEN c.slot % 2 = 0 THEN least(coalesce(t.r, 1) + 1, 5) ELSE greatest(coalesce(t.r, 1) - 1, 1) END AS r_used
  FROM cyc c LEFT JOIN trj t ON c.key = t.key AND c.cycle = t.cycle)
"""

_BAND = """WITH tra AS (
  SELECT user_id % 6 AS src, event_id % 6 AS dst, 100 * (1 + event_id % 50) AS bytes, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS t FROM events WHERE user_id % 6 <> event_id % 6),
ban AS (SELECT DISTINCT t // 86400 AS bucket FROM tra),
uni AS (SELECT bucket, (bucket + 0.5) / 31 AS u FROM ban),
ser AS (
  SELECT 'uniform' AS kind, bucket, CASE WHEN bucket % 2 = 0 THEN 100.0::DOUBLE ELSE 1000.0 END AS rate, 1 AS f FROM uni
  UNION ALL SELECT 'exponential', bucket, 100.0 + CASE WHEN bucket = 0 THEN 1 ELSE 10 END * (-ln(1 - u) / 0.01), 6 FROM uni
  UNION ALL SELECT 'pareto', bucket, 200.0 / pow(u, 0.5), 6 FROM uni)
"""

ORACLES = {
    "total_sort": _SORT,
    "total_sort_skew": _SKEW,
    "total_sort_builtin": f"WITH {_REC} SELECT {_HEX.format('key')} AS key_hex, id, w1, w2 FROM rec ORDER BY key, id",
    "total_sort_balanced": f"WITH {_REC} SELECT row_number() OVER (ORDER BY key, id) - 1 AS idx, {_HEX.format('key')} AS key_hex, id FROM rec",
    "total_sort_balanced_skew": f"WITH {_REC.replace('CAST(event_id AS VARCHAR)', 'event_type')} SELECT row_number() OVER (ORDER BY key, id) - 1 AS idx, {_HEX.format('key')} AS key_hex, id FROM rec",
    "quantile_cuts": "SELECT count(*) AS n, CAST(12 AS INTEGER) AS ranges, true AS even FROM events",
    "row_index": f"WITH {_REC} SELECT id, row_number() OVER (ORDER BY key, id) - 1 AS idx FROM rec",
    "row_index_growing": f"WITH {_REC} SELECT id, row_number() OVER (ORDER BY key, id) - 1 AS idx FROM rec",
    "row_index_lineitem": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx FROM lineitem""",
    "split_keys": f"WITH {_REC} SELECT id, {_HEX.format('key')} AS key_hex, 'value of ' || id AS value FROM rec",
    "split_input": f"WITH {_REC} SELECT id, CAST(least(idx // (n // 7), 6) AS INTEGER) AS split_id FROM idx",
    "systematic_sample": f"WITH {_REC} SELECT idx, id FROM samp",
    "splitters": f"WITH {_REC}, {_spl(16)} SELECT i, {_HEX.format('splitter')} AS splitter FROM spl",
    "range_assign": f"WITH {_REC}, {_spl(6)}, {_asg()} SELECT id, pid FROM asg",
    "range_assign_many": f"WITH {_REC}, {_spl(100)}, {_asg()} SELECT id, pid FROM asg",
    "exchange_matrix": f"""WITH {_REC}, {_spl(6)}, {_asg()}
SELECT g.split_id, g.pid, count(asg.id) AS lines, 100 * count(asg.id) AS bytes
FROM (SELECT CAST(a.s AS INTEGER) AS split_id, CAST(unnest(range(0, 6)) AS INTEGER) AS pid FROM (SELECT unnest(range(0, 7)) AS s) a) g
LEFT JOIN asg ON CAST(least(idx // (n // 7), 6) AS INTEGER) = g.split_id AND asg.pid = g.pid GROUP BY 1, 2""",
    "job_codec": """WITH j AS (
  SELECT o_orderkey AS id, o_custkey % 5 AS m, CASE WHEN o_orderkey % 2 = 0 THEN 'CodedTeraSort' ELSE 'TeraSort' END AS type, o_orderkey % 7 AS r, o_orderpriority AS prefix FROM orders)
SELECT id, m || ':' || type || ':-1:6:' || r || ':' || prefix || CASE WHEN id % 11 = 0 THEN ':x' ELSE '' END AS job, id % 11 <> 0 AS job_ok,
  CASE WHEN id % 11 <> 0 THEN CAST(m AS INTEGER) END AS master_id, CASE WHEN id % 11 <> 0 THEN type END AS type,
  CASE WHEN id % 11 <> 0 THEN CAST(-1 AS INTEGER) END AS input_file_num, CASE WHEN id % 11 <> 0 THEN CAST(6 AS INTEGER) END AS reducer_num,
  CASE WHEN id % 11 <> 0 THEN CAST(r AS INTEGER) END AS r, CASE WHEN id % 11 <> 0 THEN prefix END AS prefix FROM j""",
    "validate_jobs": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'CodedTeraSort' ELSE 'TeraSort' END AS type, CAST(o_orderkey % 7 AS INTEGER) AS r,
  CASE WHEN o_orderkey % 7 NOT BETWEEN 1 AND 5 THEN 'r out of range' END AS error FROM orders""",
    "input_files": """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 1 THEN 6 WHEN 2 THEN 15 WHEN 3 THEN 20 WHEN 4 THEN 15 WHEN 5 THEN 6 WHEN 6 THEN 1 END::BIGINT AS n_files FROM orders""",
    "replicas": f"""{_CODED}
SELECT p.node, plc.dest, count(*) AS n_full,
  count(*) FILTER (WHERE plc.dest = p.node OR NOT list_contains(f.nodes, plc.dest)) AS n_kept
FROM plc JOIN pla p ON plc.file_id = p.file_id JOIN fil f ON f.file_id = plc.file_id GROUP BY 1, 2 HAVING n_kept > 0""",
    "chunks": f'{_CODED} SELECT id, group_id, sender, dest, file_id, CAST(part AS INTEGER) AS part, "offset" FROM chk',
    "packets": f"{_CODED} SELECT * FROM pkt",
    "packet_metadata": f"""{_CODED} SELECT group_id, sender,
  string_agg(dest || '/' || file_id || '/' || (part + 1) || '/' || size, ' ' ORDER BY dest, file_id, part) AS chunks, max(size) AS packet_size, CAST(136 AS INTEGER) AS header_bytes
FROM met GROUP BY 1, 2""",
    "decoded": f'{_CODED} SELECT dest, file_id, CAST(part AS INTEGER) AS part, "offset", w0, w1, w2 FROM chk',
    "completeness": f"""{_CODED},
hel AS (
  SELECT node, file_id, sum(n) AS n FROM (
    SELECT dest AS node, file_id, count(*) AS n FROM loc GROUP BY 1, 2 UNION ALL SELECT dest, file_id, count(*) FROM chk GROUP BY 1, 2) GROUP BY 1, 2),
wan AS (
  SELECT d.dest AS node, f.file_id, coalesce(p.n, 0) AS n FROM fil f, (SELECT unnest(range(1, 7)) AS dest) d
  LEFT JOIN (SELECT dest, file_id, count(*) AS n FROM plc GROUP BY 1, 2) p ON p.dest = d.dest AND p.file_id = f.file_id)
SELECT CAST(w.node AS INTEGER) AS node, CAST(count(*) FILTER (WHERE w.n = coalesce(h.n, 0)) AS BIGINT) AS files_seen, CAST(count(*) AS BIGINT) AS files_expected,
  CAST(sum(coalesce(h.n, 0)) AS BIGINT) AS lines, count(*) FILTER (WHERE w.n = coalesce(h.n, 0)) = count(*) AS ok
FROM wan w LEFT JOIN hel h ON w.node = h.node AND w.file_id = h.file_id GROUP BY 1""",
    "file_copies": f"{_CODED} SELECT pla.node, pla.file_id, count(*) AS lines FROM pla JOIN plc ON pla.file_id = plc.file_id GROUP BY 1, 2",
    "group_demand": f"""{_CODED} SELECT dem.group_id, array_to_string(grp.nodes, ' ') AS members, dem.dest, dem.file_id, count(plc.id) AS lines
FROM dem JOIN grp ON dem.group_id = grp.group_id LEFT JOIN plc ON plc.file_id = dem.file_id AND plc.dest = dem.dest GROUP BY 1, 2, 3, 4""",
    "coded_sort_records": f"""{_CODED} SELECT dest, file_id, {_HEX.format("key")} AS key_hex, rpad(lpad(CAST(id AS VARCHAR), 12, '0'), 90, '.') AS value FROM plc""",
    "coded_sort": f"""{_CODED} SELECT dest, file_id, CAST('0x' || substr(hex(key), 1, 10) AS BIGINT) AS k0, CAST('0x' || substr(hex(key), 11, 10) AS BIGINT) AS k1, w0, w1, w2 FROM plc""",
    "load_report": f"""{_CODED},
a AS (SELECT p.node, count(*) AS lines_mapped FROM plc JOIN pla p ON plc.file_id = p.file_id GROUP BY 1),
b AS (SELECT dest AS node, count(*) AS remote_lines FROM rem GROUP BY 1),
c AS (SELECT sender AS node, CAST(sum(lines) AS BIGINT) AS packet_lines FROM (SELECT group_id, sender, max(size) AS lines FROM met GROUP BY 1, 2) GROUP BY 1)
SELECT a.node, lines_mapped, remote_lines, packet_lines, round(packet_lines / remote_lines, 6) AS coded_over_uncoded FROM a JOIN b USING (node) JOIN c USING (node)""",
    "pair_phases": f"{_PAIRS} SELECT * FROM prs",
    "pair_phases_growing": f"{_PAIRS} SELECT * FROM prs",
    "phase_ratios": f"{_PAIRS} SELECT source, k, round(CASE WHEN shuffle <> 0 THEN map / shuffle END, 4) AS map_over_shuffle, round(CASE WHEN map <> 0 THEN shuffle / map END, 12) AS shuffle_over_map FROM prs",
    "total_time": f"{_PAIRS} SELECT source, round(sum(map + shuffle), 2) AS total FROM prs GROUP BY 1",
    "ratio_stats": f"""{_PAIRS}, q AS (SELECT source, CASE WHEN shuffle <> 0 THEN map / shuffle END AS x FROM prs)
SELECT source, count(x) AS n, round(avg(x), 2) AS mean_ratio, round(CASE WHEN count(x) > 1 THEN var_samp(x) END / 1e12, 4) AS var_ratio_e12 FROM q GROUP BY 1""",
    "compare_schemes": f"""{_PAIRS}, t AS (SELECT source % 50 AS distribution, source // 50 AS s, sum(map + shuffle) AS total FROM prs GROUP BY source)
SELECT b.distribution, 'scheme' || b.s AS baseline, round((o.total - b.total) / b.total, 8) AS change
FROM t b JOIN t o ON b.distribution = o.distribution AND o.s = 0 AND b.s IN (1, 2)""",
    "phase_summary": """SELECT l_orderkey AS job, l_returnflag AS phase, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS avg_seconds, CAST(max(l_quantity) AS DOUBLE) AS max_seconds FROM lineitem GROUP BY 1, 2""",
    "cycle_slots": f"WITH RECURSIVE {_SLOTS} SELECT id, key, seq, cycle, slot FROM cyc",
    "trial_decisions": f"WITH RECURSIVE {_SLOTS} SELECT key, cycle, CAST(decision AS INTEGER) AS decision FROM dec",
    "r_trajectory": f"WITH RECURSIVE {_SLOTS} SELECT key, cycle, r FROM trj",
    "assign_r": f"WITH RECURSIVE {_SLOTS} SELECT id, CAST(r_used AS INTEGER) AS r_used FROM asn",
    "tune_stream_files": f"WITH RECURSIVE {_SLOTS} SELECT key, seq, cycle, CAST(slot AS INTEGER) AS slot, CAST(r_used AS INTEGER) AS r_used FROM asn",
    "bandwidth_series": f"{_BAND} SELECT kind, bucket, round(rate, 6) AS rate, round(rate * f, 6) AS broadcast FROM ser",
    "transfer_cost": f"""{_BAND} SELECT src, dst, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes / rate), 4) AS seconds
FROM tra JOIN ser ON tra.t // 86400 = ser.bucket AND kind = 'pareto' GROUP BY 1, 2""",
    "rate_as_of": """SELECT e.event_id, s.value AS rate
FROM (SELECT * FROM events WHERE event_type <> 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') s ON e.user_id = s.user_id AND e.ts >= s.ts""",
    "record_files": f"""WITH t AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(epoch(l_shipdate) AS BIGINT) AS text FROM lineitem)
SELECT row_number() OVER (ORDER BY substr(md5(text), 1, 20), rpad(text, 90, '.')) - 1 AS place, {_HEX.format("unhex(substr(md5(text), 1, 20))")} AS key_hex, rpad(text, 90, '.') AS value FROM t""",
    "phase_log_files": """WITH n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no FROM events)
SELECT user_id AS source, line_no, CASE event_type WHEN 'click' THEN 'MAP' ELSE 'SHUFFLE' END AS phase, CAST(event_id AS DOUBLE) AS value
FROM n WHERE event_type IN ('click', 'purchase')""",
    "job_list_files": """WITH j AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'CodedTeraSort' ELSE 'TeraSort' END AS kind, o_orderkey % 13 <> 0 AS ok FROM orders)
SELECT CASE WHEN ok THEN kind END AS type, CASE WHEN ok THEN CAST(-1 AS INTEGER) END AS input_file_num,
  CASE WHEN ok THEN CAST(6 AS INTEGER) END AS reducer_num, CASE WHEN ok THEN CAST(o_orderkey % 7 AS INTEGER) END AS r, CASE WHEN ok THEN 'order-' || o_orderkey END AS prefix,
  CASE WHEN NOT ok THEN kind || ' ' || o_orderkey END AS rejected FROM j""",
}
