"""SQL that computes the expected result of a registered query.

The expected values come from the columns a line was rendered from; no query here
parses a line. Written for DuckDB.
"""

from __future__ import annotations

from fwlog import vocab
from fwlog.plans import fixtures as fx
from fwlog.plans.queries import DESTINATIONS

_KEYED = (
    "k AS (SELECT event_id * 6 + i AS e, user_id AS u, event_type AS t, "
    "CAST(floor(value * 10) AS BIGINT) AS v FROM events, range(6) r(i))"
)
_EVENTS = f"WITH {_KEYED.replace('event_id * 6 + i', 'event_id').replace(', range(6) r(i)', '')}"
_GENERATED = "g AS (SELECT *, " + ", ".join(
    f"{sql} AS {name}" for name, sql in fx.GENERATED.items()
) + " FROM k)"

_RICH = {
    "app": "g_app",
    "category": "'Other_Service'",
    "nat_src": "g_dst",
    "nat_dst": "'fe80::1%eth0'",
    "nat_sport": "g_sport",
    "nat_dport": "g_dport",
    "init_pkts": "'1'",
    "reply_pkts": "'2'",
    "reply_bytes": "g_bytes",
    "rcv_vpn": "''",
    "snd_vpn": "'vpn1'",
    "rcv_ds_tunnel": "''",
    "snd_ds_tunnel": "''",
    "start_time": "'03132026162009'",
    "end_time": "''",
    "vni": "'7'",
    "rule_id": "'0'",
    "dst_nat_type": "'NAT server.'",
    "src_zone": "'Trust'",
    "dst_zone": "'Untrust'",
    "policy_name": "g_policy",
    "user": "g_user",
    "hit_count": "'3'",
    "match_count": "'4'",
}
_EXPECTED = {
    "proto": "g_proto",
    "src": "CASE WHEN e % 41 <> 0 THEN g_src END",
    "dst": "g_dst",
    "sport": "g_sport",
    "dport": "g_dport",
    "init_bytes": "g_bytes",
    "fw_action": "CASE WHEN e % 10 = 8 THEN 'Permit' END",
    "vlan_id": "'--'",
    "src_nat_type": "'Not translated'",
    "event": "g_event",
    "hostname": "CASE WHEN e % 6 <> 5 THEN 'FW-01' END",
    "action": (
        "CASE e % 10 WHEN 8 THEN 'permit' WHEN 9 THEN 'reset' ELSE CASE t "
        "WHEN 'signup' THEN 'permit' WHEN 'purchase' THEN 'close' WHEN 'view' THEN 'permit' "
        "WHEN 'click' THEN 'log' WHEN 'error' THEN 'deny' END END"
    ),
    "_pri": "CASE WHEN e % 6 IN (1, 2, 3) THEN '189' END",
    "_rfc5424_ver": "CASE WHEN e % 6 = 3 THEN '1' END",
    "_syslog_timestamp": (
        "CASE e % 6 WHEN 2 THEN 'Mar 13 16:20:09' WHEN 3 THEN '2026-03-13T16:20:09Z' END"
    ),
    "_src_ip": "CASE WHEN e % 6 < 4 THEN '10.16.18.1' END",
    "_module": (
        "CASE WHEN e % 6 < 4 THEN 'nat/6/NAT_IPV4_MATCH' "
        "WHEN e % 6 = 4 THEN 'SESSION/6/SESSION_IPV4' END"
    ),
    **{c: f"CASE WHEN e % 4 = 0 THEN {sql} END" for c, sql in _RICH.items()},
}


def _records(keyed: str = _KEYED) -> str:
    columns = ", ".join(f'{sql} AS "{name}"' for name, sql in _EXPECTED.items())
    return (
        f"WITH RECURSIVE {keyed}, {_GENERATED}, "
        f"p AS (SELECT e AS msg_id, *, {columns} FROM g WHERE e % 43 <> 0)"
    )


_P = _records()


def _kv_value(c: str) -> str:
    return f"regexp_replace(replace(\"{c}\", ' ', '_'), '[;=\\n\\r\\t\\x00-\\x1f\\x7f]', '', 'g')"


def _pair(lead: str, column: str, value: str) -> str:
    return f"CASE WHEN \"{column}\" NOT IN ('', '--') THEN '{lead}' || {value} END"


def _kv(columns) -> str:
    return "concat_ws(' ', " + ", ".join(_pair(f"{c}=", c, _kv_value(c)) for c in columns) + ")"


_CORE = _kv(vocab.CORE_COLUMNS)
_EXTENDED = _kv(vocab.CORE_COLUMNS + vocab.EXTENDED_COLUMNS)


def _cef_value(c: str) -> str:
    return (
        f"replace(replace(replace(replace(regexp_replace({c}, "
        "'[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), "
        "'\\', '\\\\'), '=', '\\='), chr(10), '\\n'), chr(13), '\\n')"
    )


def _cef_parts(columns=None):
    labels = vocab.CEF_LABELS
    for column, key in vocab.CEF_KEYS:
        if columns is not None and column not in columns:
            continue
        lead = f"{key}Label={labels[key]} {key}=" if key in labels else f"{key}="
        yield _pair(lead, column, _cef_value(f'"{column}"'))


_CEF = (
    "'CEF:0|H3C|Comware|7.0|' || CASE WHEN e % 10 = 9 THEN 'H3C_RESET' ELSE CASE t "
    "WHEN 'signup' THEN 'SESSION_CREATED' WHEN 'purchase' THEN 'SESSION_DELETED' "
    "WHEN 'view' THEN 'SESSION_MATCHED' WHEN 'click' THEN 'LOG_ONLY' "
    "WHEN 'error' THEN 'SESSION_DENIED' END END || '|' || "
    "CASE action WHEN 'permit' THEN 'Session Permitted|3' WHEN 'deny' THEN 'Session Denied|7' "
    "WHEN 'reset' THEN 'Connection Reset|8' WHEN 'close' THEN 'Session Closed|2' "
    "WHEN 'log' THEN 'Log Only|1' END || '|' || concat_ws(' ', " + ", ".join(_cef_parts()) + ")"
)


def _envelope(pri: int, tag: str, text: str) -> str:
    return (
        f"'<{pri}>' || CASE WHEN _syslog_timestamp IS NULL THEN '' ELSE _syslog_timestamp || ' ' END "
        f"|| coalesce(hostname, 'h3c-firewall') || ' {tag}' || {text}"
    )


_SYSTEM = (
    f"WITH {_KEYED}, s0 AS (SELECT *, "
    + ", ".join(f"{sql} AS {n}" for n, sql in fx.SYSTEM_GENERATED.items())
    + f" FROM k), s AS (SELECT *, {fx.SYSTEM_TEXT} AS g_text, e AS msg_id FROM s0)"
)
_SYSTEM_ACTION = (
    "CASE e % 7 WHEN 0 THEN 'permit' WHEN 1 THEN 'close' WHEN 5 THEN CASE e % 4 "
    "WHEN 0 THEN 'permit' WHEN 1 THEN 'deny' WHEN 2 THEN 'permit' ELSE 'close' END "
    "ELSE 'log' END"
)

_CSV_KIND = (
    "CASE WHEN e = 0 THEN 'header' WHEN e % 61 = 0 THEN 'blank' WHEN e % 59 = 0 THEN 'short' "
    "WHEN e % 53 = 0 THEN 'bad' WHEN e % 43 = 0 THEN 'garbage' ELSE 'full' END"
)
_CSV_HOST = "CASE WHEN e % 7 = 0 THEN 'fw \"q\"' ELSE '10.16.18.1' END"
_CSV = f"WITH {_KEYED}, c AS (SELECT *, {_CSV_KIND} AS kind FROM k)"

_TRAFFIC = (
    f"WITH {_KEYED}, m AS (SELECT e AS msg_id, e, "
    f"({fx.TRAFFIC_MILLIS}) * 1000 AS us, {fx.TRAFFIC_SENDER} AS client_ip FROM k), "
    "w AS (SELECT *, us // 10000000 AS win FROM m), "
    "capped AS (SELECT * FROM (SELECT *, row_number() OVER "
    "(PARTITION BY client_ip, win ORDER BY us, msg_id) AS n FROM w) WHERE n <= 500)"
)
_SESSIONS = (
    "ses AS (SELECT 'c' || j AS collector_id, (1704067200000 + j * 7000) * 1000 AS t0, "
    "(1704067200000 + j * 7000 + 3000 + j % 3 * 2500) * 1000 AS t1, j % 7 <> 6 AS allowed "
    "FROM (SELECT DISTINCT (e - e % 5000) // 5000 AS j FROM k))"
)
_DELIVERED = (
    "d AS (SELECT m.msg_id, ses.collector_id FROM m JOIN ses "
    "ON ses.allowed AND ses.t0 <= m.us AND m.us < ses.t1)"
)
_LOG = (
    f"WITH {_KEYED}, log AS (SELECT e AS msg_id, 'rsyslog' AS vector, e % 9 <> 0 AS ok FROM k "
    "UNION ALL SELECT e, 'udp', e % 6 <> 0 FROM k)"
)

_SENDERS = (
    f"WITH {_KEYED}, {_GENERATED}, q AS (SELECT e AS msg_id, CASE e % 4 WHEN 0 THEN g_src "
    "WHEN 1 THEN g_dst WHEN 2 THEN concat('2001:db', e % 3 + 7, '::', e % 9999) "
    "ELSE concat('192.168.1.', e % 300) END AS client_ip, "
    "CASE e % 4 WHEN 0 THEN e % 41 <> 0 AND e % 200 < 128 WHEN 1 THEN (e * 7) % 250 < 16 "
    "WHEN 2 THEN e % 3 = 1 ELSE e % 300 = 7 END AS ok FROM g)"
)

_ADDRESS_OK = "e % 7 <> 0 AND e % 300 <= 255 AND u % 260 <= 255 AND e % 258 <= 255"

_BLANKS = "".join(
    f"chr({p})" if i == 0 else f" || chr({p})"
    for i, p in enumerate([*range(9, 14), *range(28, 33), 133, 160, 0x1680,
                           *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# One row per line of a bulk request: the request, the place and the expected text.
_BULK = (
    _P + f", b AS (SELECT k.e, (k.e - k.e % 40) // 40 AS request_id, k.e % 40 AS \"index\", "
    f"x.message FROM k LEFT JOIN (SELECT msg_id, {_EXTENDED} AS message FROM p) x ON x.msg_id = k.e)"
)
_BULK_ALL = f"{_BULK}, a AS (SELECT * FROM b)"
_JSON_TEXT = "'\"' || replace(message, '\\', '\\\\') || '\"'"

_PUBLIC = ", ".join(f'"{c}"' for c in vocab.PUBLIC_COLUMNS)

_DOC_TEXT = "CASE WHEN doc_id % 2 = 0 THEN concat('(', doc_id % 16, ')') ELSE '' END || text"


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(x), '{w}')" for w in words) + ")"


ORACLES = {
    "parse_session": f"{_P} SELECT msg_id, {_PUBLIC} FROM p",
    "parse_headers": (
        f"{_P}, s AS (SELECT *, {fx.SYSTEM_GENERATED['g_module']} AS g_module FROM k) "
        "SELECT e AS msg_id, "
        + ", ".join(
            f'{_EXPECTED[c]} AS "{c.strip("_")}"' for c in ("hostname", *vocab.HEADER_COLUMNS)
        ).replace("CASE ", "CASE WHEN e % 43 = 0 THEN NULL ELSE CASE ").replace(" END AS", " END END AS")
        + " FROM k UNION ALL SELECT -e - 1, CASE WHEN e % 5 = 0 THEN 'FW-03' ELSE 'FW-02' END, "
        "CASE WHEN e % 5 = 0 THEN '14' END, NULL, NULL, "
        "CASE WHEN e % 5 = 0 THEN '10.16.18.9' END, g_module FROM s"
    ),
    "unknown_fields": f"{_P} SELECT msg_id, CAST(1 AS BIGINT) AS n, 'bar' AS foo FROM p",
    "derive_action": (
        f"SELECT doc_id, CASE WHEN regexp_matches(x, '^\\(\\d+\\)') "
        "THEN CASE regexp_extract(x, '^\\((\\d+)\\)', 1) "
        "WHEN '1' THEN 'deny' WHEN '2' THEN 'deny' WHEN '3' THEN 'drop' WHEN '4' THEN 'drop' "
        "WHEN '5' THEN 'reset' WHEN '6' THEN 'redirect' WHEN '7' THEN 'log' WHEN '8' THEN 'permit' "
        "WHEN '9' THEN 'close' WHEN '10' THEN 'close' WHEN '11' THEN 'permit' WHEN '12' THEN 'deny' "
        "ELSE 'unknown' END "
        f"WHEN {_has('created', 'permit', 'allow')} THEN 'permit' "
        f"WHEN {_has('denied', 'deny', 'block', 'reject')} THEN 'deny' "
        f"WHEN {_has('deleted', 'closed', 'teardown')} THEN 'close' "
        f"WHEN {_has('drop')} THEN 'drop' WHEN {_has('reset')} THEN 'reset' ELSE 'unknown' END AS action "
        f"FROM (SELECT doc_id, {_DOC_TEXT} AS x FROM documents)"
    ),
    "format_core": f"{_P} SELECT msg_id, {_CORE} AS message FROM p",
    "format_extended": f"{_P} SELECT msg_id, {_EXTENDED} AS message FROM p",
    "translate_cef": f"{_P} SELECT msg_id, {_CEF} AS message FROM p",
    "syslog_envelope_kv": (
        f"{_P} SELECT msg_id, {_envelope(134, 'h3c-translator: ', _CORE)} AS syslog FROM p"
    ),
    "syslog_envelope_cef": f"{_P} SELECT msg_id, {_envelope(35, '', _CEF)} AS syslog FROM p",
    "syslog_priority": (
        "SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 16 "
        "ELSE 4 END * 8 + CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 7 WHEN 3 THEN 6 "
        "ELSE 3 END AS BIGINT) AS pri FROM customer"
    ),
    "sanitize_values": (
        "SELECT doc_id, md5(regexp_replace(replace(text, ' ', '_'), "
        "'[;=\\n\\r\\t\\x00-\\x1f\\x7f]', '', 'g')) AS kv, "
        "md5(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), "
        "'\\', '\\\\'), '|', '\\|')) AS cef_header, "
        f"md5({_cef_value('text')}) AS cef_value FROM documents"
    ),
    "parse_system_logs": (
        f"{_SYSTEM} SELECT msg_id, 'SYSLOG' AS proto, upper(split_part(g_module, '/', 1)) AS category, "
        "g_module || ': ' || substring(g_text, 1, 200) AS event, "
        "CASE WHEN e % 7 IN (0, 1, 2, 3, 5) THEN 'u' || u END AS \"user\", "
        "CASE WHEN e % 7 IN (0, 1, 2) AND e % 11 <> 0 THEN g_ip "
        "WHEN e % 7 = 5 THEN CASE WHEN e % 11 = 0 THEN '172.16.0.' || e % 250 ELSE g_ip END END AS src, "
        "CASE WHEN e % 7 = 5 AND e % 11 <> 0 THEN '172.16.0.' || e % 250 END AS dst, "
        "CASE e % 7 WHEN 2 THEN 'CLI:' || CASE WHEN g_line = '' THEN 'unknown' ELSE g_line END "
        "WHEN 3 THEN 'CONFIGURATION' WHEN 4 THEN 'GigabitEthernet1/0/' || e % 24 END AS app, "
        "CASE WHEN e % 5 = 0 THEN 'FW-03' ELSE 'FW-02' END AS hostname, 'system' AS log_type, "
        "CASE WHEN e % 7 = 2 THEN 'display ' || t END AS command, "
        "CASE WHEN e % 7 = 4 THEN upper(g_state) END AS status FROM s"
    ),
    "system_actions": f"{_SYSTEM} SELECT msg_id, {_SYSTEM_ACTION} AS action FROM s",
    "csv_translate": (
        f"{_P}, c AS (SELECT e, {_CSV_KIND} AS kind FROM k) "
        "SELECT c.e AS msg_id, CASE WHEN kind = 'full' THEN "
        f"coalesce(p.hostname, {_CSV_HOST.replace('e %', 'c.e %')}) END AS hostname, "
        "CASE WHEN kind = 'full' THEN '2026-03-13 10:24:05' END AS csv_ts, "
        f"CASE WHEN kind = 'short' THEN 'proto=TCP sport=5 action=unknown' ELSE {_CORE} END AS message "
        "FROM c LEFT JOIN p ON p.msg_id = c.e WHERE kind IN ('full', 'short')"
    ),
    "dead_letters_csv": (
        f"{_CSV} SELECT 'no_recognized_fields' AS reason, 'garbage line ' || e AS raw FROM c "
        "WHERE kind = 'garbage' UNION ALL SELECT 'csv_payload_unparsable', "
        "'\"2026-03-13 10:24:05\",' || CASE WHEN e % 7 = 0 THEN '\"fw \"\"q\"\"\"' ELSE '10.16.18.1' END "
        "|| ',\"garbage line ' || e || '\",extra' FROM c WHERE kind = 'garbage' "
        "UNION ALL SELECT unnest(['no_recognized_fields', 'csv_insufficient_fields']), "
        "'\"2026-03-13 10:24:05\",nothing here' FROM c WHERE kind = 'bad'"
    ),
    "dead_letters_log": (
        f"WITH {_KEYED} SELECT CASE WHEN e % 19 = 0 THEN 'empty_line' ELSE 'no_recognized_fields' END "
        "AS reason, CASE WHEN e % 19 = 0 THEN '   ' ELSE 'm' || e END AS raw FROM k"
    ),
    "parser_stats": (
        f"WITH {_KEYED} SELECT count(*) AS total, count(*) FILTER (e % 43 <> 0) AS parsed, "
        "count(*) FILTER (e % 43 = 0) AS failed FROM k"
    ),
    "formatter_stats": (
        f"WITH {_KEYED} SELECT count(*) FILTER (e % 43 <> 0 AND e % 50 <> 1) AS formatted, "
        "count(*) FILTER (e % 50 = 1) AS skipped FROM k"
    ),
    "receiver_stats": (
        f"{_TRAFFIC} SELECT count(*) FILTER (client_ip IN ('10.10.0.1', '10.10.0.4') AND e % 19 <> 0) "
        "AS messages_received, count(*) FILTER (client_ip NOT IN ('10.10.0.1', '10.10.0.4')) "
        "AS connections_rejected_ip FROM capped"
    ),
    "batch_summary": (
        f"{_CSV} SELECT count(*) AS total, count(*) FILTER (kind IN ('full', 'short')) AS translated, "
        "count(*) FILTER (kind NOT IN ('full', 'short')) AS failed FROM c"
    ),
    "valid_addresses": (
        f"WITH {_KEYED} SELECT e AS msg_id, {_ADDRESS_OK} AS valid, CASE WHEN {_ADDRESS_OK} THEN "
        "format('{:02x}{:02x}{:02x}{:02x}', e % 300, u % 260, e % 256, e % 258) END AS hex FROM k"
    ),
    "network_list": (
        "WITH n AS (SELECT c_custkey AS k FROM customer) "
        "SELECT k AS c_custkey, CAST(4 AS BIGINT) AS family, CAST(20 AS BIGINT) AS bits, "
        "format('0a{:02x}{:02x}00', k % 200, k % 250 - k % 250 % 16) AS lo, "
        "format('0a{:02x}{:02x}ff', k % 200, k % 250 - k % 250 % 16 + 15) AS hi FROM n "
        "UNION ALL SELECT k, 4, 32, format('c0a801{:02x}', k % 250), format('c0a801{:02x}', k % 250) FROM n "
        "UNION ALL SELECT k, 6, 48, format('20010db8000{}', k % 10) || repeat('0', 20), "
        "format('20010db8000{}', k % 10) || repeat('f', 20) FROM n "
        "UNION ALL SELECT k, 4, 16, '0a000000', '0a00ffff' FROM n"
    ),
    "allowed_sources": f"{_SENDERS} SELECT msg_id, client_ip FROM q WHERE ok",
    "allowed_by_table": (
        f"{_SENDERS} SELECT msg_id, client_ip FROM q JOIN k ON k.e = msg_id WHERE CASE e % 4 WHEN 0 THEN e % 41 <> 0 AND "
        "(e % 200, u % 250) IN (SELECT (c_custkey % 200, c_custkey % 250) FROM customer) "
        "WHEN 2 THEN e % 3 < 2 ELSE false END"
    ),
    "rejected_sources": f"{_SENDERS} SELECT msg_id, client_ip FROM q WHERE NOT ok",
    "effective_client_ip": (
        f"WITH {_KEYED} SELECT e AS msg_id, CASE e % 3 WHEN 1 THEN '192.0.2.7' WHEN 2 THEN 'no-address' "
        "ELSE CASE WHEN e % 17 = 0 OR e % 5 = 0 THEN '10.0.0.5' ELSE '203.0.113.' || e % 200 END END "
        "AS client_ip FROM k"
    ),
    "line_size_gate": "SELECT doc_id, strlen(text) <= 8192 AS fits FROM documents",
    "rate_cap_tumbling": f"{_TRAFFIC} SELECT msg_id, client_ip FROM capped",
    "sender_cap": (
        f"{_TRAFFIC}, f AS MATERIALIZED (SELECT client_ip AS sender, win AS of_win, row_number() OVER "
        "(PARTITION BY win ORDER BY us, msg_id) AS r FROM capped WHERE n = 1) SELECT msg_id, client_ip "
        "FROM capped JOIN f ON client_ip = sender AND win = of_win WHERE r <= 3"
    ),
    "rate_limit_anchored": (
        f"{_TRAFFIC.replace('WITH', 'WITH RECURSIVE', 1)}, a(client_ip, anchor) AS (SELECT client_ip, min(us) FROM m GROUP BY client_ip "
        "UNION ALL SELECT a.client_ip, min(m.us) FROM a JOIN m ON m.client_ip = a.client_ip "
        "AND m.us >= a.anchor + 1000000 GROUP BY a.client_ip) "
        "SELECT msg_id, client_ip FROM (SELECT m.msg_id, m.client_ip, row_number() OVER "
        "(PARTITION BY m.client_ip, a.anchor ORDER BY m.us, m.msg_id) AS n "
        "FROM m ASOF JOIN a ON m.client_ip = a.client_ip AND m.us >= a.anchor) WHERE n <= 200"
    ),
    "bulk_status": (
        f"WITH {_KEYED}, r AS (SELECT (e - e % 40) // 40 AS request_id, count(*) AS n FROM k GROUP BY 1) "
        "SELECT request_id, CAST(200 AS BIGINT) AS status, CAST(n AS BIGINT) AS n FROM r "
        "UNION ALL SELECT -request_id - 1, CAST(CASE WHEN request_id % 10 = 6 THEN 500 ELSE 400 END AS BIGINT), "
        "CAST(0 AS BIGINT) FROM r WHERE request_id % 10 IN (3, 5, 6, 7, 8, 9)"
    ),
    "bulk_translate": (
        f"{_BULK_ALL} SELECT request_id, \"index\", message, "
        "CASE WHEN message IS NULL THEN 'no_recognized_fields' END AS reason FROM a"
    ),
    "bulk_summary": (
        f"{_BULK_ALL} SELECT request_id, count(*) AS \"count\", count(message) AS translated "
        "FROM a GROUP BY request_id"
    ),
    "bulk_results": (
        f"{_BULK_ALL} SELECT request_id, count(*) AS \"count\", count(message) AS translated, "
        "'{\"count\":' || count(*) || ',\"translated\":' || count(message) || ',\"results\":[' || "
        "string_agg('{\"index\":' || \"index\" || ',\"translated\":' || CASE WHEN message IS NULL "
        f"THEN 'null,\"error\":\"unparsable\"' ELSE {_JSON_TEXT} END || '}}', ',' ORDER BY \"index\") "
        "|| ']}' AS document FROM a GROUP BY request_id"
    ),
    "request_status": (
        _P + " SELECT k.e AS msg_id, CAST(CASE WHEN k.e % 8 IN (1, 2, 3) THEN 400 "
        "WHEN k.e % 400 = 5 THEN 413 WHEN k.e % 8 IN (0, 4) AND k.e % 43 <> 0 THEN 200 ELSE 422 END "
        f"AS BIGINT) AS status, CASE WHEN k.e % 8 IN (0, 4) THEN x.message END AS message FROM k "
        f"LEFT JOIN (SELECT msg_id, {_EXTENDED} AS message FROM p) x ON x.msg_id = k.e"
    ),
    "public_fields": (
        f"{_P} SELECT msg_id, '{{' || concat_ws(',', "
        + ", ".join(
            f"'\"{c}\":\"' || replace(\"{c}\", '\\', '\\\\') || '\"'" for c in vocab.PUBLIC_COLUMNS
        )
        + ") || '}' AS fields FROM p"
    ),
    "destination_list": (
        "SELECT s_suppkey, CAST(0 AS BIGINT) AS position, CASE WHEN s_suppkey % 5 = 0 THEN '127.0.0.1' "
        "ELSE 's' || s_suppkey || '.example' END AS destination FROM supplier UNION ALL "
        "SELECT s_suppkey, 1, '10.0.0.' || s_suppkey % 250 FROM supplier WHERE s_suppkey % 5 <> 0"
    ),
    "fan_out": (
        f"{_P} SELECT msg_id, {_CORE} AS message, destination FROM p, (SELECT trim(unnest("
        f"string_split('{DESTINATIONS}', ','))) AS destination)"
    ),
    "collector_delivery": (
        f"{_TRAFFIC}, {_SESSIONS}, {_DELIVERED} SELECT msg_id, collector_id FROM d"
    ),
    "delivery_stats": (
        f"{_LOG} SELECT vector, count(*) FILTER (ok) AS sent, count(*) FILTER (NOT ok) AS failed "
        "FROM log GROUP BY vector"
    ),
    "logical_delivery": (
        f"{_LOG} SELECT count(*) FILTER (ok) AS messages_sent, count(*) FILTER (NOT ok) AS messages_failed "
        "FROM (SELECT msg_id, bool_or(ok) AS ok FROM log GROUP BY msg_id)"
    ),
    "collector_stats": (
        f"{_TRAFFIC}, {_SESSIONS}, {_DELIVERED} SELECT 'output_server' AS component, metric, value FROM ("
        "SELECT 'collectors_total' AS metric, count(*) FILTER (allowed) AS value FROM ses "
        "UNION ALL SELECT 'collectors_rejected_ip', count(*) FILTER (NOT allowed) FROM ses "
        "UNION ALL SELECT 'collectors_connected', count(*) FILTER (allowed AND t0 <= 1704067205000000 "
        "AND 1704067205000000 < t1) FROM ses "
        "UNION ALL SELECT 'messages_sent', count(*) FILTER (msg_id % 10 <> 0) FROM d "
        "UNION ALL SELECT 'messages_dropped', count(*) FILTER (msg_id % 10 = 0) FROM d)"
    ),
    "stats_snapshot": (
        f"{_TRAFFIC} SELECT 'parser' AS component, 'total' AS metric, count(*) AS value FROM k "
        "UNION ALL SELECT 'parser', 'parsed', count(*) FILTER (e % 43 <> 0) FROM k "
        "UNION ALL SELECT 'parser', 'failed', count(*) FILTER (e % 43 = 0) FROM k "
        "UNION ALL SELECT 'formatter', 'formatted', count(*) FILTER (e % 43 <> 0) FROM k "
        "UNION ALL SELECT 'formatter', 'skipped', 0 "
        "UNION ALL SELECT 'receiver', 'messages_received', count(*) FILTER "
        "(client_ip IN ('10.10.0.1', '10.10.0.4') AND e % 19 <> 0) FROM capped "
        "UNION ALL SELECT 'receiver', 'connections_rejected_ip', count(*) FILTER "
        "(client_ip NOT IN ('10.10.0.1', '10.10.0.4')) FROM capped "
        "UNION ALL SELECT 'forwarder', 'messages_sent', count(*) FILTER (e % 18 <> 0) FROM k "
        "UNION ALL SELECT 'forwarder', 'messages_failed', count(*) FILTER (e % 18 = 0) FROM k"
    ),
    "count_by_source": (
        f"{_P} SELECT src AS key, count(*) AS messages FROM p WHERE src IS NOT NULL GROUP BY src"
    ),
    "count_by_port": f"{_P} SELECT dport AS key, count(*) AS messages FROM p GROUP BY dport",
    "count_by_action": f"{_P} SELECT action AS key, count(*) AS messages FROM p GROUP BY action",
    "pattern_extract": (
        f"{_P} SELECT msg_id, proto AS protocol, src AS source_address, dst AS destination_address, "
        "sport AS source_port, dport AS destination_port, action, "
        "replace(app, ' ', '_') AS application, hostname AS device_name FROM p WHERE src IS NOT NULL"
    ),
    "delivery_truncate": (
        "SELECT doc_id, length(x) AS chars, md5(x) AS digest FROM (SELECT doc_id, CASE WHEN "
        f"strlen(text) > 8192 THEN rtrim(substring(text, 1, 8192), {_BLANKS}) ELSE text END AS x "
        "FROM documents)"
    ),
    "encrypt_roundtrip": f"{_P} SELECT msg_id, {_CORE} AS message FROM p",
    "format_unknown_mode": f"{_P} SELECT msg_id, {_CEF} AS message FROM p",
    "dead_letters_session": (
        f"WITH {_KEYED} SELECT 'no_recognized_fields' AS reason, 'garbage line ' || e AS raw FROM k WHERE e % 43 = 0"
    ),
    "decode_lines": (
        "SELECT doc_id, length(x) AS chars, md5(x) AS digest FROM (SELECT doc_id, trim("
        "substr(t, 1, length(t) // 2) || ["
        + ", ".join(" || ".join(f"chr({ord(c)})" for c in shown) or "''" for _, shown in fx.BROKEN)
        + f"][doc_id % {len(fx.BROKEN)} + 1] || substr(t, length(t) // 2 + 1), {_BLANKS}) AS x "
        "FROM (SELECT doc_id, translate(text, chr(13) || chr(10), '  ') AS t FROM documents)) WHERE x <> ''"
    ),
    "limit_cef": (
        f"{_EVENTS}, p AS (SELECT e AS msg_id, 'TCP' AS proto, 'permit' AS action, '(8)Session created' AS event, "
        "repeat('p', CASE WHEN e % 97 = 0 THEN 65000 + e % 1000 ELSE e % 50 + 1 END) AS policy_name FROM k), "
        "m AS (SELECT msg_id, substr('CEF:0|H3C|Comware|7.0|SESSION_CREATED|Session Permitted|3|' || concat_ws(' ', "
        + ", ".join(_cef_parts({"proto", "action", "event", "policy_name"}))
        + "), 1, 65536) AS x FROM p) SELECT msg_id, length(x) AS chars, md5(x) AS digest FROM m"
    ),
    "limit_envelope": (
        f"{_EVENTS} SELECT e AS msg_id, '<134>' || substr('2026-03-13 10:24:05' || repeat('+', e % 90), 1, 64) || ' ' "
        "|| substr('h' || repeat('x', 200 + e % 100), 1, 253) || ' h3c-translator: proto=TCP sport=5 action=unknown' AS syslog FROM k"
    ),
    "limit_system": (
        f"{_EVENTS} SELECT e AS msg_id, repeat('u', least(128, 100 + e % 60)) AS \"user\", "
        "repeat('c', least(200, 150 + e % 100)) AS command, 'SHELL/6/SHELL_CMD: ' || substr("
        "'-Line=vty0-IPAddr=10.0.0.1-User=' || repeat('u', 100 + e % 60) || '; Command is ' || repeat('c', 150 + e % 100), 1, 200) AS event FROM k"
    ),
    "many_unknown_fields": (
        f"{_EVENTS} SELECT e AS msg_id, CASE WHEN e % 7 = 0 THEN '2' ELSE '9' END AS sport, "
        "CAST(3 + CASE WHEN e % 5 IN (0, 2) THEN 1 ELSE 0 END AS BIGINT) AS n, 'c' || e AS foo, 'b=c' AS bar, '' AS baz, "
        "CASE WHEN e % 5 = 0 THEN '1' END AS odd, CASE WHEN e % 5 = 2 THEN 'w' END AS wide FROM k"
    ),
    "bulk_too_large": (
        f"{_EVENTS} SELECT e AS request_id, CAST(CASE WHEN e % 499 = 0 THEN 413 ELSE 200 END AS BIGINT) AS status, "
        "CAST(CASE WHEN e % 499 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n FROM k WHERE e % 10 < 9"
    ),
}
