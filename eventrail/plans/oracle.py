"""SQL twins of the queries.

They state the expected result on the plain columns of the sample tables and never
parse the derived JSON, so they check the Spark side independently.
"""

from __future__ import annotations

# What the standard rules allow, stated here on their own.
PLATFORMS = ["ios", "android", "harmony", "wechat", "toutiao", "tiktok"]
CURRENCIES = [
    "JPY", "EUR", "BRL", "HKD", "TWD", "COP", "MXN", "CHF", "CAD", "CLP", "AUD", "PEN", "GBP",
    "CRC", "PLN", "PYG", "BOB", "QAR", "ILS", "SEK", "RUB", "CNY", "USD", "ZAR", "SGD", "NZD",
    "BGN", "LKR", "IQD", "TRY", "AED", "DZD", "EGP", "IDR", "INR", "NGN", "NOK", "PHP", "PKR",
    "THB", "UAH", "VND",
]
_PLATFORM_LIST = ", ".join(PLATFORMS)
_CURRENCY_LIST = ", ".join(CURRENCIES)

_EVENTS = r"""
ev AS (
  SELECT event_id AS e, user_id AS u, value, event_type, epoch_us(ts) // 1000 AS ms,
    CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k,
    CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'payment'
      WHEN 'view' THEN 'startup' WHEN 'click' THEN 'levelup' ELSE 'custom_event' END AS xwhat,
    CASE event_id % 6 WHEN 0 THEN 'iOS' WHEN 1 THEN 'android' WHEN 2 THEN 'harmony'
      WHEN 3 THEN 'wechat' WHEN 4 THEN 'tiktok' ELSE 'symbian' END AS os
  FROM events)"""

_BODY = r"""
body AS (
  SELECT *, CASE WHEN e % 97 = 0 THEN substr(whole, 1, 20) ELSE whole END AS body FROM (
    SELECT *, '{' || concat_ws(',',
        CASE WHEN e % 29 <> 0 THEN '"appid":"app_' || (u % 4) || '"' END,
        '"xcontext":{' || concat_ws(',',
          CASE WHEN xwhat = 'payment' THEN '"currencyamount":' || value END,
          CASE WHEN xwhat = 'payment' THEN '"currencytype":"' ||
            CASE WHEN e % 13 = 0 THEN 'XYZ' ELSE 'USD' END || '"' END,
          CASE WHEN os = 'iOS' AND e % 5 <> 0 THEN '"idfa":"idfa-' || e || '"' END,
          CASE WHEN e % 11 = 0 THEN '"installid":""' ELSE '"installid":"iid-' || e || '"' END,
          CASE WHEN xwhat = 'levelup' THEN '"level":' || (k % 3) END,
          CASE WHEN os IN ('android', 'harmony') THEN
            CASE WHEN e % 4 = 0 THEN '"oaid":""' ELSE '"oaid":"oaid-' || e || '"' END END,
          CASE WHEN os IN ('wechat', 'tiktok') AND e % 5 <> 0 THEN '"openid":"open-' || e || '"' END,
          '"os":"' || os || '"',
          CASE WHEN xwhat = 'payment' AND e % 3 = 0 THEN '"paymentstatus":true' END,
          CASE WHEN xwhat = 'payment' THEN '"paymenttype":"card"' END,
          CASE WHEN xwhat = 'payment' THEN '"transactionid":"tx-' || e || '"' END
        ) || '}',
        '"xwhat":"' || xwhat || '"',
        '"xwhen":' || ms,
        CASE WHEN e % 7 <> 0 THEN '"xwho":"u' || u || '"' END
      ) || '}' AS whole
    FROM ev))"""

_VERDICT = rf"""
verdict AS (
  SELECT *, CASE
    WHEN e % 97 = 0 THEN 'bad json'
    WHEN os = 'symbian' THEN 'field `xcontext.os` must be one of [{_PLATFORM_LIST}]'
    WHEN e % 29 = 0 THEN 'missing required field `appid`'
    WHEN e % 11 = 0 THEN 'field `xcontext.installid` length must be at least 1'
    WHEN os = 'iOS' AND e % 5 = 0
      THEN 'at least one field is required: xcontext.idfa, xcontext.caid'
    WHEN os IN ('android', 'harmony') AND e % 4 = 0
      THEN 'at least one field is required: xcontext.oaid, xcontext.androidid'
    WHEN os = 'wechat' AND e % 5 = 0
      THEN 'at least one field is required: xcontext.openid, xcontext.unionid'
    WHEN os = 'tiktok' AND e % 5 = 0 THEN 'missing required field `xcontext.openid`'
    WHEN xwhat IN ('register', 'payment', 'levelup') AND e % 7 = 0
      THEN 'missing required field `xwho`'
    WHEN xwhat = 'payment' AND e % 13 = 0
      THEN 'field `xcontext.currencytype` must be one of [{_CURRENCY_LIST}]'
    WHEN xwhat = 'levelup' AND k % 3 = 0 THEN 'field `xcontext.level` must be greater than 0'
    ELSE 'ok' END AS verdict
  FROM body)"""

_PROJECTS = """
proj AS (
  SELECT c_custkey AS id, 'tok-' || c_custkey AS token, 'p-' || c_custkey AS project_key,
    CASE WHEN c_custkey % 4 = 0 THEN 'public' ELSE 'token' END AS auth_mode,
    c_custkey % 5 = 0 AS restricted, c_custkey % 7 <> 6 AS enabled
  FROM customer)"""

_SCRIPTS = """
script AS (
  SELECT p_partkey AS id,
    ['default', 'strict', 'lost', 'loadtest', 'enrichment'][(p_partkey % 5) + 1] AS script_key,
    p_partkey % 11 <> 0 AS active
  FROM part),
bound AS (
  SELECT o_custkey AS project_id, arg_max(script_key, o_orderkey) AS script_key
  FROM orders JOIN script ON script.id = o_orderkey % (SELECT max(p_partkey) + 1 FROM part)
  WHERE o_custkey % 4 <> 3 AND o_orderkey % 3 <> 0 AND active GROUP BY 1),
chosen AS (
  SELECT proj.id AS project_id, coalesce(bound.script_key, 'default') AS script_key
  FROM proj LEFT JOIN bound ON bound.project_id = proj.id WHERE proj.enabled)"""

_SINK_ID = """'sink' || CASE WHEN {s} % 2 = 0 THEN '-' ELSE '_.' END || ({s} - {s} % 3) ||
    CASE {s} % 3 WHEN 1 THEN '-' WHEN 2 THEN 'x' ELSE '' END"""

_SINKS = f"""
target AS (SELECT n_nationkey AS id, n_name AS target_id, n_nationkey % 4 <> 3 AS enabled FROM nation),
sink AS (
  SELECT {_SINK_ID.format(s="s_suppkey")} AS sink_id, s_nationkey AS target_key,
    CASE WHEN s_suppkey % 50 = 49 THEN 'earliest' ELSE 'latest' END AS auto_offset_reset,
    s_suppkey % 6 <> 5 AS enabled
  FROM supplier),
runtime AS (
  SELECT sink_id, target.target_id, auto_offset_reset FROM sink
  JOIN target ON target.id = sink.target_key WHERE sink.enabled AND target.enabled)"""

# Expected outcome of every request, from its columns alone.
_REQUESTS = r"""
req AS (
  SELECT ev.*,
    CASE WHEN e % 20 = 0 THEN 'PUT' WHEN e % 20 < 4 THEN 'GET' ELSE 'POST' END AS method,
    e % 4 = 1 AS is_form,
    CASE WHEN e % 3 = 0 THEN NULL WHEN e % 10 = 7 THEN 'other' ELSE 'tok-' || u END AS sent_token,
    CASE WHEN e % 3 <> 1 THEN 'tok-' || u END AS header_token,
    CASE WHEN e % 31 = 0 THEN 'nope' ELSE 'p-' || u END AS key,
    '10.0.0.' || (e % 4) AS ip
  FROM ev),
dec AS (
  SELECT *, CASE WHEN method = 'GET' THEN 'query' WHEN method = 'PUT' OR e % 23 = 0 THEN NULL
      WHEN is_form THEN 'form' ELSE 'json' END AS decoder,
    CASE WHEN method = 'PUT' THEN 'ingest_method_not_allowed'
      WHEN method = 'POST' AND e % 23 = 0 THEN 'ingest_missing_request_body'
      WHEN method = 'POST' AND NOT is_form AND e % 29 = 0 THEN 'ingest_invalid_json'
      WHEN method = 'GET' AND e % 40 = 1 THEN 'ingest_query_token_not_supported' END AS decode_issue,
    CASE WHEN method = 'POST' AND e % 23 <> 0
      AND (is_form OR e % 29 <> 0) THEN sent_token END AS body_token
  FROM req),
outcome AS (
  SELECT dec.*, proj.id AS project_id, CASE
      WHEN decode_issue IS NOT NULL THEN decode_issue
      WHEN proj.id IS NULL THEN 'ingest_project_not_found'
      WHEN restricted AND ip NOT IN ('10.0.0.1', '10.0.0.3') THEN 'ingest_ip_not_allowed'
      WHEN auth_mode = 'public' THEN NULL
      WHEN header_token <> body_token THEN 'ingest_conflicting_token'
      WHEN coalesce(header_token, body_token) IS NULL THEN 'ingest_missing_token'
      WHEN coalesce(header_token, body_token) <> proj.token THEN 'ingest_invalid_token'
    END AS issue,
    CASE decoder
      WHEN 'query' THEN '{"b":"你","n":"' || e || '","xwhat":"' || xwhat || '"}'
      WHEN 'form' THEN '{"n":"' || (e + 1) || '","name":"a b c%zz","xwhat":"' || xwhat || '"}'
      WHEN 'json' THEN '{"n":' || e || ',"v":' || value || ',"xwhat":"' || xwhat || '"}'
    END AS event_text
  FROM dec LEFT JOIN proj ON proj.project_key = dec.key AND proj.enabled)"""

_NODES = """
numbered AS (
  SELECT e, ms, 'node-' || (u % 3) AS node_id,
    row_number() OVER (PARTITION BY u % 3 ORDER BY e) AS lsn FROM ev),
bounds AS (
  SELECT node_id, min(lsn) AS floor_lsn, max(lsn) AS tail_lsn FROM numbered GROUP BY 1),
cp AS (SELECT node_id, tail_lsn // 3 AS checkpoint_lsn FROM bounds WHERE node_id <> 'node-2'),
starts AS (
  SELECT b.node_id, floor_lsn, tail_lsn, checkpoint_lsn, CASE
      WHEN checkpoint_lsn >= floor_lsn - 1 THEN checkpoint_lsn
      WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 50 = 49) THEN 0
      ELSE tail_lsn END AS start_lsn
  FROM bounds b LEFT JOIN cp ON cp.node_id = b.node_id)"""

_BROKEN = """
kept AS (
  SELECT 'node-' || (event_id % 4) AS node_id, event_id // 4 + 1 AS lsn FROM events
  WHERE NOT ((event_id % 4 = 1 AND (event_id // 4 + 1) % 50 = 0)
    OR (event_id % 4 = 2 AND event_id // 4 + 1 IN (40, 41)))),
gaps AS (
  SELECT node_id, previous + 1 AS expected_lsn, lsn AS actual_lsn FROM (
    SELECT *, lag(lsn) OVER (PARTITION BY node_id ORDER BY lsn) AS previous FROM kept)
  WHERE lsn <> previous + 1
  QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY lsn) = 1)"""

# Records of the log under the default processor.
_DEFAULT = """
plan AS (
  SELECT verdict.*, CASE WHEN verdict = 'bad json' THEN 'replay_invalid_json_body'
      WHEN proj.id IS NULL THEN 'replay_unknown_project' END AS code,
    CASE WHEN verdict = 'ok' THEN 'events' ELSE 'events_error' END AS sink_id,
    e + 1 AS lsn
  FROM verdict LEFT JOIN proj ON proj.id = u AND proj.enabled),
delivery AS (SELECT * FROM plan WHERE code IS NULL)"""

# Records of the log under each project's own processor.
_CHOSEN = """
own AS (
  SELECT verdict.*, script_key, e + 1 AS lsn, CASE
      WHEN verdict = 'bad json' THEN 'replay_invalid_json_body'
      WHEN script_key IS NULL THEN 'replay_unknown_project'
      WHEN script_key = 'strict' AND (e % 29 = 0 OR e % 7 = 0) THEN 'replay_processor_runtime_failed'
      WHEN script_key = 'lost' AND xwhat = 'startup' THEN 'replay_unknown_sink_target' END AS code,
    CASE WHEN script_key IN ('strict', 'lost') THEN 'events'
      WHEN script_key = 'loadtest' THEN 'loadtest_events'
      WHEN script_key = 'enrichment' THEN
        CASE WHEN e % 29 = 0 OR e % 11 = 0 THEN 'events_error' ELSE 'events' END
      WHEN verdict = 'ok' THEN 'events' ELSE 'events_error' END AS sink_id
  FROM verdict LEFT JOIN chosen ON chosen.project_id = u)"""

_TYPED = """
typed AS (
  SELECT e AS event_id, event_type, e % 10 <> 9 AS has, CASE WHEN e % 10 = 9 THEN -1 ELSE e % 7 END AS t
  FROM ev)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def _type_error(name: str, good: str) -> str:
    column = f"{name}_error"
    word = name.capitalize()
    return (
        f"CASE WHEN t NOT IN (-1, 6, {good}) THEN 'field `v` expected type `{word}`' END AS {column}"
    )


def _limit_error(name: str, holds: str, words: str, text: str) -> str:
    return (
        f"CASE WHEN e % 5 = 0 THEN {text} WHEN NOT (e % 100 {holds}) "
        f"THEN 'field `n` must be {words}' END AS {name}_error"
    )


_NO_NUMBER = "'field `n` could not be represented as f64'"
_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
_BUCKET_ROWS = ", ".join(f"('{b}', CAST({b} AS DOUBLE))" for b in _BUCKETS)

# Greedy batches of one sink and window, one delivery per step.
_GREEDY = """
item AS (
  SELECT sink_id, (lsn - 1) // 500 AS window_id, lsn, CAST(strlen(body) AS BIGINT) AS bytes,
    row_number() OVER (PARTITION BY sink_id, (lsn - 1) // 500 ORDER BY lsn) AS n,
    {max_events} AS max_events, {max_bytes} AS max_bytes
  FROM delivery),
walk AS (
  SELECT sink_id, window_id, lsn, n, 0 AS chunk, CAST(1 AS BIGINT) AS events, bytes FROM item WHERE n = 1
  UNION ALL
  SELECT i.sink_id, i.window_id, i.lsn, i.n,
    CASE WHEN w.events >= i.max_events OR w.bytes + i.bytes > i.max_bytes
      THEN w.chunk + 1 ELSE w.chunk END,
    CASE WHEN w.events >= i.max_events OR w.bytes + i.bytes > i.max_bytes
      THEN 1 ELSE w.events + 1 END,
    CASE WHEN w.events >= i.max_events OR w.bytes + i.bytes > i.max_bytes
      THEN i.bytes ELSE w.bytes + i.bytes END
  FROM walk w JOIN item i ON i.sink_id = w.sink_id AND i.window_id = w.window_id AND i.n = w.n + 1),
batch AS (
  SELECT sink_id, window_id, chunk, min(lsn) AS first_lsn, max(lsn) AS last_lsn,
    max(events) AS events, max(bytes) AS bytes,
    'node-node-a-lsn-' || lpad(CAST(min(lsn) AS VARCHAR), 16, '0') || '-' ||
      lpad(CAST(max(lsn) AS VARCHAR), 16, '0') || '-' || lpad(CAST(chunk AS VARCHAR), 4, '0') AS batch_name
  FROM walk GROUP BY sink_id, window_id, chunk)"""

_REPLAY = (_EVENTS, _BODY, _VERDICT, _PROJECTS, _DEFAULT)
_OWN = (_EVENTS, _BODY, _VERDICT, _PROJECTS, _SCRIPTS, _CHOSEN)
_ADMIT = (_EVENTS, _PROJECTS, _REQUESTS)

_MESSAGE = """CASE code WHEN 'replay_invalid_json_body' THEN 'invalid wal record json body'
    ELSE 'wal record references unknown project `' || u || '`' END"""
_DOC_JSON = """'{"doc_id":' || doc_id || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}'"""
_ORDER_DAY = """o AS (
  SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%-m-%-d')
      WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y-%m-') || '30'
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
    o_orderkey % 5 = 0 AND (month(o_orderdate) < 10 OR day(o_orderdate) < 10)
      OR (o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 AND month(o_orderdate) = 2) AS bad_day,
    o_orderkey % 26 > 23 AS bad_time
  FROM orders)"""

ORACLE_SQL: dict[str, str] = {
    "s_decode_requests": _with(*_ADMIT) + """
SELECT e AS request_seq, decoder, decode_issue, body_token,
  CASE WHEN decode_issue IS NULL THEN event_text END AS event_text FROM outcome""",
    "v_date_formats": """
SELECT o_orderkey, o_orderkey % 3 <> 0 AS day_of_year, o_orderkey % 3 <> 0 AS named_month,
  o_orderkey % 3 <> 0 AS american, o_orderkey % 16 BETWEEN 1 AND 12 AS half_day FROM orders""",
    "p_created_containers": """
SELECT event_id + 1 AS lsn, CASE (event_id + 1) % 5
  WHEN 2 THEN '{"made":{"deep":{"value":"POST"},"kept":1}}'
  WHEN 3 THEN 'cannot set field `made.deep.value` on a value that is no object'
  WHEN 4 THEN 'cannot set field `made.deep.value` on a value that is no object'
  ELSE '{"made":{"deep":{"value":"POST"}}}' END AS outcome FROM events""",
    "k_batched_parquet": _with(*_REPLAY) + """
, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY e // 1000 ORDER BY e) AS n FROM delivery WHERE sink_id = 'events'),
cut AS (SELECT *, (n - 1) // 300 AS chunk FROM numbered)
SELECT printf('node-node-a-lsn-%016d-%016d-%04d', min(e) + 1, max(e) + 1, chunk) AS batch_name,
  count(*) AS events, CAST(sum(ms) AS BIGINT) AS sent_at_sum FROM cut GROUP BY e // 1000, chunk""",
    "v_regex_dialect": """
SELECT event_id, w IN (0, 6) AS alpha, w NOT IN (4, 5) AS not_digit, w = 1 AS greek, w = 2 AS han,
  w IN (3, 6) AS upper, w = 4 AS word_end, w IN (0, 6) AS folded
FROM (SELECT event_id, event_id % 7 AS w FROM events)""",
    "v_regex_long": r"""
SELECT doc_id, regexp_matches(s, '^(x|y)+$') AS pairs,
  regexp_matches(s, '^(?:[\pL''-]+[ .,;:!?\n]*|[^\pL])*$') AS prose,
  regexp_matches(s, '(?:\p{Lu}\p{Ll}+ )+\p{Ll}+\.') AS capitals,
  regexp_matches(s, '(a|aa)+(e|ee)+[rst]+[ ,]') AS doubled,
  regexp_matches(s, '[a-z0-9._]+@[a-z0-9.]+\.[a-z]+') AS mail,
  regexp_matches(s, '(?i)licen[cs]e(?:.|\n)*(?:copy|warrant)[a-z]*') AS licensed,
  regexp_matches(s, '^(?:.*\n)+.*$') AS lines,
  regexp_matches(s, '^(?:[^ ]+ ){5,9}[^ ]+$') AS words
FROM (SELECT doc_id, coalesce(text, '') AS s FROM documents UNION ALL SELECT -1, repeat('xy', 131072))""",
    "v_json_equality": """
SELECT event_id, w = 0 AS ints, w = 1 AS floats, w = 2 AS nested, w = 4 AS one, w = 5 AS one_float, w = 6 AS empty
FROM (SELECT event_id, event_id % 10 AS w FROM events)""",
    "q_non_objects": """
SELECT CASE p WHEN 0 THEN 'emits' WHEN 1 THEN 'branches' WHEN 2 THEN 'checks' WHEN 3 THEN 'sets' ELSE 'catches' END AS script,
  outcome, count(*) AS records FROM (
  SELECT p, unnest(CASE
    WHEN p = 0 THEN ['events']
    WHEN p = 1 AND obj THEN ['events', 'events_error']
    WHEN p IN (2, 3, 4) AND obj THEN ['events']
    WHEN p = 4 THEN ['events_error']
    ELSE ['replay_processor_runtime_failed: event is not an object'] END) AS outcome
  FROM (SELECT (event_id + 1) % 5 AS p, (event_id + 1) % 6 = 5 AS obj FROM events))
GROUP BY ALL""",
    "s_decode_spelling": """
SELECT event_id AS request_seq,
  CASE WHEN event_id % 22 = 0 THEN 'ingest_invalid_form' END AS decode_issue,
  CASE WHEN event_id % 22 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'f'
    WHEN event_id % 7 = 5 THEN 'tok-' || event_id END AS body_token,
  CASE WHEN event_id % 22 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '{"a":"1"}' ELSE
    '{"a":"last ' || event_id || '","in":{"b":[2.0,3],"x-ingest-token":"kept 1.0"},"z":' ||
    CASE event_id % 5
      WHEN 0 THEN n || '.0' WHEN 1 THEN n || '.5' WHEN 2 THEN (n * 1000) || '.0'
      WHEN 3 THEN '-' || (n * 10 + 2) || '.5' ELSE CAST(n AS VARCHAR) END || '}' END AS event_text
FROM (SELECT event_id, event_id % 100 AS n FROM events)""",
    "s_query_strings": """
WITH pairs AS (
  SELECT page_id, i, split_part(p, '=', 1) AS k,
    replace(CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END, '+', ' ') AS v
  FROM (SELECT page_id, unnest(string_split(substr(url, strpos(url, '?') + 1), '&')) AS p,
      generate_subscripts(string_split(substr(url, strpos(url, '?') + 1), '&'), 1) AS i
    FROM pages WHERE contains(url, '?')) WHERE p <> ''),
last AS (SELECT page_id, k, arg_max(v, i) AS v FROM pairs GROUP BY 1, 2)
SELECT pages.page_id, coalesce('{' || string_agg('"' || url_decode(k) || '":"' || url_decode(v) || '"',
  ',' ORDER BY k) || '}', '{}') AS event_text
FROM pages LEFT JOIN last ON last.page_id = pages.page_id GROUP BY pages.page_id""",
    "s_log_scan": _with(_EVENTS, _BODY) + """
SELECT 'node-a' AS node_id, e + 1 AS lsn, 'wal-' || ms || '-' || e AS record_id, body FROM body""",
    "s_log_after_checkpoint": _with(_EVENTS, _NODES) + """
SELECT n.node_id, lsn, 'wal-' || e || '-' || e AS record_id
FROM numbered n JOIN starts s ON s.node_id = n.node_id
WHERE lsn > start_lsn AND lsn <= start_lsn + 100""",
    "s_log_bounds": _with(_EVENTS, _NODES) + "\nSELECT * FROM bounds",
    "s_start_positions": _with(_EVENTS, _NODES) + "\nSELECT * FROM starts",
    "s_enabled_config": _with(_PROJECTS) + """
SELECT id AS project_id, project_key, auth_mode,
  CASE WHEN restricted THEN '10.0.0.1,10.0.0.3' ELSE '' END AS ips FROM proj WHERE enabled""",
    "a_issue_counts": _with(*_ADMIT) + """
SELECT coalesce(issue, 'admitted') AS issue, count(*) AS requests FROM outcome GROUP BY 1""",
    "a_rejections": _with(*_ADMIT) + """
SELECT e AS request_seq, key AS project_key, issue AS issue_code,
  CASE issue WHEN 'ingest_method_not_allowed' THEN 405 WHEN 'ingest_project_not_found' THEN 404
    WHEN 'ingest_missing_request_body' THEN 400 WHEN 'ingest_query_token_not_supported' THEN 400
    WHEN 'ingest_invalid_json' THEN 400 WHEN 'ingest_ip_not_allowed' THEN 403
    ELSE 401 END AS status,
  CASE issue WHEN 'ingest_method_not_allowed' THEN '' WHEN 'ingest_project_not_found' THEN 'project not found'
    WHEN 'ingest_missing_request_body' THEN 'missing request body'
    WHEN 'ingest_query_token_not_supported' THEN 'query ingest token is not supported'
    WHEN 'ingest_invalid_json' THEN 'invalid json payload' WHEN 'ingest_ip_not_allowed' THEN 'ip not allowed'
    WHEN 'ingest_conflicting_token' THEN 'conflicting ingest token'
    WHEN 'ingest_missing_token' THEN 'missing ingest token'
    ELSE 'invalid ingest token' END AS message
FROM outcome WHERE issue IS NOT NULL""",
    "a_admitted_log": _with(*_ADMIT) + """
SELECT 'node-' || (u % 3) AS node_id,
  row_number() OVER (PARTITION BY u % 3 ORDER BY ms, e) AS lsn, 'wal-' || ms || '-' || e AS record_id,
  CAST(project_id AS INTEGER) AS project_id, method, 1 AS headers, event_text AS body
FROM outcome WHERE issue IS NULL""",
    "a_size_cap": """
SELECT doc_id AS request_seq, CASE WHEN strlen('{"doc_id":' || doc_id || ',"lang":"' || lang ||
    '","text":' || CAST(to_json(text) AS VARCHAR) || '}') > 8192
  THEN 'ingest_payload_too_large' END AS issue_code, 'default' AS event_name FROM documents""",
    "v_default_rules": _with(_EVENTS, _BODY, _VERDICT) + "\nSELECT e + 1 AS lsn, verdict FROM verdict",
    "v_default_rule_counts": _with(_EVENTS, _BODY, _VERDICT) + """
SELECT CASE verdict WHEN 'ok' THEN 'events' WHEN 'bad json' THEN 'quarantine' ELSE 'events_error' END
  AS target, verdict, count(*) AS records FROM verdict GROUP BY 1, 2""",
    "v_rule_book": _with(_EVENTS) + f"""
SELECT e + 1 AS lsn, CASE
  WHEN e % 29 = 0 THEN 'missing required field `appid`'
  WHEN os = 'symbian' THEN 'field `xcontext.os` must be one of [{_PLATFORM_LIST}]'
  WHEN os = 'iOS' AND e % 5 = 0 THEN 'at least one field is required: xcontext.idfa, xcontext.caid'
  WHEN os IN ('android', 'harmony') AND e % 4 = 0
    THEN 'at least one field is required: xcontext.oaid, xcontext.androidid'
  WHEN os = 'wechat' AND e % 5 = 0
    THEN 'at least one field is required: xcontext.openid, xcontext.unionid'
  WHEN os = 'tiktok' AND e % 5 = 0 THEN 'missing required field `xcontext.openid`'
  WHEN xwhat IN ('register', 'payment', 'levelup') AND e % 7 = 0 THEN 'missing required field `xwho`'
  WHEN xwhat = 'payment' AND e % 13 = 0
    THEN 'field `xcontext.currencytype` must be one of [{_CURRENCY_LIST}]'
  WHEN xwhat = 'levelup' AND k % 3 = 0 THEN 'field `xcontext.level` must be greater than 0'
  ELSE 'ok' END AS verdict FROM ev WHERE e % 97 <> 0""",
    "v_error_codes": _with(_EVENTS, _BODY, _VERDICT) + """
SELECT CASE WHEN verdict LIKE 'missing required%' THEN 'rules_required_field_missing'
    WHEN verdict LIKE 'at least one%' THEN 'rules_conditional_required_missing'
    WHEN verdict LIKE '%one of [%' THEN 'rules_enum_value_invalid'
    WHEN verdict LIKE '%greater than%' THEN 'rules_number_constraint_failed'
    ELSE 'rules_script_execution_failed' END AS code, count(*) AS records
FROM verdict WHERE verdict NOT IN ('ok', 'bad json') GROUP BY 1""",
    "v_value_types": _with(_EVENTS, _TYPED) + "\nSELECT event_id, " + ", ".join([
        _type_error("string", "0"), _type_error("number", "1, 2"), _type_error("integer", "1"),
        _type_error("boolean", "3"), _type_error("object", "4"), _type_error("array", "5"),
    ]) + " FROM typed",
    "v_required_fields": _with(_EVENTS, _TYPED) + """
SELECT event_id, CASE WHEN t IN (-1, 6) THEN 'missing required field `v`' END AS required_error,
  CASE WHEN t IN (-1, 6) THEN 'at least one field is required: v, w' END AS any_error,
  CAST(NULL AS VARCHAR) AS optional_error FROM typed""",
    "v_predicates": _with(_EVENTS, _TYPED) + """
SELECT event_id, t = 0 AND event_type = 'purchase' AS is_purchase,
  t = 0 AND event_type = 'purchase' AS is_purchase_folded, t = 1 AND event_id = 8 AS is_eight,
  t = 2 AND event_id = 9 AS is_nine_float, t = 3 AS is_true, t = 5 AND event_id = 5 AS is_list,
  t = 6 AS is_null, t NOT IN (-1, 6) AS present, t IN (-1, 6) AS absent, has AS has_key,
  (t = 0 AND event_type = 'view') OR t = 3 AS either FROM typed""",
    "v_field_values": _with(_EVENTS, _TYPED) + """
SELECT event_id, CASE t WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN event_id || ''
  WHEN 2 THEN event_id || '' WHEN 3 THEN 'true' WHEN 4 THEN '{"a":' || event_id || '}'
  WHEN 5 THEN '[' || event_id || ']' WHEN 6 THEN 'null' END AS value FROM typed""",
    "v_number_limits": _with(_EVENTS) + "\nSELECT e AS event_id, " + ", ".join([
        _limit_error("gt", "> 50", "greater than 50", _NO_NUMBER),
        _limit_error("gte", ">= 50.5", "greater than or equal to 50.5", _NO_NUMBER),
        _limit_error("lt", "< 25", "less than 25", _NO_NUMBER),
        _limit_error("lte", "<= 75", "less than or equal to 75", "'field `n` expected type `Number`'"),
    ]) + " FROM ev",
    "v_text_rules": """
SELECT doc_id,
  CASE WHEN length(text) < 1000 THEN 'field `text` length must be at least 1000' END AS length_error,
  CASE WHEN lang NOT IN ('en', 'fr') THEN 'field `lang` must be one of [en, fr]' END AS lang_error,
  CASE WHEN source NOT IN ('src0', 'src1')
    THEN 'field `source` must be one of [src0, src1]' END AS source_error,
  CASE WHEN lang NOT IN ('de', 'fr') THEN 'field `lang` must be one of [DE, Fr]' END AS one_of_error,
  CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 'field `text` must match regex `[0-9]`' END AS digit_error,
  CASE WHEN source NOT IN ('src0', 'src2')
    THEN 'field `source` must match regex `^src[02]$`' END AS start_error
FROM documents""",
    "v_temporal_rules": "WITH " + _ORDER_DAY + """
SELECT o_orderkey,
  CASE WHEN bad_day THEN 'field `d` must be a valid date matching format `%Y-%m-%d`' END AS date_error,
  CASE WHEN bad_time THEN 'field `t` must be a valid time matching format `%H:%M:%S`' END AS time_error,
  CASE WHEN bad_day OR bad_time THEN
    'field `dt` must be a valid datetime matching format `%Y-%m-%d %H:%M:%S`' END AS datetime_error
FROM o""",
    "p_loadtest_codes": _with(*_REPLAY) + """
SELECT lsn, 'loadtest_events' AS sink_id, CASE
    WHEN verdict = 'ok' THEN NULL WHEN verdict LIKE 'missing required%' THEN 'rules_required_field_missing'
    WHEN verdict LIKE 'at least one%' THEN 'rules_conditional_required_missing'
    WHEN verdict LIKE '%one of [%' THEN 'rules_enum_value_invalid'
    WHEN verdict LIKE '%greater than%' THEN 'rules_number_constraint_failed'
    ELSE 'rules_script_execution_failed' END AS validation_code FROM delivery""",
    "p_enriched_events": _with(*_REPLAY) + """
SELECT lsn, CASE WHEN reason IS NULL THEN 'events' ELSE 'events_error' END AS sink_id,
  CASE WHEN reason IS NULL THEN lower(os) ELSE os END AS os,
  CASE WHEN reason IS NULL THEN lower(os) END AS platform,
  CASE WHEN reason IS NULL AND e % 10 <> 9 THEN '10.0.0.' || (e % 256) END AS ip,
  CASE WHEN xwhat = 'payment' THEN CASE WHEN e % 13 = 0 THEN 'XYZ' ELSE 'USD' END END AS currencytype,
  ms || '' AS receive_time, reason, ms || '' AS xwhen
FROM (SELECT *, CASE WHEN e % 29 = 0 THEN 'missing required field `appid`'
    WHEN e % 11 = 0 THEN 'field `xcontext.installid` length must be at least 1' END AS reason
  FROM delivery)""",
    "p_request_values": _with(_EVENTS) + """
SELECT e + 1 AS lsn, CASE WHEN e % 10 <> 9 THEN '10.0.0.' || (e % 256) END AS ip, 'POST' AS method,
  '/ingest/p-' || u AS path, 'wal-' || ms || '-' || e AS request_id, ms AS received_at_ms,
  'ua-' || (u % 3) AS user_agent FROM ev""",
    "p_parquet_projection": _with(*_REPLAY) + """
SELECT lsn, CASE WHEN e % 29 <> 0 THEN 'app_' || (u % 4) END AS appid,
  CASE WHEN xwhat = 'payment' THEN value END AS amount,
  CASE WHEN xwhat = 'levelup' THEN CAST(k % 3 AS BIGINT) END AS level,
  CASE WHEN xwhat = 'payment' AND e % 3 = 0 THEN true END AS paid, ms AS sent_at,
  CAST(NULL AS VARCHAR) AS nothing, body AS event_json, CAST(NULL AS VARCHAR) AS violation
FROM delivery""",
    "p_projection_violations": _with(*_REPLAY) + """
SELECT lsn, CASE WHEN e % 7 = 0 THEN 'missing required parquet column `who`'
    WHEN os IN ('wechat', 'tiktok') AND e % 5 <> 0 THEN 'parquet column `openid` expected integer, got string'
    WHEN xwhat = 'payment' THEN 'parquet column `amount` expected integer, got number' END AS violation
FROM delivery""",
    "p_sink_constants": _with(_SINKS) + """,
named AS (SELECT sink_id, regexp_replace('SINK_' || regexp_replace(upper(sink_id), '[^A-Z0-9]+', '_', 'g'),
    '_+$', '') AS constant FROM sink WHERE enabled)
SELECT sink_id, constant, constant = 'SINK' AS is_empty,
  count(*) OVER (PARTITION BY constant) > 1 AS collides FROM named""",
    "p_project_keys": r"""
WITH n AS (SELECT url AS name FROM pages
  UNION ALL SELECT ' ' || p_name || '- ' || p_brand || '!' AS name FROM part)
SELECT name, nullif(trim(regexp_replace(trim(name), '[^A-Za-z0-9_-]+', '-', 'g'), '-'), '') AS project_key
FROM n""",
    "j_request_projects": _with(*_ADMIT) + """
SELECT project_id, count(*) AS requests FROM outcome GROUP BY 1""",
    "j_known_projects": _with(*_REPLAY) + """
SELECT CAST(u AS INTEGER) AS project_id, code IS NOT NULL AS unknown, count(*) AS records FROM plan
WHERE code IS NULL OR code <> 'replay_invalid_json_body' GROUP BY 1, 2""",
    "j_project_scripts": _with(_PROJECTS, _SCRIPTS) + "\nSELECT * FROM chosen",
    "j_runtime_sinks": _with(_SINKS) + """
SELECT sink_id, target_id, 'blackhole' AS target_type, auto_offset_reset FROM runtime""",
    "j_delivery_sinks": _with(_SINKS) + f""",
d AS (SELECT event_id + 1 AS lsn, CASE WHEN event_id % 37 = 0 THEN ' ' ELSE
    {_SINK_ID.format(s="(event_id % 120)")} END AS sink_id FROM events)
SELECT lsn, d.sink_id, CASE WHEN d.sink_id = ' ' THEN 'replay_empty_sink_target'
    WHEN r.sink_id IS NULL THEN 'replay_unknown_sink_target' END AS code
FROM d LEFT JOIN runtime r ON r.sink_id = d.sink_id""",
    "j_default_bindings": """
SELECT c_custkey AS project_id, (SELECT min(p_partkey) FROM part WHERE p_partkey % 5 = 0)
  AS processor_script_id, true AS enabled FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 4 <> 3)""",
    "j_dangling_sinks": _with(_SINKS) + """
SELECT sink_id, CAST(target_key AS BIGINT) AS delivery_target_id FROM sink WHERE enabled
  AND target_key NOT IN (SELECT id FROM target WHERE enabled)""",
    "q_replay_targets": _with(*_REPLAY) + """
SELECT sink_id, count(*) AS records FROM delivery GROUP BY 1""",
    "q_quarantine_codes": _with(*_OWN) + """
SELECT code, 'quarantine_record' AS action,
  CASE WHEN code <> 'replay_invalid_json_body' THEN xwhat END AS xwhat,
  CASE WHEN code = 'replay_unknown_sink_target' THEN 'nowhere' END AS target, count(*) AS total
FROM own WHERE code IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "q_quarantine_records": _with(*_REPLAY) + f"""
SELECT code, 'quarantine_record' AS action, 'wal-' || ms || '-' || e AS record_id, lsn,
  ms AS received_at_ms, '/ingest/p-' || u AS path,
  CASE WHEN code <> 'replay_invalid_json_body' THEN xwhat END AS xwhat, CAST(NULL AS VARCHAR) AS target,
  {_MESSAGE} AS message, code || ': ' || {_MESSAGE} AS error, to_base64(encode(body)) AS body_base64
FROM plan WHERE code IS NOT NULL""",
    "x_project_processors": _with(*_OWN) + """
SELECT CAST(u AS INTEGER) AS project_id, sink_id, count(*) AS records FROM own WHERE code IS NULL GROUP BY 1, 2""",
    "x_emit_snapshots": _with(*_REPLAY) + """
SELECT lsn, 0 AS seq, 'events' AS sink_id, xwhat, CAST(NULL AS VARCHAR) AS stage FROM delivery
UNION ALL SELECT lsn, 1, 'events_error', xwhat, 'late' FROM delivery WHERE xwhat = 'payment'
UNION ALL SELECT lsn, 2, 'loadtest_events', 'seen', 'late' FROM delivery""",
    "x_python_processor": _with(*_REPLAY) + """,
r AS (SELECT *, coalesce(code, CASE WHEN e % 29 = 0 THEN 'replay_processor_runtime_failed' END) AS fate FROM plan)
SELECT lsn, 'quarantine' AS sink_id, -1 AS seq, fate AS note FROM r WHERE fate IS NOT NULL
UNION ALL SELECT lsn, 'events', 0, NULL FROM r WHERE fate IS NULL
UNION ALL SELECT lsn, 'events_error', 1, 'ua-' || (u % 3) FROM r WHERE fate IS NULL AND xwhat = 'payment'""",
    "w_lsn_gaps": _with(_BROKEN) + "\nSELECT * FROM gaps",
    "w_before_gap": _with(_BROKEN) + """
SELECT kept.node_id, kept.lsn FROM kept LEFT JOIN gaps ON gaps.node_id = kept.node_id
WHERE expected_lsn IS NULL OR lsn < expected_lsn""",
    "w_replay_windows": """
SELECT event_id // 500 AS window_id, count(*) AS records, min(event_id) + 1 AS first_lsn,
  max(event_id) + 1 AS last_lsn FROM events GROUP BY 1""",
    "w_sink_batches": _with(*_REPLAY, _GREEDY.format(
        max_events="CASE sink_id WHEN 'events' THEN 50 ELSE 20 END",
        max_bytes="CASE sink_id WHEN 'events' THEN 8000 ELSE 4000 END",
    )) + "\nSELECT * FROM batch",
    "w_batch_members": _with(*_REPLAY, _GREEDY.format(max_events="20", max_bytes="67108864")) + """
SELECT walk.lsn, walk.sink_id, batch_name FROM walk JOIN batch
  ON batch.sink_id = walk.sink_id AND batch.window_id = walk.window_id AND batch.chunk = walk.chunk""",
    "k_parquet_sink": _with(*_REPLAY) + """
SELECT CASE WHEN e % 29 <> 0 THEN 'app_' || (u % 4) END AS appid,
  CASE WHEN xwhat = 'payment' THEN value END AS amount,
  CASE WHEN xwhat = 'levelup' THEN CAST(k % 3 AS BIGINT) END AS level,
  CASE WHEN xwhat = 'payment' AND e % 3 = 0 THEN true END AS paid, ms AS sent_at,
  CAST(NULL AS VARCHAR) AS nothing FROM delivery WHERE sink_id = 'events'""",
    "k_kafka_messages": _with(*_REPLAY) + "\nSELECT 't' AS topic, body AS value FROM delivery",
    "k_console_lines": _with(*_REPLAY) + "\nSELECT body AS value FROM delivery",
    "m_events_total": _with(*_ADMIT) + """
SELECT project_id, xwhat, 'wal_appended' AS result, count(*) AS events_total
FROM outcome WHERE issue IS NULL GROUP BY 1, 2, 3""",
    "m_duration_histogram": _with(_EVENTS) + f""",
bound(le, top) AS (VALUES {_BUCKET_ROWS}, ('+Inf', CAST('Infinity' AS DOUBLE)))
SELECT u % 5 AS project_id, xwhat, 'ok' AS result, le,
  count(*) FILTER (WHERE k / 8 <= top) AS bucket_count, count(*) AS duration_count,
  sum(k / 8) AS duration_sum FROM ev, bound GROUP BY 1, 2, 3, 4""",
    "m_log_gauges": _with(_EVENTS, _NODES) + """
SELECT bounds.node_id, tail_lsn AS max_lsn, coalesce(checkpoint_lsn, 0) AS checkpoint_lsn,
  greatest(0, tail_lsn - coalesce(checkpoint_lsn, 0)) AS replay_lag_lsn
FROM bounds LEFT JOIN cp ON cp.node_id = bounds.node_id""",
    "m_error_totals": _with(_EVENTS, _BODY, _VERDICT, _PROJECTS, _DEFAULT, _REQUESTS) + """
SELECT 'ingest' AS stage, issue AS code, count(*) AS total FROM outcome WHERE issue IS NOT NULL GROUP BY 2
UNION ALL SELECT 'replay', code, count(*) FROM plan WHERE code IS NOT NULL GROUP BY 2""",
    "m_delivery_totals": _with(*_REPLAY) + """
SELECT sink_id, count(*) AS events, CAST(sum(strlen(body)) AS BIGINT) AS bytes FROM delivery GROUP BY 1""",
    "m_node_status": _with(_EVENTS) + """,
last AS (SELECT u, arg_max(e, ms) AS e, max(ms) AS ms FROM ev GROUP BY u)
SELECT 'node-' || u AS node_id, CASE WHEN u % 5 = 0 THEN 'stopped'
    WHEN 1706600000000 - ms > 3 * 3600 * 1000 THEN 'stale' ELSE 'running' END AS status,
  '1.' || e AS version, ms AS last_seen_at FROM last""",
    "f_scalar_functions": f"""
SELECT doc_id, to_base64(encode(text)) AS text_base64, strlen(text) AS text_bytes,
  strlen({_DOC_JSON}) AS json_bytes,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ascii_lower,
  lower(lang) AS lower, upper(source) AS upper, starts_with(source, 'src1') AS starts,
  contains(text, 'the') AS contains_the FROM documents""",
    "f_plain_ids": _with(_SINKS) + """
SELECT id, regexp_full_match(id, '[A-Za-z0-9_.-]+') AS plain
FROM (SELECT s_name AS id FROM supplier UNION ALL SELECT sink_id FROM sink)""",
    "t_event_rates": _with(_EVENTS) + """
SELECT ms // 3600000 * 3600000 AS window_start_ms, u % 5 AS project_id, xwhat, 'ok' AS result,
  count(*) AS events FROM ev GROUP BY 1, 2, 3, 4""",
    "t_stream_replay": _with(*_REPLAY) + """
SELECT sink_id, count(*) AS records, CAST(sum(ms) AS BIGINT) AS sent_at_sum FROM delivery GROUP BY 1
UNION ALL SELECT 'quarantine', count(*), NULL FROM plan WHERE code IS NOT NULL""",
    "t_latest_reset": _with(*_REPLAY) + """
SELECT sink_id, count(*) AS records, CAST(sum(ms) AS BIGINT) AS sent_at_sum FROM delivery
WHERE e + 1 > (SELECT count(*) FROM events) * 2 // 3 GROUP BY 1
UNION ALL SELECT 'quarantine', count(*), NULL FROM plan
WHERE code IS NOT NULL AND e + 1 > (SELECT count(*) FROM events) * 2 // 3""",
    "t_gap_stop": _with(*_REPLAY) + """
SELECT sink_id, count(*) AS records, CAST(sum(ms) AS BIGINT) AS sent_at_sum, true AS stopped FROM delivery
WHERE e + 1 < (SELECT count(*) FROM events) // 2 GROUP BY 1
UNION ALL SELECT 'quarantine', count(*), NULL, true FROM plan
WHERE code IS NOT NULL AND e + 1 < (SELECT count(*) FROM events) // 2""",
    "t_bounded_batches": _with(*_REPLAY) + """
SELECT sink_id, count(*) AS records, min(ms) AS first_sent_at FROM delivery
GROUP BY sink_id, e // CAST(ceil((SELECT count(*) FROM events) / 4) AS BIGINT)""",
    "x_target_lint": _with(_PROJECTS, _SCRIPTS) + """
SELECT project_id, script_key, CASE script_key
  WHEN 'strict' THEN 'emit target must use sink constant `SINK_EVENTS` instead of text'
  WHEN 'lost' THEN 'unknown sink target `nowhere`'
  WHEN 'loadtest' THEN 'emit target must be a configured sink constant' END AS message
FROM chosen""",
    "t_batch_wait": _with(*_REPLAY) + """
SELECT CAST(step AS INTEGER) AS step, sink_id,
  (SELECT count(*) FROM delivery d WHERE d.sink_id = s.sink_id AND e < CASE WHEN step < 2 THEN 0
    WHEN step < 4 THEN 3 * n // 5 ELSE n END) AS records
FROM (SELECT unnest(range(5)) AS step), (SELECT unnest(['events', 'events_error']) AS sink_id) s,
  (SELECT count(*) AS n FROM events)""",
    "t_running_totals": _with(_EVENTS) + f""",
bound(le, top) AS (VALUES {_BUCKET_ROWS}, ('+Inf', CAST('Infinity' AS DOUBLE)))
SELECT u % 5 AS project_id, xwhat, 'ok' AS result, count(*) AS events_total, le,
  count(*) FILTER (WHERE k / 8 <= top) AS bucket_count, count(*) AS duration_count,
  sum(k / 8) AS duration_sum FROM ev, bound GROUP BY u % 5, xwhat, le""",
    "t_node_stale": _with(_EVENTS) + """,
last AS (SELECT u, arg_max(e, ms) AS e, max(ms) AS ms FROM ev GROUP BY u)
SELECT 'node-' || u AS node_id, CASE WHEN u % 5 = 0 THEN 'stopped'
    WHEN (SELECT max(ms) FROM ev) - ms > 3 * 3600 * 1000 THEN 'stale' ELSE 'running' END AS status,
  '1.' || e AS version, ms AS last_seen_at FROM last""",
    "t_retries": _with(*_REPLAY) + """
SELECT sink_id, count(*) AS records, CAST(sum(ms) AS BIGINT) AS sent_at_sum FROM delivery GROUP BY 1
UNION ALL SELECT 'quarantine', count(*), NULL FROM plan WHERE code IS NOT NULL
UNION ALL SELECT 'first events', count(*), NULL FROM delivery WHERE sink_id = 'events'
UNION ALL SELECT 'first reached', 0, NULL
UNION ALL SELECT 'reached', count(*), NULL FROM events""",
    "k_sink_refusals": """
SELECT s_suppkey AS id, CASE s_suppkey % 10 WHEN 1 THEN 'path_prefix must not be empty'
  WHEN 3 THEN 'missing field `bootstrap_servers`' WHEN 5 THEN 'unknown blackhole mode `slow`'
  WHEN 7 THEN 'batch.max_events must be greater than 0'
  WHEN 9 THEN 'unsupported parquet storage scheme `ftp`' END AS error FROM supplier""",
    "f_durations": """
SELECT s_suppkey AS id, CAST(CASE s_suppkey % 7 WHEN 0 THEN s_suppkey WHEN 1 THEN 1000 * s_suppkey
  WHEN 2 THEN 60000 * s_suppkey + 30000 WHEN 3 THEN 3600000 * s_suppkey + 62000
  WHEN 4 THEN 86400000 + 3600000 * s_suppkey END AS BIGINT) AS milliseconds FROM supplier""",
}
