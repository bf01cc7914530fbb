"""The registered queries in SQL, from the mapping rules alone.

Nothing here parses or validates JSON: what an event's faults lead to follows
from the mapping in FIXTURES.md.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
AS_OF_MILLIS = "018d5cd0bc00"

# The events table with its mapped columns.
MAPPED = """
mapped AS (
  SELECT *,
    CASE event_type
      WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'page_view' ELSE 'product_view' END
      WHEN 'click' THEN CASE WHEN k % 4 = 0 THEN 'remove_from_cart' ELSE 'add_to_cart' END
      WHEN 'purchase' THEN 'purchase'
      WHEN 'signup' THEN 'page_view'
      ELSE 'product_view' END AS mtype,
    'user_' || user_id AS uid,
    'user_' || user_id || '_' || strftime(ts, '%Y%m%d') AS session,
    'user_' || user_id || '_' || strftime(ts, '%Y%m%d') || '_' || (event_id // 10000) AS batch,
    CASE WHEN user_id % 40 = 7 THEN 'wk_test_unknown' WHEN user_id % 40 = 11 THEN NULL
      WHEN user_id % 40 = 13 THEN 'pk_live_x' ELSE 'wk_test_' || (user_id % 25) END AS api_key,
    CASE WHEN event_id % 5 = 0 THEN (event_id // 5) % 6 ELSE -1 END AS fault,
    greatest(value, 0.01) AS price,
    round_even(greatest(value, 0.01) * 100, 0)::BIGINT AS cents,
    (k % 10 + 1)::BIGINT AS quantity,
    'https://shop.example.com/p/' || k AS page_url,
    'category_' || (k % 6) AS category,
    CASE k % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
    CASE k % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' ELSE 'JP' END AS country,
    CASE k % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_type,
    CASE WHEN {mtype_not_page} THEN 'prod_' || lpad(k::VARCHAR, 4, '0') END AS product_id
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INTEGER AS k FROM events)
),
judged AS (
  SELECT *,
    fault < 0 AS valid,
    CASE fault
      WHEN 0 THEN 'event_type|missing|Field required'
      WHEN 1 THEN 'event_type|enum|Input should be ''page_view'', ''product_view'', ''add_to_cart'', ''remove_from_cart'' or ''purchase'''
      WHEN 2 THEN 'timestamp|value_error|Value error, timestamp cannot be in the future'
      WHEN 3 THEN 'timestamp|value_error|Value error, timestamp is too old (max 30 days)'
      WHEN 4 THEN '|value_error|Value error, PURCHASE requires product_id'
      WHEN 5 THEN 'properties.price|greater_than|Input should be greater than 0'
      ELSE '' END AS errors,
    CASE WHEN api_key IS NULL OR api_key = 'pk_live_x' THEN 'UnauthorizedError'
      WHEN api_key = 'wk_test_unknown' THEN 'NotFoundError' END AS tenant_code,
    CASE WHEN api_key IS NULL THEN 'Missing API Key' WHEN api_key = 'pk_live_x' THEN 'Bad API Key'
      WHEN api_key = 'wk_test_unknown' THEN 'Project by api_key wk_test_unknown not Found' END AS tenant_message
  FROM mapped
)"""
MAPPED = MAPPED.replace(
    "{mtype_not_page}",
    "NOT (event_type = 'signup' OR (event_type = 'view' AND k % 2 = 0))",
)


def project(number: str) -> str:
    return f"('00000000-0000-7000-8000-' || lpad(({number})::VARCHAR, 12, '0'))"


def key(request: str, position: str, millis: str = f"'{AS_OF_MILLIS}'") -> str:
    digest = f"sha256({request} || ':' || ({position})::VARCHAR)"
    digit = f"(instr('0123456789abcdef', substr({digest}, 1, 1)) - 1)"
    return (
        f"(substr({millis}, 1, 8) || '-' || substr({millis}, 9, 4) || '-7' || "
        f"format('{{:03x}}', ({position}) % 4096) || '-' || substr('89ab', {digit} % 4 + 1, 1) || "
        f"substr({digest}, 2, 3) || '-' || substr({digest}, 5, 12))"
    )


def text(instant: str) -> str:
    return f"strftime({instant}, '%Y-%m-%d %H:%M:%S.%f')"


SINGLE_KEY = key("event_id::VARCHAR", "0")

# Accepted single requests, as stored.
ACCEPTED = f"""{MAPPED},
accepted AS (
  SELECT {SINGLE_KEY} AS event_key, {project('user_id % 25')} AS project_id, *
  FROM judged WHERE valid AND tenant_code IS NULL
)"""

# Batch requests: items in source order, with the accepted ids.
BATCHED = f"""{MAPPED},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY event_id) - 1 AS pos FROM judged
),
sized AS (
  SELECT *, count(*) FILTER (valid) OVER (PARTITION BY batch) > 500 AS oversized FROM placed
),
items AS (
  SELECT *, {key('batch', 'pos')} AS event_key, valid AND NOT oversized AND tenant_code IS NULL AS taken
  FROM sized
)"""


def event_columns(source: str, event_id: str, project_id: str = "project_id", created: str = AS_OF) -> str:
    return f"""SELECT {event_id} AS event_id, {project_id} AS project_id, uid AS user_id,
  session AS session_id, mtype AS event_type, {text('ts')} AS event_time, cents AS price,
  quantity, page_url, {text(created)} AS ingested_at FROM {source}"""


STORED = f"WITH {ACCEPTED} " + event_columns("accepted", "event_key")
TYPED = event_columns("mapped", project("event_id"), project("user_id % 25"))
ON_LOG = "event_id % 50 NOT IN (9, 19)"

IDENTIFIED = f"""{MAPPED},
identified AS (
  SELECT *,
    CASE WHEN tenant_code = 'UnauthorizedError' THEN 'ip:10.0.0.' || (user_id % 16)
      WHEN tenant_code IS NULL THEN 'project:' || {project('user_id % 25')} END AS identity,
    CASE WHEN tenant_code = 'UnauthorizedError' THEN -1 ELSE (user_id % 25) % 3 END AS tier
  FROM judged
)"""


def quota_case(free: int, pro: int, enterprise: int, anonymous: int) -> str:
    return f"CASE tier WHEN -1 THEN {anonymous} WHEN 0 THEN {free} WHEN 1 THEN {pro} ELSE {enterprise} END"


FIXED_QUOTA = f"""WITH {IDENTIFIED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY identity, date_trunc('day', ts)
      ORDER BY ts, event_id::VARCHAR) AS place
  FROM identified)
SELECT event_id::VARCHAR AS request_id, coalesce(identity, '-') AS identity,
  CASE WHEN identity IS NULL THEN '-' ELSE {text("date_trunc('day', ts)::TIMESTAMP")} END AS window_start,
  CASE WHEN identity IS NULL OR place <= {quota_case(5, 10, 20, 10)} THEN 1 ELSE 0 END::BIGINT AS admitted
FROM ranked"""

ANCHORED_QUOTA = f"""WITH RECURSIVE {IDENTIFIED},
arrivals AS (SELECT *, date_trunc('millisecond', ts) AS came FROM identified WHERE identity IS NOT NULL),
anchors(identity, opened) AS (
  SELECT identity, min(came) FROM arrivals GROUP BY identity
  UNION ALL
  SELECT a.identity, min(r.came) FROM anchors a JOIN arrivals r
    ON r.identity = a.identity AND r.came >= a.opened + INTERVAL 6 HOUR
  GROUP BY a.identity
),
ranked AS (
  SELECT r.*, a.opened, row_number() OVER (PARTITION BY r.identity, a.opened
      ORDER BY r.ts, r.event_id::VARCHAR) AS place
  FROM arrivals r ASOF JOIN anchors a ON r.identity = a.identity AND r.came >= a.opened
)
SELECT event_id::VARCHAR AS request_id, identity, {text('opened')} AS window_start,
  CASE WHEN place <= {quota_case(2, 4, 6, 3)} THEN 1 ELSE 0 END::BIGINT AS admitted
FROM ranked
UNION ALL
SELECT event_id::VARCHAR, '-', '-', 1::BIGINT FROM identified WHERE identity IS NULL"""

VARIATIONS = [
    "properties.product_id|string_too_short|String should have at least 1 character",
    "properties.product_id|string_too_long|String should have at most 100 characters",
    "properties.product_name|string_too_long|String should have at most 500 characters",
    "",
    "properties.currency|string_pattern_mismatch|String should match pattern ''^[A-Z]{3}$''",
    "properties.country|string_pattern_mismatch|String should match pattern ''^[A-Z]{2}$''",
    "properties.device_type|string_pattern_mismatch|String should match pattern ''^(mobile|desktop|tablet)$''",
    "",
    "properties.price|greater_than|Input should be greater than 0",
    "properties.price|less_than_equal|Input should be less than or equal to 1000000",
    "properties.price|float_parsing|Input should be a valid number, unable to parse string as a number",
    "properties.quantity|less_than_equal|Input should be less than or equal to 10000",
    "properties.quantity|int_from_float|Input should be a valid integer, got a number with a fractional part",
    "",
    "",
    "properties.browser|string_type|Input should be a valid string",
    "",
    "",
    "properties.source|string_type|Input should be a valid string",
    "properties.price|float_type|Input should be a valid number",
]
VARIATION_ERRORS = "CASE event_id % 20 " + " ".join(
    f"WHEN {n} THEN '{message}'" for n, message in enumerate(VARIATIONS)
) + " END"

CODES = [
    ("InvalidPayloadError", "Invalid Payload Error", 400),
    ("UnauthorizedError", "Unauthorized Error", 401),
    ("ForbiddenError", "Forbidden Error", 403),
    ("NotFoundError", "Not Found Error", 404),
    ("ValidationError", "Validation Error", 422),
    ("RateLimitExceededError", "Rate Limit Exceeded Error", 429),
    ("UnexpectedError", "Unexpected Error", 500),
]
STATUS = "CASE code WHEN 'UnauthorizedError' THEN 401 WHEN 'NotFoundError' THEN 404 ELSE 422 END::BIGINT"


def placed_errors(place: str) -> str:
    """The error text with its location under `place`."""
    return f"""CASE WHEN errors = '' THEN '' WHEN errors LIKE '|%' THEN {place} || errors
      ELSE {place} || '.' || errors END"""


REJECTS = f"""WITH {BATCHED},
refused AS (
  SELECT event_id::VARCHAR AS request_id, 0::BIGINT AS pos, 'rejected' AS disposition,
    CASE WHEN valid THEN tenant_code ELSE 'ValidationError' END AS code,
    CASE WHEN valid THEN tenant_message ELSE 'Validation Error' END AS message,
    {placed_errors("'body'")} AS errors
  FROM items WHERE NOT valid OR tenant_code IS NOT NULL
  UNION ALL
  SELECT batch, pos::BIGINT, CASE WHEN valid THEN 'rejected' ELSE 'dropped' END,
    CASE WHEN valid AND NOT oversized THEN tenant_code ELSE 'ValidationError' END,
    CASE WHEN valid AND NOT oversized THEN tenant_message ELSE 'Validation Error' END,
    CASE WHEN valid AND oversized
      THEN 'body.events|too_long|List should have at most 500 items after validation'
      ELSE {placed_errors("'body.events.' || pos::VARCHAR")} END
  FROM items WHERE NOT taken
)"""

# Requests of one instant, admitted by request id; the quota step looks keys up first.
METERED = f"""WITH {BATCHED},
requests AS (
  SELECT event_id::VARCHAR AS request_id, user_id, tenant_code, valid::INT AS n_valid FROM judged WHERE user_id % 2 = 0
  UNION ALL
  SELECT batch, user_id, tenant_code, count(*) FILTER (valid) FROM judged WHERE user_id % 2 = 1
  GROUP BY batch, user_id, tenant_code),
identified AS (
  SELECT *, CASE WHEN tenant_code = 'UnauthorizedError' THEN 'ip:10.0.0.' || (user_id % 16)
      WHEN tenant_code IS NULL THEN 'project:' || {project('user_id % 25')} END AS identity,
    CASE WHEN tenant_code = 'UnauthorizedError' THEN -1 ELSE (user_id % 25) % 3 END AS tier
  FROM requests),
ranked AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY request_id) AS place FROM identified),
decided AS (
  SELECT *, CASE WHEN tenant_code = 'NotFoundError' THEN tenant_code
      WHEN place > {quota_case(5, 10, 20, 10)} THEN 'RateLimitExceededError'
      WHEN n_valid NOT BETWEEN 1 AND 500 THEN 'ValidationError'
      ELSE tenant_code END AS code
  FROM ranked)
SELECT request_id, CASE coalesce(code, '') WHEN 'NotFoundError' THEN 404 WHEN 'RateLimitExceededError' THEN 429
    WHEN 'ValidationError' THEN 422 WHEN 'UnauthorizedError' THEN 401 ELSE 202 END::BIGINT AS http_status,
  coalesce(code, 'accepted') AS result, CASE WHEN code IS NULL THEN n_valid ELSE 0 END::BIGINT AS n_accepted
FROM decided"""

ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00'"
WIRE = f"""'{{"event_id":"' || {project('event_id')} || '","project_id":"' || {project('user_id % 25')}
  || '","user_id":"' || uid || '","session_id":"' || session || '","event_type":"' || mtype
  || '","timestamp":"' || {ISO} || '","properties":{{"page_url":"' || page_url || '","product_id":'
  || CASE WHEN product_id IS NULL THEN 'null' ELSE '"' || product_id || '"' END
  || ',"product_name":null,"category":"' || category || '","price":' || cents || ',"quantity":' || quantity
  || ',"currency":"' || currency || '","country":"' || country || '","browser":null,"os":null,"device_type":"'
  || device_type || '","source":null,"button_clicked":null}},"created_at":"2024-01-31T00:00:00+00:00"}}'"""

FUNNEL = f"""WITH {ACCEPTED},
first AS (SELECT project_id, session, min((ts, event_key)) AS at FROM accepted
  WHERE mtype = 'page_view' GROUP BY ALL),
second AS (SELECT a.project_id, a.session, min((a.ts, a.event_key)) AS at FROM accepted a
  JOIN first f ON a.project_id = f.project_id AND a.session = f.session AND (a.ts, a.event_key) > f.at
  WHERE mtype = 'product_view' GROUP BY ALL),
third AS (SELECT a.project_id, a.session, min((a.ts, a.event_key)) AS at FROM accepted a
  JOIN second f ON a.project_id = f.project_id AND a.session = f.session AND (a.ts, a.event_key) > f.at
  WHERE mtype = 'add_to_cart' GROUP BY ALL),
fourth AS (SELECT a.project_id, a.session, min((a.ts, a.event_key)) AS at FROM accepted a
  JOIN third f ON a.project_id = f.project_id AND a.session = f.session AND (a.ts, a.event_key) > f.at
  WHERE mtype = 'purchase' GROUP BY ALL),
counted AS (
  SELECT p.project_id,
    (SELECT count(*) FROM first f WHERE f.project_id = p.project_id) AS n1,
    (SELECT count(*) FROM second f WHERE f.project_id = p.project_id) AS n2,
    (SELECT count(*) FROM third f WHERE f.project_id = p.project_id) AS n3,
    (SELECT count(*) FROM fourth f WHERE f.project_id = p.project_id) AS n4
  FROM (SELECT DISTINCT project_id FROM first) p)
SELECT project_id, 1::BIGINT AS step, 'page_view' AS event_type, n1 AS sessions, round(n1 / n1, 9) AS step_rate FROM counted
UNION ALL SELECT project_id, 2, 'product_view', n2, round(coalesce(n2 / n1, 0), 9) FROM counted
UNION ALL SELECT project_id, 3, 'add_to_cart', n3, round(CASE WHEN n2 = 0 THEN 0 ELSE n3 / n2 END, 9) FROM counted
UNION ALL SELECT project_id, 4, 'purchase', n4, round(CASE WHEN n3 = 0 THEN 0 ELSE n4 / n3 END, 9) FROM counted"""

CARTS = f"""{ACCEPTED},
epochs AS (
  SELECT *, count(*) FILTER (mtype = 'purchase') OVER (PARTITION BY project_id, session
      ORDER BY ts, event_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch,
    count(*) FILTER (mtype = 'purchase') OVER (PARTITION BY project_id, session) AS last_epoch
  FROM accepted),
carts AS (
  SELECT project_id, session AS session_id, product_id,
    greatest(sum(CASE WHEN mtype = 'add_to_cart' THEN 1 ELSE -1 END), 0)::BIGINT AS quantity
  FROM epochs WHERE epoch = last_epoch AND mtype IN ('add_to_cart', 'remove_from_cart')
  GROUP BY ALL)"""

HISTOGRAM_BOUNDS = ["0.01", "0.05", "0.1", "0.5", "1.0", "2.5", "5.0", "10.0"]


def oracle_sql() -> dict[str, str]:
    stored_under = f"WITH {ACCEPTED} "
    sql = {
        "accepted_summary": stored_under
        + """SELECT project_id, mtype AS event_type, count(*) AS events,
  sum(CASE WHEN mtype = 'purchase' THEN cents * quantity ELSE 0 END)::BIGINT AS revenue
FROM accepted GROUP BY ALL""",
        "ingest_single": f"""WITH {MAPPED} SELECT event_id::VARCHAR AS request_id,
  CASE WHEN NOT valid THEN 422 WHEN tenant_code = 'UnauthorizedError' THEN 401
    WHEN tenant_code = 'NotFoundError' THEN 404 ELSE 202 END::BIGINT AS http_status,
  CASE WHEN NOT valid THEN 'ValidationError' ELSE coalesce(tenant_code, 'accepted') END AS result,
  CASE WHEN valid AND tenant_code IS NULL THEN {SINGLE_KEY} ELSE '' END AS event_id FROM judged""",
        "ingest_batch": f"""WITH {BATCHED}, batches AS (
  SELECT batch, any_value(tenant_code) AS tenant_code, count(*) FILTER (taken) AS n_accepted,
    count(*) FILTER (NOT valid) AS n_dropped,
    count(*) FILTER (valid) NOT BETWEEN 1 AND 500 AS bad_size FROM items GROUP BY batch)
SELECT batch AS request_id,
  CASE WHEN bad_size THEN 422 WHEN tenant_code = 'UnauthorizedError' THEN 401
    WHEN tenant_code = 'NotFoundError' THEN 404 ELSE 202 END::BIGINT AS http_status,
  CASE WHEN bad_size THEN 'ValidationError' ELSE coalesce(tenant_code, 'accepted') END AS result,
  n_accepted, n_dropped, n_accepted AS n_ids FROM batches""",
        "batch_receipts": f"""WITH {BATCHED} SELECT batch AS request_id, 'accepted' AS status,
  string_agg(event_key, ',' ORDER BY pos) AS event_ids FROM items WHERE taken GROUP BY batch""",
        "batch_size_check": f"""WITH {BATCHED} SELECT batch AS request_id, count(*) AS n_items,
  count(*) FILTER (valid) AS n_valid,
  CASE WHEN count(*) FILTER (valid) > 3 THEN 'too_long' WHEN count(*) FILTER (valid) = 0 THEN 'too_short'
    ELSE 'ok' END AS verdict FROM items GROUP BY batch""",
        "rejects": f"WITH refused_items AS ({REJECTS} SELECT * FROM refused) "
        f"SELECT request_id, pos, disposition, code, message, {STATUS} AS status, errors FROM refused_items",
        "reject_status": f"""WITH {MAPPED}, refused AS (
  SELECT CASE WHEN valid THEN tenant_code ELSE 'ValidationError' END AS code FROM judged
  WHERE NOT valid OR tenant_code IS NOT NULL)
SELECT code, {STATUS} AS status, count(*) AS n FROM refused GROUP BY ALL""",
        "reject_message": "SELECT code, message, count(*) AS n FROM events JOIN (VALUES "
        + ", ".join(f"({n}, '{code}', '{message}')" for n, (code, message, _) in enumerate(CODES))
        + ") AS codes(n, code, message) ON event_id % 7 = codes.n GROUP BY ALL",
        "normalize_properties": f"""WITH {MAPPED} SELECT event_id::VARCHAR AS request_id, page_url,
  coalesce(product_id, '-') AS product_id, '-' AS product_name, category, cents::VARCHAR AS price,
  quantity::VARCHAR AS quantity, currency, country, '-' AS browser, '-' AS os, device_type,
  '-' AS source, '-' AS button_clicked FROM judged WHERE valid""",
        "price_minor": "SELECT event_id, round_even(value * 100, 0)::BIGINT AS price_minor FROM events",
        "enrich_event": stored_under
        + f"SELECT event_key AS event_id, project_id, {text(AS_OF)} AS ingested_at FROM accepted",
        "event_key": f"""SELECT event_id, {key("event_id::VARCHAR", "event_id % 7", "format('{:012x}', epoch_us(ts) // 1000)")} AS key
FROM events""",
        "normalize_ts": f"""SELECT event_id, {text('''CASE event_id % 6 WHEN 0 THEN ts
  WHEN 1 THEN ts - INTERVAL 150 MINUTE WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts)
  WHEN 4 THEN date_trunc('millisecond', ts) ELSE date_trunc('day', ts)::TIMESTAMP END''')} AS event_time FROM events""",
        "quota_identity": f"""WITH {MAPPED} SELECT event_id,
  CASE WHEN event_id % 4 = 2 THEN 'ip:10.0.0.' || k WHEN event_id % 4 = 3 THEN 'ip:10.1.0.' || k
    WHEN event_id % 3 <> 0 THEN 'ip:192.168.0.' || k ELSE 'ip:unknown' END AS identity,
  CASE WHEN event_id % 3 <> 0 THEN 'project_create:192.168.0.' || k ELSE 'project_create:unknown' END
    AS creation_identity FROM mapped""",
        "props_backfill": f"""WITH {MAPPED}, sides AS (SELECT *, event_id % 7 <> 0 AS base,
  event_id % 3 <> 0 AS person, event_id % 4 = 0 AS device FROM mapped)
SELECT event_id, user_id::VARCHAR AS user_id,
  CASE WHEN base THEN 'p' || k ELSE '-' END AS product_id,
  CASE WHEN NOT base OR device THEN '-' WHEN person THEN 'new' ELSE 'old' END AS browser,
  CASE WHEN base AND person THEN 'C' || (k % 5) ELSE '-' END AS country,
  CASE WHEN base AND device THEN 'O' || (k % 3) ELSE '-' END AS os,
  CASE WHEN NOT base THEN -1 ELSE 2 + CASE WHEN person THEN 1 ELSE 0 END
    + CASE WHEN device THEN 1 ELSE 0 END END::BIGINT AS n_keys FROM sides""",
        "validate_events": f"""WITH {MAPPED} SELECT event_id::VARCHAR AS request_id,
  CASE WHEN valid THEN 0 ELSE 1 END::BIGINT AS n_errors, errors FROM judged""",
        "validate_time": f"""WITH {MAPPED} SELECT event_id,
  CASE fault WHEN 2 THEN 'Value error, timestamp cannot be in the future'
    WHEN 3 THEN 'Value error, timestamp is too old (max 30 days)' ELSE 'ok' END AS verdict FROM mapped""",
        "validate_props": f"""SELECT event_id, {VARIATION_ERRORS} AS errors,
  CASE event_id % 20 WHEN 7 THEN 1250 WHEN 8 THEN 0 WHEN 9 THEN 100000050 ELSE -1 END::BIGINT AS price,
  CASE event_id % 20 WHEN 11 THEN 10001 WHEN 12 THEN 3 WHEN 13 THEN 3 WHEN 14 THEN 1 ELSE -1 END::BIGINT
    AS quantity FROM events""",
        "validate_url": f"""WITH {MAPPED} SELECT event_id,
  CASE event_id % 10
    WHEN 0 THEN 'https://shop.example.com/p/' || k
    WHEN 1 THEN 'https://shop.example.com/P/' || k
    WHEN 2 THEN 'http://shop.example.com/?q=' || k || '%20x'
    WHEN 3 THEN 'http://shop.example.com:8080/a%20b/' || k || '#top'
    WHEN 4 THEN 'https://shop.example.com/b/' || k
    WHEN 7 THEN 'https://' || k || '.example.com/%C3%A9'
    WHEN 9 THEN 'https://user:pw@10.0.0.' || k || '/'
    ELSE '-' END AS url,
  CASE event_id % 10 WHEN 5 THEN 'url_scheme' WHEN 6 THEN 'url_parsing' WHEN 8 THEN 'url_parsing'
    ELSE 'ok' END AS problem FROM mapped""",
        "validate_consistency": f"""WITH {MAPPED} SELECT event_id,
  CASE WHEN mtype = 'page_view' THEN 'ok'
    WHEN event_id % 3 = 0 THEN 'Value error, ' || CASE mtype WHEN 'purchase' THEN 'PURCHASE'
      WHEN 'product_view' THEN 'PRODUCT_VIEW' ELSE mtype END || ' requires product_id'
    WHEN mtype = 'purchase' AND event_id % 4 = 0 THEN 'Value error, PURCHASE requires price'
    WHEN mtype = 'purchase' AND event_id % 5 = 0 THEN 'Value error, PURCHASE requires quantity'
    ELSE 'ok' END AS verdict FROM mapped""",
        "tenant_resolve": f"""WITH {MAPPED} SELECT event_id::VARCHAR AS request_id,
  CASE WHEN tenant_code IS NULL THEN {project('user_id % 25')} ELSE '-' END AS project_id,
  coalesce(tenant_code, '-') AS code, coalesce(tenant_message, '-') AS message FROM judged""",
        "quota_limit": f"""WITH {IDENTIFIED} SELECT event_id::VARCHAR AS request_id,
  coalesce(identity, '-') AS identity,
  CASE WHEN identity IS NULL THEN -1 ELSE {quota_case(100, 1000, 10000, 10)} END::BIGINT AS quota
FROM identified""",
        "quota_fixed_window": FIXED_QUOTA,
        "quota_anchored_window": ANCHORED_QUOTA,
        "quota_project_create": """WITH attempts AS (SELECT event_id, ts, date_trunc('day', ts) AS day,
    CASE WHEN event_id % 2 = 0 AND user_id % 40 NOT IN (11, 13) THEN NULL
      ELSE 'project_create:10.0.0.' || (user_id % 16) END AS identity FROM events),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY identity, day ORDER BY ts, event_id::VARCHAR) AS nth FROM attempts)
SELECT event_id::VARCHAR AS request_id, coalesce(identity, '-') AS identity,
  CASE WHEN identity IS NULL THEN '-' ELSE strftime(day::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f') END AS window_start,
  CASE WHEN identity IS NULL OR nth <= 5 THEN 1 ELSE 0 END::BIGINT AS admitted FROM ranked""",
        "orphan_events": f"WITH {MAPPED} {TYPED} WHERE user_id % 25 >= 23",
        "cascade_delete": f"{STORED} WHERE (user_id % 25) % 5 <> 0",
        "project_load": f"""WITH base AS (SELECT n_nationkey AS n, n_name AS name,
  CASE n_nationkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS plan FROM nation)
SELECT {project('n')} AS project_id, name, plan, 'stored' AS outcome, '' AS errors FROM base
UNION ALL SELECT {project('n + 100')}, name, plan, 'UnexpectedError', '' FROM base WHERE n % 4 = 0
UNION ALL SELECT {project('n + 200')}, 'ab', plan, 'ValidationError',
  'body.name|string_too_short|String should have at least 3 characters' FROM base WHERE n = 0
UNION ALL SELECT {project('n + 200')}, name, 'super', 'ValidationError',
  'body.plan|enum|Input should be ''free'', ''pro'' or ''enterprise''' FROM base WHERE n = 1
UNION ALL SELECT {project('n + 300')}, name || ' two', 'free', 'stored', '' FROM base""",
        "project_by_key": f"""SELECT {project('n_nationkey')} AS project_id, n_name AS name,
  CASE n_nationkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS plan,
  'wk_test_' || n_nationkey AS api_key, '2024-01-01 00:00:00.000000' AS created
FROM nation WHERE 'wk_test_' || n_nationkey = 'wk_test_7'""",
        "publish_wire": f"WITH {MAPPED} SELECT {project('event_id')} AS event_id, {WIRE} AS data FROM mapped",
        "decode_wire": f"""WITH {MAPPED}, copies AS (SELECT *, unnest(CASE WHEN event_id % 20 = 3
  THEN [0, 1] ELSE [0] END) AS copy FROM mapped),
read AS (SELECT *, {ON_LOG} AS ok FROM copies)
SELECT event_id || '-' || copy AS msg_id,
  CASE event_id % 50 WHEN 9 THEN 'DeserializationError: message is not valid JSON'
    WHEN 19 THEN 'empty_message_data' ELSE '-' END AS error,
  CASE WHEN ok THEN {project('read.event_id')} ELSE '-' END AS event_id,
  CASE WHEN ok THEN mtype ELSE '-' END AS event_type,
  CASE WHEN ok THEN {text('ts')} ELSE '-' END AS event_time,
  CASE WHEN ok THEN cents ELSE -1 END AS price, CASE WHEN ok THEN category ELSE '-' END AS category
FROM read""",
        "decode_stored": f"WITH {MAPPED} {TYPED}",
        "store_events": STORED,
        "ingest_store": stored_under
        + "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM accepted GROUP BY ALL",
        "events_page": f"""{STORED} WHERE project_id = '00000000-0000-7000-8000-000000000003'
ORDER BY ts, event_key LIMIT 100 OFFSET 20""",
        "events_page_after": f"""{STORED} WHERE project_id = '00000000-0000-7000-8000-000000000003'
  AND ts >= TIMESTAMP '2024-01-10 12:00:00' ORDER BY ts, event_key LIMIT 50""",
        "event_by_id": f"{STORED} WHERE accepted.event_id = 1",
        "events_slice": f"""{STORED} WHERE mtype = 'purchase'
  AND ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'""",
        "batch_junk_items": f"""WITH {BATCHED} SELECT batch AS request_id,
  sum(1 + event_id % 4)::BIGINT AS n_items, count(*) FILTER (valid) AS n_valid,
  CASE WHEN count(*) FILTER (valid) > 3 THEN 'too_long' ELSE 'ok' END AS verdict FROM items GROUP BY batch""",
        "ingest_metered": METERED,
        "normalize_week_dates": f"""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN '-' ELSE {text('''CASE event_id % 5
  WHEN 2 THEN date_trunc('week', ts)::TIMESTAMP WHEN 3 THEN date_trunc('second', ts) - INTERVAL 1 HOUR
  ELSE date_trunc('day', ts)::TIMESTAMP END''')} END AS event_time FROM events""",
        "validate_hosts": f"""WITH {MAPPED} SELECT event_id,
  CASE event_id % 8
    WHEN 0 THEN 'https://xn--bcher-kva.example/' || k
    WHEN 1 THEN 'https://xn--bcher-kva.example/' || k
    WHEN 2 THEN 'https://xn--bcher-kva.example/' || k
    WHEN 3 THEN 'https://xn--r8jz45g.xn--zckzah/' || k
    WHEN 4 THEN 'https://user@xn--e1afmkfd.xn--p1ai:8080/' || k
    WHEN 5 THEN 'https://10.0.0.1/' || k
    ELSE '-' END AS url,
  CASE WHEN event_id % 8 < 6 THEN 'ok' ELSE 'url_parsing' END AS problem FROM mapped""",
        "stream_quota_anchored": ANCHORED_QUOTA,
        "stream_quota_state": FIXED_QUOTA,
        "stream_lag": """SELECT count(*) FILTER (ts >= '2024-01-24') AS lag,
  count(*) FILTER (ts < '2024-01-24' AND event_id % 50 IN (9, 19)) AS dlq_size FROM events""",
        "stream_orphans": f"""WITH sent AS (SELECT *, unnest(CASE WHEN event_id % 20 = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM events)
SELECT event_id || '-' || copy AS original_msg_id,
  CASE event_id % 50 WHEN 9 THEN 'DeserializationError: message is not valid JSON' WHEN 19 THEN 'empty_message_data'
    ELSE 'Project by id ' || {project('user_id % 25')} || ' not found' END AS error,
  CASE event_id % 50 WHEN 9 THEN 'deserialization' WHEN 19 THEN 'empty_message_data' ELSE 'orphan_event' END AS error_type
FROM sent WHERE event_id % 50 IN (9, 19) OR user_id % 25 >= 23""",
        "metrics_failures": """SELECT CASE event_id % 50 WHEN 9 THEN 'deserialization'
  ELSE 'empty_message_data' END AS error_type, count(*) AS errors
FROM events WHERE event_id % 50 IN (9, 19) GROUP BY ALL
UNION ALL SELECT 'batch_processing_failed', 1::BIGINT""",
        "accepted_events": f"WITH {BATCHED}, log AS (SELECT *, {project('user_id % 25')} AS project_id,"
        f" CASE WHEN user_id % 2 = 0 THEN {SINGLE_KEY} ELSE event_key END AS log_key FROM items"
        " WHERE taken OR (user_id % 2 = 0 AND valid AND tenant_code IS NULL)) "
        + event_columns("log", "log_key"),
        "stream_consume": f"WITH {MAPPED} {TYPED} WHERE mapped.{ON_LOG}",
        "stream_store": f"WITH {MAPPED} {TYPED} WHERE mapped.{ON_LOG}",
        "stream_dedup": f"WITH {MAPPED} {TYPED} WHERE mapped.{ON_LOG}",
        "stream_quota": FIXED_QUOTA,
        "stream_health": """SELECT
  ((ts >= '2024-01-08')::INT + (ts >= '2024-01-16')::INT + (ts >= '2024-01-24')::INT)::BIGINT AS batch_id,
  sum(CASE WHEN event_id % 20 = 3 THEN 2 ELSE 1 END)::BIGINT AS messages,
  count(*) FILTER (event_id % 50 = 19) AS empty_messages FROM events GROUP BY 1""",
        "dead_letters": """SELECT event_id || '-0' AS original_msg_id,
  CASE event_id % 50 WHEN 9 THEN 'DeserializationError: message is not valid JSON'
    ELSE 'empty_message_data' END AS error,
  CASE event_id % 50 WHEN 9 THEN 'deserialization' ELSE 'empty_message_data' END AS error_type,
  CASE event_id % 50 WHEN 9 THEN 'not_json' ELSE '' END AS raw
FROM events WHERE event_id % 50 IN (9, 19)""",
        "metrics_processed": f"SELECT count(*) AS events_processed FROM events WHERE {ON_LOG}",
        "metrics_errors": """SELECT CASE event_id % 50 WHEN 9 THEN 'deserialization'
  ELSE 'empty_message_data' END AS error_type, count(*) AS errors
FROM events WHERE event_id % 50 IN (9, 19) GROUP BY ALL""",
        "metrics_dlq": "SELECT count(*) AS dlq_size FROM events WHERE event_id % 50 IN (9, 19)",
        "metrics_lag": "SELECT count(*) AS lag FROM events WHERE event_id % 10 >= 7",
        "latency_histogram": "WITH bounds AS (SELECT * FROM (VALUES "
        + ", ".join(f"('{bound}', {bound}::DOUBLE)" for bound in HISTOGRAM_BOUNDS)
        + """, ('+Inf', 'Infinity'::DOUBLE)) AS b(le, bound))
SELECT le, (SELECT count(*) FROM events WHERE value / 100 <= bound) AS n,
  (SELECT count(value) FROM events) AS count, (SELECT round(sum(value / 100), 4) FROM events) AS sum FROM bounds""",
        "throughput": f"""WITH {MAPPED}, sent AS (
  SELECT ts, 1 AS n FROM mapped WHERE user_id % 2 = 0
  UNION ALL SELECT max(ts), count(*) FROM mapped WHERE user_id % 2 = 1 GROUP BY batch)
SELECT {text("date_trunc('second', ts)")} AS second, count(*) AS requests, sum(n)::BIGINT AS events
FROM sent GROUP BY ALL""",
        "steady_state_rate": """WITH daily AS (SELECT date_trunc('day', ts) AS day, max(event_id) + 1 AS total,
  avg(value) AS latency FROM events GROUP BY ALL),
stable AS (SELECT *, total - lag(total) OVER (ORDER BY day) AS step FROM daily
  WHERE day > (SELECT min(day) FROM daily) + INTERVAL 12 HOUR)
SELECT round(avg(step), 6) AS average_rate, round(avg(latency), 6) AS average_latency FROM stable""",
        "funnel": FUNNEL,
        "session_summary": stored_under
        + f"""SELECT project_id, session AS session_id, count(*) FILTER (mtype = 'page_view') AS page_views,
  count(DISTINCT CASE WHEN mtype = 'product_view' THEN product_id END) AS viewed_products,
  {text('min(ts)')} AS started_at, {text('max(ts)')} AS ended_at, count(*) AS events
FROM accepted GROUP BY project_id, session""",
        "cart_state": f"WITH {CARTS} SELECT * FROM carts",
        "abandoned_carts": f"""WITH {CARTS} SELECT project_id, session_id, count(*) AS products,
  sum(quantity)::BIGINT AS items FROM carts WHERE quantity > 0 GROUP BY ALL""",
        "revenue": stored_under
        + """SELECT project_id, currency, category, count(*) AS purchases, sum(quantity)::BIGINT AS units,
  sum(cents * quantity)::BIGINT AS revenue FROM accepted WHERE mtype = 'purchase' GROUP BY ALL""",
        "event_mix": stored_under
        + """SELECT t.name AS event_type, count(a.mtype) AS events,
  count(a.mtype) / (SELECT count(*) FROM accepted) AS share, t.target AS target_share
FROM (VALUES ('page_view', 0.5::DOUBLE), ('product_view', 0.25::DOUBLE), ('add_to_cart', 0.15::DOUBLE),
  ('purchase', 0.07::DOUBLE), ('remove_from_cart', 0.03::DOUBLE)) AS t(name, target)
LEFT JOIN accepted a ON a.mtype = t.name GROUP BY ALL""",
    }
    return sql
