"""Queries on jobs, result envelopes, logs, sessions and capture windows."""

from __future__ import annotations

from webloom.functions import urls as u
from webloom.functions.dialect import Spark
from webloom.plans.base import both

MAX_JOBS, MAX_BYTES, PAGE_BYTES = 1024, 256 << 20, 10 << 20
IDLE = 3_600_000_000
RANGE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
# One job per customer of the event log: its events are pages, errors, blocked pages and cancellations.
JOB_EVENTS = """SELECT CASE WHEN user_id % 2 = 0 THEN 'crawl' ELSE 'batch' END AS kind, user_id AS job, event_id AS pos, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN CASE WHEN event_id % 40 = 0 THEN 'cancelled' ELSE 'robots_blocked' END ELSE 'page' END AS event,
    CAST(floor(value * 1000) AS BIGINT) AS bytes FROM events"""


def _jobs(d: Spark) -> str:
    """States and counters of jobs from their events; a cancellation sticks."""
    return f"""SELECT kind, job, min(ts) AS created, count(*) AS total, CAST(sum(CASE WHEN event = 'page' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN event = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors,
        CAST(sum(CASE WHEN event = 'robots_blocked' THEN 1 ELSE 0 END) AS BIGINT) AS n_blocked, CAST(sum(CASE WHEN event = 'page' THEN bytes ELSE 0 END) AS BIGINT) AS bytes,
        CASE WHEN max(CASE WHEN event = 'cancelled' THEN 1 ELSE 0 END) = 1 THEN 'cancelled' WHEN job % 11 = 0 THEN 'scraping' WHEN sum(CASE WHEN event = 'page' THEN 1 ELSE 0 END) = 0 AND sum(CASE WHEN event = 'error' THEN 1 ELSE 0 END) > 0 THEN 'failed' ELSE 'completed' END AS status
        FROM ({JOB_EVENTS}) GROUP BY kind, job"""


def _job_states(d: Spark) -> str:
    after = f"SELECT e.job, count(*) AS n_after FROM ({JOB_EVENTS}) e JOIN (SELECT job, min(pos) AS tm FROM ({JOB_EVENTS}) WHERE event = 'cancelled' GROUP BY job) c ON e.job = c.job WHERE e.pos > c.tm GROUP BY e.job"
    return f"SELECT j.kind, j.job, j.total, j.completed, j.n_errors, j.n_blocked, j.bytes, j.status, coalesce(a.n_after, 0) AS n_after_cancel FROM ({_jobs(d)}) j LEFT JOIN ({after}) a ON j.job = a.job"


def _job_stats(d: Spark) -> str:
    """By kind, and over all."""
    one = lambda k, g: f"SELECT {k} AS kind, count(*) AS jobs, CAST(sum(CASE WHEN status = 'scraping' THEN 1 ELSE 0 END) AS BIGINT) AS running, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_jobs(d)}){g}"
    return f"{one('kind', ' GROUP BY kind')} UNION ALL {one(chr(39) + 'all' + chr(39), '')}"


def _job_pages(d: Spark) -> str:
    """A page of results from skip on, at most limit items and 10 MiB, one item at least. Of a job's items only those that the page may hold
    are numbered, under a limit that tasks apply before the shuffle; how many there are is counted apart."""
    first = "SELECT * FROM (SELECT source, doc_id, n_chars * 400 AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 2 + 30"
    return _page(f"SELECT i.source AS job, i.doc_id, i.bytes, i.place - 1 AS pos, t.total FROM ({first}) i JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) t ON i.source IS NOT DISTINCT FROM t.source")


def _job_pages_plain(d: Spark) -> str:
    return _page("SELECT source AS job, doc_id, n_chars * 400 AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM documents")


def _page(items: str) -> str:
    window = f"SELECT *, sum(bytes) OVER (PARTITION BY job ORDER BY pos {RANGE}) AS used, row_number() OVER (PARTITION BY job ORDER BY pos) AS n FROM ({items}) WHERE pos >= 2 AND pos < 2 + 30"
    kept = f"SELECT * FROM ({window}) WHERE used <= {PAGE_BYTES} OR n = 1"
    return f"""SELECT job, count(*) AS n, min(doc_id) AS first_doc, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max(pos) + 1 AS BIGINT) AS next_skip, max(pos) + 1 < max(total) AS has_next,
        CASE WHEN max(pos) + 1 < max(total) THEN 'https://api.example/v1/' || job || '?skip=' || CAST(CAST(max(pos) + 1 AS BIGINT) AS VARCHAR(20)) || '&limit=30' END AS next FROM ({kept}) GROUP BY job"""


def _eviction(d: Spark) -> str:
    """Expired jobs go, then the oldest finished ones beyond the byte cap or the count."""
    cap, most = 500_000, 100
    age = f"SELECT *, {d.micros('created')} AS tm, {d.micros('(SELECT max(ts) FROM events)')} AS now_at FROM ({_jobs(d)})"
    live = f"SELECT *, now_at - tm >= 86400000000 * 6 AS expired, status <> 'scraping' AS terminal FROM ({age})"
    newest = f"SELECT *, sum(CASE WHEN terminal AND NOT expired THEN bytes ELSE 0 END) OVER (ORDER BY tm DESC, job DESC {RANGE}) AS held, row_number() OVER (ORDER BY CASE WHEN terminal THEN 1 ELSE 0 END, tm DESC, job DESC) AS n FROM ({live})"
    return f"SELECT kind, job, status, expired, CASE WHEN expired THEN 'expired' WHEN terminal AND held > {cap} THEN 'bytes' WHEN terminal AND n > {most} THEN 'count' ELSE 'kept' END AS fate FROM ({newest})"


def _errors(d: Spark) -> str:
    """H18, I09."""
    e = f"SELECT job, pos, event FROM ({JOB_EVENTS}) WHERE event IN ('error', 'robots_blocked')"
    return f"SELECT job, event, {d.ordered('pos', ',', 'pos')} AS positions, count(*) AS n FROM ({e}) GROUP BY job, event"


def _webhooks(d: Spark) -> str:
    """Deliveries of configured events and the times of their attempts; every hundredth one fails."""
    e = f"SELECT kind, job, pos, ts, event FROM ({JOB_EVENTS}) WHERE event IN ('page', 'cancelled')"
    tries = "SELECT * FROM (VALUES (0, 0), (1, 60), (2, 360), (3, 1260)) AS v(attempt, after_s)"
    return f"""SELECT e.kind || '.' || CASE WHEN e.event = 'page' THEN 'page' ELSE 'failed' END AS type, e.job, e.pos, CAST(t.attempt AS BIGINT) AS attempt, {d.micros("e.ts")} + t.after_s * 1000000 AS due,
        e.event = 'page' AS success FROM ({e}) e CROSS JOIN ({tries}) t WHERE t.attempt = 0 OR e.pos % 100 = 0"""


def _logs(d: Spark) -> str:
    """Newest first, bounded, without health checks and credentials."""
    rows = f"SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '/health' ELSE '/v1/scrape' END AS route, 'https://u:p@h' || CAST(user_id AS VARCHAR(20)) || '.example/x' AS url, event_type FROM events"
    ring = f"SELECT * FROM ({rows}) WHERE route NOT IN ('/health', '/admin/logs') ORDER BY id DESC LIMIT 500"
    return f"SELECT id, route, {u.redact_credentials(d, 'url')} AS url, {u.host(d, 'url')} AS host FROM (SELECT * FROM ({ring}) ORDER BY id DESC LIMIT least(greatest(200, 1), 500))"


def _envelopes(d: Spark) -> str:
    """Codes and texts of result rows."""
    rows = """SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'needs_browser' WHEN 'click' THEN 'unsupported' ELSE 'success' END AS status,
        CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'network' ELSE 'parse' END END AS kind, CASE WHEN event_type = 'error' AND event_id % 6 = 0 THEN 'robots' WHEN event_type = 'error' AND event_id % 6 = 3 THEN 'timeout' END AS reason,
        CASE event_id % 4 WHEN 0 THEN 'next_data' WHEN 1 THEN 'json_ld' WHEN 2 THEN 'nuxt' ELSE 'other' END AS origin, CASE event_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'html' WHEN 2 THEN 'screenshot' WHEN 3 THEN '' ELSE 'bogus' END AS format FROM events"""
    return f"""SELECT id, status, CASE status WHEN 'success' THEN 0 WHEN 'error' THEN 1 WHEN 'unsupported' THEN 2 ELSE 3 END AS exit_code, CASE WHEN status = 'success' THEN 200 WHEN status IN ('unsupported', 'needs_browser') THEN 422 WHEN kind = 'network' THEN 502 ELSE 500 END AS http_code,
        coalesce(kind = 'network' AND reason = 'robots', false) AS robots_blocked, CASE WHEN kind IS NULL THEN '' ELSE concat_ws(': ', kind, reason) END AS summary, 'embedded_' || origin AS action,
        CASE WHEN format = '' THEN 'markdown' WHEN format IN ('markdown', 'html', 'rawHtml', 'links', 'json', 'endpoints') THEN format WHEN format IN ('screenshot', 'pdf') THEN 'browser only' ELSE 'unknown' END AS format,
        CASE WHEN format IN ('screenshot', 'pdf') THEN 422 WHEN format = 'bogus' THEN 400 ELSE 200 END AS format_code FROM ({rows})"""


def _idle_sessions(d: Spark) -> str:
    gap = f"SELECT user_id, event_id, {d.micros('ts')} AS tm, lag({d.micros('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events"
    marked = f"SELECT *, sum(CASE WHEN before IS NULL OR tm - before > {IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tm, event_id {RANGE}) AS island FROM ({gap})"
    return f"SELECT user_id, CAST(island AS BIGINT) AS island, min(tm) AS opened, max(tm) AS last_at, count(*) AS n FROM ({marked}) GROUP BY user_id, island"


def _sessions(d: Spark) -> str:
    """Sessions of a user end after an idle hour; the most that were held at a time. Loads run within
    hours and over the hours' sums, so that no task sees all sessions."""
    per = _idle_sessions(d)
    steps = f"SELECT opened AS tm, 1 AS step FROM ({per}) UNION ALL SELECT last_at + {IDLE}, -1 FROM ({per})"
    placed = f"SELECT *, CAST(floor(tm / 3600000000) AS BIGINT) AS hour FROM ({steps})"
    before = f"SELECT hour, sum(n) OVER (ORDER BY hour {RANGE}) - n AS held FROM (SELECT hour, sum(step) AS n FROM ({placed}) GROUP BY hour)"
    within = f"SELECT hour, max(held) AS most FROM (SELECT hour, sum(step) OVER (PARTITION BY hour ORDER BY tm, step {RANGE}) AS held FROM ({placed})) GROUP BY hour"
    load = f"SELECT max(b.held + w.most) AS peak FROM ({before}) b JOIN ({within}) w ON b.hour = w.hour"
    return f"SELECT p.user_id, p.island, p.opened, p.last_at, p.n, CAST(l.peak AS BIGINT) AS peak_sessions FROM ({per}) p CROSS JOIN ({load}) l"


def _sessions_compared(d: Spark) -> str:
    """The SQL of sessions_idle: for each opening, the sessions open then."""
    per = _idle_sessions(d)
    return f"""WITH p AS ({per}) SELECT user_id, island, opened, last_at, n, (SELECT max(k) FROM (SELECT a.user_id, a.island, count(*) AS k FROM p a JOIN p b ON b.opened <= a.opened AND b.last_at + {IDLE} > a.opened GROUP BY a.user_id, a.island)) AS peak_sessions FROM p"""


def _settled(d: Spark) -> str:
    """When a value (a page's size) first stays the same for long enough."""
    rows = f"SELECT user_id, event_id, {d.micros('ts')} AS tm, CAST(floor(value / 20) AS BIGINT) AS size FROM events"
    change = f"SELECT *, CASE WHEN size = lag(size) OVER (PARTITION BY user_id ORDER BY tm, event_id) THEN 0 ELSE 1 END AS changed FROM ({rows})"
    island = f"SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY tm, event_id {RANGE}) AS g FROM ({change})"
    spans = f"SELECT user_id, g, size, min(tm) AS since, max(tm) AS last_at FROM ({island}) GROUP BY user_id, g, size"
    return f"SELECT user_id, min(since) AS settled_at, count(*) AS n_plateaus FROM ({spans}) WHERE last_at - since >= greatest(120, 500) * 1000000 GROUP BY user_id"


def _spacing(d: Spark) -> str:
    """Each request of a host waits for the slot after the one before: running maximum of ts - n delay."""
    delay = 600_000_000
    rows = f"SELECT user_id % 10 AS host, event_id, {d.micros('ts')} AS tm FROM events"
    n = f"SELECT *, CAST(row_number() OVER (PARTITION BY host ORDER BY tm, event_id) - 1 AS BIGINT) AS n FROM ({rows})"
    return f"SELECT host, event_id, tm, CAST(max(tm - n * {delay}) OVER (PARTITION BY host ORDER BY n {RANGE}) + n * {delay} AS BIGINT) AS slot FROM ({n})"


def _retries(d: Spark) -> str:
    """Attempts of a request until one is not to be retried, three retries at most."""
    attempts = "SELECT user_id AS req, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt, CASE WHEN event_type IN ('error', 'signup', 'view') THEN CASE WHEN event_id % 2 = 0 THEN 429 ELSE 503 END ELSE 200 END AS status, CASE event_id % 4 WHEN 0 THEN '30' WHEN 1 THEN ' 2 ' WHEN 2 THEN 'soon' ELSE '' END AS retry_after FROM events"
    ran = f"SELECT *, max(CASE WHEN status NOT IN (429, 503) THEN 1 ELSE 0 END) OVER (PARTITION BY req ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM ({attempts}) WHERE attempt <= 3"
    after = f"CASE WHEN {d.rlike('trim(retry_after)', '^[0-9]+$')} THEN TRY_CAST(trim(retry_after) AS BIGINT) END"
    return f"""SELECT req, CAST(attempt AS BIGINT) AS attempt, status, {after} AS retry_after_s, CASE WHEN status IN (429, 503) THEN least(coalesce({after} * 1000, 500 * CASE least(attempt, 6) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 64 END), 20000) ELSE 0 END AS wait_ms
        FROM ({ran}) WHERE coalesce(stopped, 0) = 0"""


def _gate(d: Spark) -> str:
    """Requests that find all slots taken: what began before them and is not over, as a running sum of
    starts and ends. It runs within minutes, and over the minutes' sums, so that no task sees all rows."""
    rows = f"SELECT event_id, {d.micros('ts')} AS tm, {d.micros('ts')} + CAST(floor(value * 20000000) AS BIGINT) AS until FROM events"
    # at one instant ends come first, then requests, then starts
    steps = f"""SELECT event_id, tm, 1 AS kind, 0 AS step FROM ({rows}) UNION ALL SELECT NULL, tm, 2, 1 FROM ({rows}) WHERE until > tm
        UNION ALL SELECT NULL, until, 0, -1 FROM ({rows}) WHERE until > tm"""
    placed = f"SELECT *, CAST(floor(tm / 60000000) AS BIGINT) AS minute FROM ({steps})"
    before = f"SELECT minute, sum(n) OVER (ORDER BY minute {RANGE}) - n AS held FROM (SELECT minute, sum(step) AS n FROM ({placed}) GROUP BY minute)"
    within = f"SELECT *, sum(step) OVER (PARTITION BY minute ORDER BY tm, kind {RANGE}) AS inner_held FROM ({placed})"
    busy = f"SELECT w.event_id, CAST(sum(coalesce(b.held, 0) + w.inner_held) AS BIGINT) AS busy FROM ({within}) w LEFT JOIN ({before}) b ON w.minute = b.minute WHERE w.kind = 1 GROUP BY w.event_id"
    return f"SELECT event_id, busy, busy >= 8 AS saturated, greatest(8 - busy, 0) AS free FROM ({busy})"


def _gate_compared(d: Spark) -> str:
    """The SQL of slot_gate: the plain self-join, over all events."""
    rows = f"SELECT event_id, {d.micros('ts')} AS tm, {d.micros('ts')} + CAST(floor(value * 20000000) AS BIGINT) AS until FROM events"
    return f"SELECT a.event_id, count(b.event_id) AS busy, count(b.event_id) >= 8 AS saturated, greatest(8 - count(b.event_id), 0) AS free FROM ({rows}) a LEFT JOIN ({rows}) b ON b.tm < a.tm AND b.until > a.tm GROUP BY a.event_id"


def _buckets(d: Spark) -> str:
    """Milliseconds per bucket of a run's trace."""
    trace = "SELECT user_id AS run, CASE event_type WHEN 'view' THEN 'network' WHEN 'click' THEN 'parse' WHEN 'purchase' THEN 'runtime' ELSE 'other' END AS bucket, CAST(floor(value) AS BIGINT) AS ms, event_type, event_id FROM events"
    cell = lambda b: f"CAST(sum(CASE WHEN bucket = '{b}' THEN ms ELSE 0 END) AS BIGINT) AS {b}_ms"
    return f"SELECT run, {cell('network')}, {cell('parse')}, {cell('runtime')}, CAST(sum(ms) AS BIGINT) AS total_ms, count(*) AS steps FROM ({trace}) GROUP BY run"


def _actions(d: Spark) -> str:
    """Turns of a conversation as a session's actions: labels, and success up to the first failure."""
    rows = "SELECT conv_id, turn, role, text, length(text) % 13 <> 0 AS ok FROM conversations"
    ran = f"SELECT *, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({rows})"
    return f"SELECT conv_id, count(*) AS n_run, min(CASE WHEN ok THEN 1 ELSE 0 END) = 1 AS ok, max(turn) AS last_turn, {d.ordered("CASE WHEN role = 'user' THEN 'type:' ELSE 'wait:' END || CAST(length(text) AS VARCHAR(20))", ',', 'turn')} AS labels FROM ({ran}) WHERE coalesce(before, 1) = 1 GROUP BY conv_id"


def _ladder(d: Spark) -> str:
    """The first stage that yields, and its windows."""
    rows = "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'state' END AS tier0, CASE WHEN event_id % 6 = 0 THEN 'route' END AS tier1, CASE WHEN event_id % 5 = 0 THEN 'intercept' END AS tier2, event_id % 3500 AS shell, CAST(floor(value * 40) AS BIGINT) AS rendered, event_id % 4 AS tier_max, 600 + event_id % 20000 AS window_ms, event_type FROM events"
    thin = "rendered < 200"
    return f"""SELECT id, least(tier_max, 2) AS tier_max, coalesce(tier0, CASE WHEN least(tier_max, 2) >= 1 THEN tier1 END, CASE WHEN least(tier_max, 2) >= 2 THEN tier2 END) AS data, CASE WHEN tier0 IS NOT NULL THEN 'static' WHEN tier1 IS NOT NULL AND tier_max >= 1 THEN 'heuristic_api_replay' WHEN tier2 IS NOT NULL AND tier_max >= 2 THEN 'runtime_interception' END AS source_tier,
        CASE WHEN shell > 0 AND rendered * 5 < shell THEN CASE WHEN shell < 1000 THEN 'needs_browser' ELSE 'shell' END WHEN (event_type = 'view' OR (rendered > shell AND NOT ({thin}))) AND event_type <> 'error' THEN 'rendered' ELSE 'shell' END AS winner,
        greatest(150, least(500, CAST(floor(window_ms / 6) AS BIGINT))) AS quiesce_ms, CASE WHEN event_type = 'view' THEN least(window_ms, 2500) ELSE least(greatest(window_ms, 8000), 15000) END AS capture_ms, greatest(3, least(10, CAST(floor(greatest(150, least(500, floor(window_ms / 6))) / 50) AS BIGINT))) AS tick_ms FROM ({rows})"""


def _headers(d: Spark) -> str:
    """Header lists and bodies."""
    cases = ["Content-Type: application/JSON; charset=x", "accept:text/html", "X-A: b: c", "broken", "content-type: application/ld+json"]
    rows = ", ".join(f"({i}, {d.lit(c)})" for i, c in enumerate(cases))
    name, value = d.extract("h", "^([^:]*):"), f"trim({d.extract('h', '^[^:]*:(.*)$')})"
    media = f"lower(trim({d.extract(value, '^([^;]*)')}))"
    return f"""SELECT CAST(id AS BIGINT) AS id, {name} AS name, {value} AS value, lower({name}) || ':' || lower({value}) AS joined, CASE WHEN lower({name}) = 'content-type' THEN {value} ELSE 'text/html' END AS content_type,
        {media} = 'application/json' OR {d.ends(media, "'+json'")} AS is_json, {"base64(CAST(h AS BINARY))" if d.name == "spark" else "base64(encode(h))"} AS body64, 'a=1; ' || {name} || '=' || {value} AS cookies FROM (VALUES {rows}) AS v(id, h)"""


def _cache(d: Spark) -> str:
    """The least recently used records leave a bounded cache; running sums within buckets of uses and over the buckets."""
    last = "SELECT user_id AS k, max(event_id) AS used, CAST(sum(floor(value)) AS BIGINT) AS bytes FROM events GROUP BY user_id"
    placed = f"SELECT *, CAST(floor(used / 65536) AS BIGINT) AS bucket FROM ({last})"
    after = f"SELECT bucket, sum(b) OVER (ORDER BY bucket DESC {RANGE}) - b AS held, sum(n) OVER (ORDER BY bucket DESC {RANGE}) - n AS ahead FROM (SELECT bucket, sum(bytes) AS b, count(*) AS n FROM ({placed}) GROUP BY bucket)"
    within = f"SELECT *, sum(bytes) OVER (PARTITION BY bucket ORDER BY used DESC {RANGE}) AS inner_held, row_number() OVER (PARTITION BY bucket ORDER BY used DESC) AS place FROM ({placed})"
    return f"SELECT w.k, w.used, w.bytes, CAST(a.held + w.inner_held AS BIGINT) AS held, a.held + w.inner_held <= 100000 AND a.ahead + w.place <= 4096 AS kept FROM ({within}) w JOIN ({after}) a ON w.bucket = a.bucket"


def _cache_compared(d: Spark) -> str:
    last = "SELECT user_id AS k, max(event_id) AS used, CAST(sum(floor(value)) AS BIGINT) AS bytes FROM events GROUP BY user_id"
    return f"SELECT k, used, bytes, CAST(sum(bytes) OVER (ORDER BY used DESC {RANGE}) AS BIGINT) AS held, sum(bytes) OVER (ORDER BY used DESC {RANGE}) <= 100000 AND row_number() OVER (ORDER BY used DESC) <= 4096 AS kept FROM ({last})"


def _props(d: Spark) -> str:
    """One key of JSON text."""
    return f"SELECT event_id, CAST({d.json_text('props', 'k')} AS BIGINT) AS k, {d.json_text('props', 'missing')} AS missing FROM events"


both("job_states", "H11 H16 H17 I11", _job_states)
both("job_stats", "I06 M20 I10", _job_stats)
both("job_pages", "J10 H20 B13", _job_pages, compared=_job_pages_plain)
both("job_eviction", "J11 H12 H14 H15", _eviction)
both("job_errors", "H18 I09", _errors)
both("webhook_attempts", "B07 B08", _webhooks)
both("access_logs", "B09 B10 B11 F19", _logs)
both("result_envelopes", "B02 B03 B04 B05 B06 E05 E35 F35 G08", _envelopes)
both("sessions_idle", "H06 H10", _sessions, compared=_sessions_compared)
both("size_settled", "H07", _settled)
both("host_spacing", "H19", _spacing)
both("retry_attempts", "H21 E36 F27 F28", _retries)
both("slot_gate", "H22 I10", _gate, compared=_gate_compared)
both("timing_buckets", "I07 M09", _buckets)
both("action_reports", "I12", _actions)
both("ladder_choice", "J15 M01 M02 M04 E18 F24 F25 F26 F30", _ladder)
both("header_functions", "A04 A11 F12 F13 F15 F20", _headers)
both("cache_recency", "J12", _cache, compared=_cache_compared)
both("props_json", "plumbing", _props)
