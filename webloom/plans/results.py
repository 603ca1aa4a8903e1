"""Queries on results: filtered data, rendering, traces, labels, header lists, sessions and capture windows.

Their SQL for the comparison is written apart from what the engine runs: recursion in place of folds, joins and
aggregates in place of arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import records as r
from webloom.functions import signals as s
from webloom.functions.dialect import DUCK, SPARK, Spark
from webloom.functions.jsonpath import filter_json
from webloom.operators import folds
from webloom.plans.base import only, run_sql, table
from webloom.plans.requests import INTERCEPTS

IDLE, LIFE = 3_600_000_000, 6 * 3_600_000_000
QUIET, CAP, MOST = 1_800_000_000, 8_000_000_000, 64

# JSON bodies with as many items as the remainder of the id by three.
BODIES = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '{broken' ELSE '{"kind":"' || event_type || '","items":[' ||
    CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '{"id":' || CAST(event_id AS VARCHAR(20)) || '}' ELSE '{"id":' || CAST(event_id AS VARCHAR(20)) || ',"at":{"id":"x"}},{"id":' || CAST(user_id AS VARCHAR(20)) || '}' END || ']}' END AS body FROM events"""


def _json_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D24, D25."""
    return filter_json(run_sql(spark, sf_dir, BODIES), "event_id", "body", "$.items[*].id")


_JSON_FILTERED = f"""WITH b AS (SELECT event_id, body, CASE WHEN json_valid(body) THEN json_extract(body, '$.items[*].id') END AS found FROM ({BODIES}))
    SELECT event_id, CASE len(found) WHEN 0 THEN NULL WHEN 1 THEN CAST(found[1] AS VARCHAR) ELSE CAST(to_json(found) AS VARCHAR) END AS data,
        CASE WHEN body IS NULL THEN 'no_data' WHEN found IS NULL THEN 'unreadable' WHEN len(found) = 0 THEN 'none' WHEN len(found) = 1 THEN 'single' ELSE 'many' END AS outcome,
        CASE WHEN len(found) = 0 THEN '`$.items[*].id` matched no nodes; data set to null' END AS note FROM b"""


# Actions that stand for a session's steps.
ACTIONS = """SELECT event_id, user_id, CASE event_id % 8 WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 2 THEN 'press' WHEN 3 THEN 'scroll' WHEN 4 THEN 'select' WHEN 5 THEN 'hover' ELSE 'wait' END AS type,
    CASE WHEN event_id % 8 IN (0, 4, 5) OR event_id % 3 = 0 THEN '#' || event_type END AS selector, CASE WHEN event_id % 8 = 2 THEN 'Enter' END AS key,
    CASE WHEN event_id % 5 = 0 THEN 'up' END AS direction, CASE WHEN event_id % 7 <> 0 THEN event_id % 1000 END AS milliseconds FROM events"""
_ACTION_LABELS = f"""SELECT event_id, 'click ' || selector AS label FROM ({ACTIONS}) WHERE type = 'click' UNION ALL SELECT event_id, 'type ' || ifnull(selector, '<focused>') FROM ({ACTIONS}) WHERE type = 'type'
    UNION ALL SELECT event_id, 'press ' || key FROM ({ACTIONS}) WHERE type = 'press' UNION ALL SELECT event_id, 'scroll ' || ifnull(ifnull(selector, direction), 'down') FROM ({ACTIONS}) WHERE type = 'scroll'
    UNION ALL SELECT event_id, type || ' ' || selector FROM ({ACTIONS}) WHERE type IN ('select', 'hover') UNION ALL SELECT event_id, 'wait ' || selector FROM ({ACTIONS}) WHERE type = 'wait' AND selector IS NOT NULL
    UNION ALL SELECT event_id, printf('wait %dms', milliseconds) FROM ({ACTIONS}) WHERE type = 'wait' AND selector IS NULL AND milliseconds IS NOT NULL
    UNION ALL SELECT event_id, 'wait' FROM ({ACTIONS}) WHERE type = 'wait' AND selector IS NULL AND milliseconds IS NULL"""


def _action_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F36."""
    return run_sql(spark, sf_dir, ACTIONS).select("event_id", r.action_label(*map(F.col, ("type", "selector", "key", "direction", "milliseconds"))).alias("label"))


# Explicit headers and structured cookies of a request.
REQUESTS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'cookie' WHEN 1 THEN 'Cookie' END AS cookie_name, CASE WHEN event_id % 8 < 4 THEN 'sid=' || CAST(user_id AS VARCHAR(20)) ELSE '  ' END AS cookie_value,
    event_type, CAST(user_id AS VARCHAR(20)) AS who, event_id % 3 AS n_cookies FROM events"""


def _cookie_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14, M21."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name") if isinstance(n, str) else n.alias("name"), v.alias("value"))
    given = F.filter(F.array(pair("Accept", F.col("event_type")), pair(F.col("cookie_name"), F.col("cookie_value")), pair("X-Who", F.col("who"))), lambda h: h["name"].isNotNull())
    cookies = F.slice(F.array(pair("zz", F.col("who")), pair("aa", F.col("event_type"))), F.lit(1), F.col("n_cookies").cast("int"))
    merged = r.merge_cookies(given, cookies)
    return run_sql(spark, sf_dir, REQUESTS).select("event_id", F.array_join(F.transform(merged, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n").alias("headers"))


_COOKIE_HEADERS = f"""WITH q AS (SELECT *, CASE n_cookies WHEN 1 THEN 'zz=' || who WHEN 2 THEN 'aa=' || event_type || '; zz=' || who END AS made FROM ({REQUESTS})),
    h AS (SELECT event_id, 1 AS place, 'Accept: ' || event_type AS line FROM q UNION ALL SELECT event_id, 2, cookie_name || ': ' || cookie_value FROM q WHERE n_cookies = 0 AND cookie_name IS NOT NULL
        UNION ALL SELECT event_id, 3, 'X-Who: ' || who FROM q UNION ALL SELECT event_id, 4, 'Cookie: ' || CASE WHEN cookie_name IS NOT NULL AND trim(cookie_value) <> '' THEN cookie_value || '; ' ELSE '' END || made FROM q WHERE n_cookies > 0)
    SELECT event_id, string_agg(line, chr(10) ORDER BY place) AS headers FROM h GROUP BY event_id"""


ADDRESSES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'https://h.example' WHEN 1 THEN 'https://h.example/a%20b/?q=x+y&e=%C3%A9&flag&=v&a=b=c' WHEN 2 THEN '/rel/p?k=' || event_type || '&&z=' WHEN 3 THEN '?only=1#f'
    WHEN 4 THEN 'http://u@h.example:8080/p/' || CAST(user_id AS VARCHAR(20)) || '#x?y=1' ELSE '' END AS url FROM events"""


def _query_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    path, pairs = r.path_and_pairs("url")
    df = run_sql(spark, sf_dir, ADDRESSES).select("event_id", path.alias("path"), pairs.alias("pairs"))
    return df.select("event_id", "path", F.size("pairs").cast("long").alias("n"), F.array_join(F.transform("pairs", lambda p: F.concat(p["name"], F.lit("→"), p["value"])), "|").alias("pairs"))


# The expected rows are literal: one for each shape of address.
_QUERY_PAIRS = """SELECT event_id, CASE event_id % 6 WHEN 1 THEN '/a%20b/' WHEN 2 THEN '/rel/p' WHEN 4 THEN '/p/' || CAST(user_id AS VARCHAR) ELSE '/' END AS path, CAST(CASE event_id % 6 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS n,
    CASE event_id % 6 WHEN 1 THEN 'q→x y|e→é|flag→|→v|a→b=c' WHEN 2 THEN 'k→' || event_type || '|z→' WHEN 3 THEN 'only→1#f' ELSE '' END AS pairs FROM events"""


RENDERED = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS markdown, doc_id % 2 = 0 AS as_json, doc_id % 3 <> 0 AS only_markdown FROM documents"""


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B01."""
    envelope = F.to_json(F.struct(F.lit("success").alias("status"), "doc_id", "markdown"))
    return run_sql(spark, sf_dir, RENDERED).select("doc_id", r.rendered(F.col("markdown"), envelope, F.col("as_json"), F.col("only_markdown")).alias("output"))


_RENDERED = f"""WITH q AS (SELECT * FROM ({RENDERED})) SELECT doc_id, markdown || chr(10) AS output FROM q WHERE NOT as_json AND only_markdown AND trim(markdown) <> ''
    UNION ALL SELECT doc_id, '{{"status":"success","doc_id":' || CAST(doc_id AS VARCHAR) || CASE WHEN markdown IS NULL THEN '' ELSE ',"markdown":' || CAST(to_json(markdown) AS VARCHAR) END || '}}' || chr(10) FROM q
    WHERE as_json OR NOT only_markdown OR coalesce(trim(markdown), '') = ''"""


RUNS = """SELECT event_id AS run, event_id % 2 = 0 AS runtime_log, event_id % 3 AS n_logs, event_id % 4 AS n_warnings, event_type, CAST(floor(value) AS BIGINT) AS ms FROM events"""


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a run; log lines where asked for, and warnings, charge no time."""
    runs = run_sql(spark, sf_dir, RUNS)
    named = lambda word, n: F.slice(F.array(*(F.concat(F.lit(f"{word} {i} of "), "event_type") for i in range(3))), F.lit(1), n.cast("int"))
    base = F.array(r.step("static", "fetch", "matched", F.col("ms")))
    trace = r.with_warnings(r.with_logs(base, named("log", F.col("n_logs")), F.col("runtime_log")), "static", named("field", F.col("n_warnings")))
    return runs.select("run", trace.alias("trace")).select(
        "run", F.array_join(F.transform("trace", lambda t: F.concat_ws(":", t["tier"], t["action"])), ",").alias("steps"), F.array_join(r.warnings_of(F.col("trace")), "|").alias("extract_warnings"),
        F.aggregate("trace", F.lit(0).cast("long"), lambda a, t: a + t["elapsed_ms"]).alias("total_ms"),
    )


_TRACES = f"""SELECT run, 'static:fetch' || CASE WHEN runtime_log THEN repeat(',runtime_interception:runtime.log', n_logs) ELSE '' END || repeat(',static:extract.warning', CAST(least(n_warnings, 3) AS BIGINT)) AS steps,
    array_to_string(list_transform(range(CAST(least(n_warnings, 3) AS BIGINT)), lambda i: 'field ' || CAST(i AS VARCHAR) || ' of ' || event_type), '|') AS extract_warnings, ms AS total_ms FROM ({RUNS})"""


# Answers of search engines: a time-out, an HTTP code, an error's text, or hits.
ANSWERS = """SELECT event_id AS search, CASE user_id % 5 WHEN 0 THEN 'duckduckgo' WHEN 1 THEN 'bing' WHEN 2 THEN 'baidu' WHEN 3 THEN 'yandex' ELSE 'brave' END AS engine, event_type = 'signup' AS timed_out,
    CASE WHEN event_type = 'click' THEN 403 ELSE 200 END AS code, CASE WHEN event_type = 'error' THEN 'bad "body"' END AS message, event_id % 3 AS hits, event_type || ' é&' AS wanted FROM events"""
ENGINES = {"duckduckgo": ("https://html.duckduckgo.com/html/", "q"), "bing": ("https://www.bing.com/search?setlang=en", "q"), "baidu": ("https://www.baidu.com/s", "wd"), "yandex": ("https://yandex.com/search/", "text"), "brave": ("https://search.brave.com/search", "q")}  # fixed addresses and parameters


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09, A10, M14, D38."""
    url = F.coalesce(*(F.when(F.col("engine") == e, r.search_url(F.lit(base), name, F.col("wanted"))) for e, (base, name) in ENGINES.items()))
    return run_sql(spark, sf_dir, ANSWERS).select("search", r.engine_outcome(*map(F.col, ("engine", "timed_out", "code", "message", "hits"))).alias("outcome"), url.alias("search_url"))


_DIAGNOSTICS = f"""SELECT search, '{{"engine":"' || engine || '","status":"' || CASE WHEN timed_out THEN 'timeout"' WHEN message IS NOT NULL THEN 'error","message":' || CAST(to_json(message) AS VARCHAR) WHEN code <> 200 THEN 'http","code":' || CAST(code AS VARCHAR)
        WHEN hits = 0 THEN 'empty"' ELSE 'ok","results":' || CAST(hits AS VARCHAR) END || '}}' AS outcome,
    CASE engine WHEN 'duckduckgo' THEN 'https://html.duckduckgo.com/html/?q=' WHEN 'bing' THEN 'https://www.bing.com/search?setlang=en&q=' WHEN 'baidu' THEN 'https://www.baidu.com/s?wd=' WHEN 'yandex' THEN 'https://yandex.com/search/?text=' ELSE 'https://search.brave.com/search?q=' END
        || replace(split_part(wanted, ' ', 1), ' ', '+') || '+%C3%A9%26' AS search_url FROM ({ANSWERS})"""


ROUTES = """SELECT event_id, 'b' || CAST(user_id AS VARCHAR(20)) AS build, CASE event_id % 6 WHEN 0 THEN '/' WHEN 1 THEN '/a/b//' WHEN 2 THEN 'plain' WHEN 3 THEN ' /sp ' WHEN 4 THEN '' ELSE '//' END AS path,
    CASE WHEN event_id % 4 = 0 THEN 'x y' WHEN event_id % 4 = 1 THEN 'é~*&' END AS q FROM events"""


def _data_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15."""
    pairs = F.when(F.col("q").isNull(), F.array().cast("array<struct<name:string,value:string>>")).otherwise(F.array(F.struct(F.lit("q").alias("name"), F.col("q").alias("value")), F.struct(F.lit("n").alias("name"), F.lit("1").alias("value"))))
    return run_sql(spark, sf_dir, ROUTES).select("event_id", r.data_route(F.col("build"), F.col("path"), pairs).alias("route"))


_DATA_ROUTES = f"""SELECT event_id, '/_next/data/' || build || CASE event_id % 6 WHEN 1 THEN '/a/b' WHEN 2 THEN '/plain' WHEN 3 THEN '/sp' ELSE '/index' END || '.json' || CASE q WHEN 'x y' THEN '?q=x%20y&n=1' WHEN 'é~*&' THEN '?q=%C3%A9~%2A%26&n=1' ELSE '' END AS route FROM ({ROUTES})"""


def _job_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status body of each job, three items from the second on; unfinished jobs always have a next page."""
    return run_sql(
        spark, sf_dir,
        """SELECT job, status, total, completed, completed AS credits_used, created + 86400000000 AS expires_at, shown, to_json(named_struct('success', true, 'status', status, 'total', total, 'completed', completed, 'creditsUsed', completed,
            'next', CASE WHEN status = 'scraping' OR 1 + shown < completed THEN concat('/v1/', job, '?skip=', least(1, completed) + shown, '&limit=3') END)) AS body FROM (SELECT *, least(greatest(completed - 1, 0), 3) AS shown FROM (
            SELECT user_id AS job, count(*) AS total, count_if(event_type <> 'error') AS completed, unix_micros(CAST(min(ts) AS TIMESTAMP)) AS created, CASE WHEN user_id % 4 = 0 THEN 'scraping' ELSE 'completed' END AS status FROM events GROUP BY user_id))""",
    )


_JOB_BODIES = """WITH n AS (SELECT user_id AS job, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY event_id) - 1 AS place, event_type <> 'error' AS page FROM events),
    j AS (SELECT job, count(*) AS total, sum(CASE WHEN page THEN 1 ELSE 0 END) AS completed, epoch_us(min(ts)) + 86400000000 AS expires_at, sum(CASE WHEN page AND place BETWEEN 1 AND 3 THEN 1 ELSE 0 END) AS shown, CASE WHEN job % 4 = 0 THEN 'scraping' ELSE 'completed' END AS status FROM n GROUP BY job)
    SELECT job, status, total, CAST(completed AS BIGINT) AS completed, CAST(completed AS BIGINT) AS credits_used, expires_at, CAST(shown AS BIGINT) AS shown,
        '{"success":true,"status":"' || status || '","total":' || CAST(total AS VARCHAR) || ',"completed":' || CAST(completed AS VARCHAR) || ',"creditsUsed":' || CAST(completed AS VARCHAR)
        || CASE WHEN status = 'scraping' OR completed > shown + 1 THEN ',"next":"/v1/' || CAST(job AS VARCHAR) || '?skip=' || CAST(shown + least(completed, 1) AS VARCHAR) || '&limit=3"' ELSE '' END || '}' AS body FROM j"""


def _finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the 0-based place of a needle, null where there is none; an empty one is at 0."""
    docs = table(spark, sf_dir, "documents")
    at = lambda needle: r.find_ignoring_case(F.col("text"), F.lit(needle))
    return docs.select("doc_id", at("THE").alias("word_at"), at("").alias("empty_at"), at("É").alias("accent_at"), at("no such thing").alias("none_at"))


_FINDS = """SELECT doc_id, nullif(strpos(replace(replace(replace(text, 'T', 't'), 'H', 'h'), 'E', 'e'), 'the'), 0) - 1 AS word_at, CAST(CASE WHEN text IS NOT NULL THEN 0 END AS BIGINT) AS empty_at, nullif(strpos(text, 'É'), 0) - 1 AS accent_at,
    nullif(strpos(lower(text), 'no such thing'), 0) - 1 AS none_at FROM documents"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetimes count from a session's own opening."""
    rows = run_sql(spark, sf_dir, "SELECT user_id, event_id, unix_micros(CAST(ts AS TIMESTAMP)) AS tm FROM events WHERE ts IS NOT NULL")
    return folds.fold_segments(rows, ["user_id"], ["tm", "event_id"], [], folds.Sessions.FIELDS, lambda: folds.Sessions(IDLE, LIFE))


_SESSIONS = f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT user_id, n, tm, tm AS opened, CAST(NULL AS VARCHAR) AS why FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.n, e.tm, CASE WHEN e.tm - w.tm > {IDLE} OR e.tm - w.opened > {LIFE} THEN e.tm ELSE w.opened END, CASE WHEN e.tm - w.tm > {IDLE} THEN 'idle' WHEN e.tm - w.opened > {LIFE} THEN 'lifetime' END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1),
    g AS (SELECT user_id, opened, max(tm) AS last_at, count(*) AS n, max(why) AS began FROM w GROUP BY user_id, opened)
    SELECT user_id, opened, last_at, n, coalesce(lead(began) OVER (PARTITION BY user_id ORDER BY opened), 'idle') AS ended FROM g"""


def _intercepts(d: Spark) -> str:
    return f"SELECT page_id, seq, {d.micros('ts')} AS tm, {d.micros('ts')} + CAST(floor(value * 10000000) AS BIGINT) AS done, {s.is_tracker(d, 'url')} AS tracker, score >= {s.MIN_VIABLE} AS hit, seq % 97 = 0 AS threw FROM ({s.scored(d, INTERCEPTS)})"


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window that the hard cap closes ends there, and the next request opens another."""
    rows = run_sql(spark, sf_dir, _intercepts(SPARK))
    return folds.fold_segments(rows, ["page_id"], ["tm", "seq"], ["done", "tracker", "hit", "threw"], folds.Captures.FIELDS, lambda: folds.Captures(QUIET, CAP, MOST))


_CAPTURES = f"""WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tm, seq) AS n FROM ({_intercepts(DUCK)})),
    w AS (SELECT page_id, n, CASE WHEN NOT tracker THEN tm END AS opened, CASE WHEN NOT tracker THEN done END AS busy, NOT tracker AS content, NOT tracker AS inside, hit, threw FROM i WHERE n = 1
        UNION ALL SELECT i.page_id, i.n, CASE WHEN i.tm <= least(w.busy + {QUIET}, w.opened + {CAP}) THEN w.opened WHEN NOT i.tracker THEN i.tm END,
            CASE WHEN i.tm <= least(w.busy + {QUIET}, w.opened + {CAP}) THEN CASE WHEN i.tracker THEN w.busy ELSE greatest(w.busy, i.done) END WHEN NOT i.tracker THEN i.done END,
            NOT i.tracker, NOT i.tracker OR coalesce(i.tm <= least(w.busy + {QUIET}, w.opened + {CAP}), false), i.hit, i.threw FROM w JOIN i ON i.page_id = w.page_id AND i.n = w.n + 1),
    c AS (SELECT *, row_number() OVER (PARTITION BY page_id, opened, content ORDER BY n) AS place FROM w WHERE inside),
    g AS (SELECT page_id, opened, max(busy) + {QUIET} AS quiet_at, opened + {CAP} AS cap_at, sum(CASE WHEN content AND place <= {MOST} THEN 1 ELSE 0 END) AS n_content, sum(CASE WHEN content AND place <= {MOST} AND hit THEN 1 ELSE 0 END) AS n_hits,
        sum(CASE WHEN content THEN 0 ELSE 1 END) AS n_trackers, bool_or(content AND threw) AS blew FROM c GROUP BY page_id, opened)
    SELECT page_id, opened, least(quiet_at, cap_at) AS closes, CAST(n_content AS BIGINT) AS n_content, CAST(n_hits AS BIGINT) AS n_hits, CAST(n_trackers AS BIGINT) AS n_trackers,
        CASE WHEN n_hits > 0 AND quiet_at > cap_at THEN 'window_closed' WHEN n_hits > 0 THEN 'quiesced' WHEN blew THEN 'threw' ELSE 'no_intercepts' END AS outcome FROM g"""


LIMITS = "SELECT event_id, event_id % 3 AS verb, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value * 300) AS BIGINT) - 100 END AS given FROM events"


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J09, M17."""
    clamps = [("map", 1, 100_000, 5000), ("crawl", 1, 100, 10), ("map_tool", 1, 5000, 100)]  # fixed limits and defaults
    verb = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in clamps)), F.col("verb").cast("int") + 1).cast("string" if i == 0 else "long")
    return run_sql(spark, sf_dir, LIMITS).select("event_id", verb(0).alias("name"), F.least(F.greatest(F.coalesce("given", verb(3)), verb(1)), verb(2)).alias("n"))


_LIMITS = f"""SELECT event_id, CASE verb WHEN 0 THEN 'map' WHEN 1 THEN 'crawl' ELSE 'map_tool' END AS name, CASE WHEN given IS NULL THEN CASE verb WHEN 0 THEN 5000 WHEN 1 THEN 10 ELSE 100 END WHEN given < 1 THEN 1
    WHEN verb = 0 AND given > 100000 THEN 100000 WHEN verb = 1 AND given > 100 THEN 100 WHEN verb = 2 AND given > 5000 THEN 5000 ELSE given END AS n FROM ({LIMITS})"""


only("json_filtered", "D24 D25", _json_filtered, _JSON_FILTERED)
only("action_labels", "F36", _action_labels, _ACTION_LABELS)
only("cookie_headers", "F14", _cookie_headers, _COOKIE_HEADERS)
only("query_pairs", "F10", _query_pairs, _QUERY_PAIRS)
only("rendered_results", "B01", _rendered, _RENDERED)
only("trace_steps", "M07 M08 I09", _traces, _TRACES)
only("engine_diagnostics", "A09 A10 M14 D38", _diagnostics, _DIAGNOSTICS)
only("data_routes", "D15", _data_routes, _DATA_ROUTES)
only("job_bodies", "B13", _job_bodies, _JOB_BODIES)
only("text_finds", "F18", _finds, _FINDS)
only("sessions_restarted", "H06 H09", _sessions, _SESSIONS)
only("capture_windows", "H01 H02 H03 H04 H05", _captures, _CAPTURES)
only("limit_clamps", "J09 M17", _limits, _LIMITS)
