"""Queries on the staged ladder: pages with state, routes and requests, and the recorded answers to both.

The given pages have no framework state, so a mark is put at the end of each by its id; requests and answers are made of the events of the user
with the page's id. The SQL of the comparison knows which mark a page has and needs no parsing of pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.functions import signals as s
from webloom.functions.dialect import DUCK
from webloom.operators import ladder
from webloom.plans.base import only, run_sql

MARKED = """SELECT page_id, url, html || CASE page_id % 8 WHEN 0 THEN '<script id="__NEXT_DATA__" type="application/json">{"buildId":"b0","page":' || CAST(page_id AS VARCHAR(20)) || '}</script>'
    WHEN 1 THEN '<script type="application/ld+json">{"@type":"Product"}</script>' WHEN 2 THEN '<script id="__NEXT_DATA__">{"buildId": "bad", oops</script><script src="/_next/static/chunks/a.js"></script><script src="/_next/static/B2/_buildManifest.js"></script>'
    WHEN 3 THEN '<script>window.__BUILD_ID = "B3";</script>' WHEN 4 THEN '<script>self.__next_f.push([1])</script><script src="/_next/static/B4/_ssgManifest.js"></script>' WHEN 5 THEN '<script src="/_next/static/B5/x.js"></script>'
    WHEN 6 THEN '<script src="/_next/static/B6/_buildManifest.js"></script>' ELSE '' END AS html FROM pages"""
# What the pages ask for: users by fives ask for junk alone or change things, and by elevens meet a challenge.
REQUESTS = """SELECT user_id AS page_id, event_id AS seq, CASE WHEN user_id % 5 = 3 THEN CASE WHEN event_id % 2 = 0 THEN 'https://www.google-analytics.com/collect' ELSE '/static/app.js' END
        WHEN event_type = 'view' THEN '/api/items?id=' || CAST(event_id AS VARCHAR(20)) WHEN event_type = 'click' THEN '/v2/rows/' || CAST(event_id AS VARCHAR(20)) WHEN event_type = 'purchase' THEN 'https://api.other.example/graphql'
        WHEN event_type = 'signup' THEN 'wss://live.example/feed' WHEN user_id % 11 = 5 THEN 'https://px-cloud.net/ips.js' ELSE '/static/app.js' END AS url,
    CASE WHEN user_id % 5 = 2 THEN 'DELETE' WHEN event_type = 'purchase' THEN ' post' ELSE 'get' END AS method, CASE WHEN event_id % 3 = 0 THEN 'application/json' END AS accept, CASE WHEN event_id % 4 = 0 THEN '' END AS content_type FROM events"""
ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
ROUTE = f"{ORIGIN} || '/_next/data/B' || CAST(page_id % 8 AS VARCHAR(20)) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || '.json' || regexp_extract(url, '^[^?#]*([?][^#]*)', 1)"
AT = "CASE WHEN r.url LIKE '/%' THEN p.origin || r.url ELSE r.url END"
ANSWERS = f"""SELECT CAST(page_id AS BIGINT) AS seq, 'GET' AS method, {ROUTE} AS url, CASE WHEN page_id % 8 = 3 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 8 = 5 THEN '<html>' ELSE '{{"route":' || CAST(page_id AS VARCHAR(20)) || '}}' END AS body FROM pages WHERE page_id % 8 IN (2, 3, 5)
    UNION ALL SELECT r.seq, r.method, {AT} AS url, CASE WHEN r.seq % 6 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN r.seq % 7 = 0 THEN 'oops' ELSE '{{"seq":' || CAST(r.seq AS VARCHAR(20)) || '}}' END AS body
    FROM ({REQUESTS}) r JOIN (SELECT page_id, {ORIGIN} AS origin FROM pages) p ON p.page_id = r.page_id WHERE r.seq % 10 <> 3"""
RENDERED = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '<p>' || repeat('word ', 300) || '</p>' ELSE '<p>wall</p>' END AS rendered_html FROM pages"


def _inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [run_sql(spark, sf_dir, text) for text in (MARKED, ANSWERS, REQUESTS, RENDERED)]


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage that yields a page's data, and the steps to it."""
    return ladder.data_of_pages(*_inputs(spark, sf_dir)).selectExpr("page_id", "status", "tier", "detail", "data", "array_join(trace, '; ') AS trace")


def _discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog counts of every page and the data of a replay on top, up to three requests being tried."""
    pages, answers, requests, rendered = _inputs(spark, sf_dir)
    return ladder.discovered(pages, requests, answers, rendered, tries=3)


def _replays(tries: int) -> str:
    """Common tables of the comparison: a (answers), q (scored requests), n (sums), t (what is tried), g (the first good one)."""
    rows = f"SELECT r.page_id, r.seq, r.url, r.method, coalesce(r.accept, '') AS accept, coalesce(r.content_type, '') AS content_type, p.url AS target FROM ({REQUESTS}) r JOIN pages p ON p.page_id = r.page_id"
    return f"""a AS MATERIALIZED (SELECT upper(trim(method)) AS method, url, arg_min(status, seq) AS status, arg_min(body, seq) AS body FROM ({ANSWERS}) GROUP BY ALL),
    q AS MATERIALIZED (SELECT *, {s.network_challenge(DUCK, "url")} AS challenge, score >= 13 AND replayable AS fit FROM ({s.scored(DUCK, rows)})),
    n AS (SELECT page_id, count(*) AS n_requests, count(*) FILTER (fit) AS n_replayable, arg_min(challenge, seq) FILTER (challenge IS NOT NULL) AS challenge, bool_or(score >= 13) AS viable, bool_or(fit) AS safe FROM q GROUP BY page_id),
    t AS (SELECT q.page_id, q.score, upper(trim(q.method)) AS method, CASE WHEN q.url LIKE '/%' THEN regexp_extract(q.target, '^([a-z]+://[^/?#]*)', 1) || q.url ELSE q.url END AS asked, row_number() OVER (PARTITION BY q.page_id ORDER BY q.score DESC, q.seq) AS place FROM q WHERE fit QUALIFY place <= {tries}),
    m AS (SELECT t.*, a.status, a.body, coalesce(a.status BETWEEN 200 AND 299 AND json_valid(a.body), false) AS good FROM t LEFT JOIN a ON a.method = t.method AND a.url = t.asked),
    g AS (SELECT page_id, bool_or(place = 1 AND status IS NULL) AS lost, arg_min(method || ' ' || asked || ' (score ' || score || ')', place) FILTER (good) AS detail, arg_min(body, place) FILTER (good) AS replay FROM m GROUP BY page_id),
    k AS (SELECT p.page_id, n.* EXCLUDE (page_id), g.* EXCLUDE (page_id), n.challenge IS NOT NULL AND p.page_id % 3 <> 1 AS blocked FROM pages p LEFT JOIN n ON n.page_id = p.page_id LEFT JOIN g ON g.page_id = p.page_id)"""


_DATA = f"""WITH {_replays(1)},
    r AS (SELECT p.page_id, p.route, a.body FROM (SELECT page_id, {ROUTE} AS route FROM pages WHERE page_id % 8 = 2) p LEFT JOIN a ON a.method = 'GET' AND a.url = p.route),
    late AS (SELECT page_id, CASE WHEN blocked THEN 'needs_browser' WHEN replay IS NOT NULL THEN 'success' WHEN lost THEN 'error' ELSE 'unsupported' END AS status, detail, replay,
        'runtime.capture ' || coalesce('matched: ' || n_requests, 'missed') || '; ' || CASE WHEN blocked THEN 'core.challenge matched: network:' || challenge WHEN replay IS NOT NULL THEN 'runtime.replay matched: ' || detail
            WHEN lost THEN 'runtime.replay failed' WHEN viable AND NOT safe THEN 'runtime.rank missed: {ladder.UNSAFE}' ELSE 'runtime.rank missed: {ladder.NO_VIABLE}' END AS steps FROM k)
    SELECT page_id, 'success' AS status, 'static' AS tier, CASE page_id % 8 WHEN 0 THEN 'next_data' ELSE 'json_ld' END AS detail, CASE page_id % 8 WHEN 0 THEN '{{"buildId": "b0", "page": ' || page_id || '}}' ELSE '[{{"@type": "Product"}}]' END AS data,
        CASE page_id % 8 WHEN 0 THEN 'static.next_data matched' ELSE 'static.json_ld matched' END AS trace FROM pages WHERE page_id % 8 < 2
    UNION ALL SELECT page_id, 'success', 'heuristic_api_replay', route, body, 'static.scan missed; tier1.parse matched' FROM r
    UNION ALL SELECT l.page_id, status, CASE WHEN status = 'success' THEN 'runtime_interception' END, CASE WHEN status = 'success' THEN detail END, CASE WHEN status = 'success' THEN replay END,
        'static.scan missed; ' || CASE l.page_id % 8 WHEN 3 THEN 'tier1.replay missed: 404' WHEN 4 THEN 'tier1.build_id skipped' WHEN 5 THEN 'tier1.parse failed' WHEN 6 THEN 'tier1.replay failed' ELSE 'tier1.build_id missed' END || '; ' || steps FROM late l WHERE l.page_id % 8 > 2"""

_DISCOVERY = f"""WITH {_replays(3)}
    SELECT page_id, CASE WHEN blocked THEN 'needs_browser' ELSE 'success' END AS status, CASE WHEN blocked THEN 0 ELSE coalesce(n_requests, 0) END AS n_endpoints, CASE WHEN blocked THEN 0 ELSE coalesce(n_replayable, 0) END AS n_replayable,
        CASE WHEN NOT blocked THEN detail END AS detail, CASE WHEN NOT blocked THEN replay END AS data FROM k"""

only("data_ladder", "M01 M02 F34 E12 D11 D15 D16 E38", _data, _DATA)
only("discovery_replays", "M03 M06 I05 L13", _discovery, _DISCOVERY)
