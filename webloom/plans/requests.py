"""Queries on intercepted requests, access rules, challenge pages and fused search hits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import signals as s
from webloom.functions import text as t
from webloom.functions import urls as u
from webloom.functions.dialect import DUCK, SPARK, Spark
from webloom.operators import rules
from webloom.operators.ranks import numbered
from webloom.plans.base import both, only, run_sql

# Requests that stand in for an intercept log: the event's type picks a shape.
INTERCEPTS = """SELECT user_id AS page_id, event_id AS seq, ts, value, 'https://site' || CAST(user_id % 5 AS VARCHAR(10)) || '.example/' AS target,
    CASE event_type WHEN 'view' THEN 'https://site' || CAST(user_id % 5 AS VARCHAR(10)) || '.example/api/items?id=' || CAST(event_id AS VARCHAR(20)) WHEN 'click' THEN '/v2/rows' WHEN 'purchase' THEN 'https://api.other.example/graphql'
        WHEN 'signup' THEN 'https://www.google-analytics.com/collect' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'wss://live.example/feed' WHEN event_id % 3 = 1 THEN '/static/app.js' ELSE '/px-cloud.net/ips.js' END END AS url,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'POST' ELSE ' put' END WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'DELETE' ELSE 'get' END AS method,
    CASE WHEN event_id % 7 < 4 THEN 'text/html, application/json' WHEN event_id % 7 = 5 THEN 'text/event-stream' ELSE '' END AS accept, CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'application/vnd.x+json' ELSE '' END AS content_type FROM events"""


def _scored(d: Spark) -> str:
    return s.scored(d, INTERCEPTS)


def _scores(d: Spark) -> str:
    return f"""SELECT seq, CAST(score AS INT) AS score, replayable, analytics, {s.is_tracker(d, "url")} AS tracker, same_origin, asset, {s.is_safe("method")} AS safe,
        {s.is_read_post(d, "method", "url", "content_type", "url_path")} AS read_post, {s.is_streaming(d, "url", "accept")} AS streaming, json_intent, replayable AND NOT analytics AS live,
        {s.network_challenge(d, "url")} AS challenge FROM ({_scored(d)})"""


def _best(d: Spark) -> str:
    return f"""SELECT page_id, max(CASE WHEN r = 1 THEN seq END) AS best_seq, CAST(max(score) AS INT) AS best_score, min(CASE WHEN replayable THEN seq_r END) AS replay_seq, count(*) AS n_viable,
        CASE WHEN max(CASE WHEN replayable THEN 1 ELSE 0 END) = 1 THEN 'replay' ELSE 'viable but not eligible' END AS reason FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seq) AS r,
            CASE WHEN row_number() OVER (PARTITION BY page_id, replayable ORDER BY score DESC, seq) = 1 THEN seq END AS seq_r FROM ({_scored(d)}) WHERE score >= {s.MIN_VIABLE}) GROUP BY page_id"""


def _catalog(d: Spark) -> str:
    return f"""SELECT page_id, seq, upper(trim(method)) AS method, url, CAST(score AS INT) AS score, replayable, CAST(n AS BIGINT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seq) AS n FROM ({_scored(d)})) WHERE n <= 20"""


def _counts(d: Spark) -> str:
    return f"""SELECT page_id, count(*) AS n_endpoints, CAST(sum(CASE WHEN replayable THEN 1 ELSE 0 END) AS BIGINT) AS n_replayable, CAST(sum(CASE WHEN NOT {s.is_tracker(d, "url")} THEN 1 ELSE 0 END) AS BIGINT) AS n_content,
        min(CASE WHEN challenge IS NOT NULL THEN seq END) AS first_challenge FROM (SELECT *, {s.network_challenge(d, "url")} AS challenge FROM ({_scored(d)})) GROUP BY page_id"""


def _replay(d: Spark) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seq) AS r FROM ({_scored(d)}) WHERE score >= {s.MIN_VIABLE} AND replayable"
    bodies = "SELECT event_id AS seq, props AS body, CASE WHEN event_id % 6 = 0 THEN 404 ELSE 200 END AS status FROM events"
    return f"""SELECT a.page_id, a.seq, a.url, b.status, CASE WHEN b.status BETWEEN 200 AND 299 THEN {d.json_text("b.body", "k")} END AS k,
        CASE WHEN b.status BETWEEN 200 AND 299 THEN 'success' ELSE 'needs_browser' END AS outcome FROM ({ranked}) a LEFT JOIN ({bodies}) b ON a.seq = b.seq WHERE a.r = 1"""


ROBOTS = (
    ("example.org", "# all\nUser-agent: *\nDisallow: /fr/\nAllow: /fr/1\nDisallow: /*.php$\nSitemap: https://example.org/map.xml # main\n\nUser-agent: WebLoom\nDisallow: /en/2\nAllow: /en/22\nDisallow:\nsitemap: https://example.org/b.xml"),
    ("example.com", "User-Agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /de/*?page=\nAllow: /de/1\nDisallow: /en/"),
    ("example.net", ""),
)
AGENT = "webloom"


def _robot_lines(d: Spark) -> str:
    rows = ", ".join(f"({d.lit(h)}, {d.lit(b)})" for h, b in ROBOTS)
    lines = d.explode(f"SELECT site, body FROM (VALUES {rows}) AS v(site, body)", "site", d.split("body", "\n"), "line")
    clean = f"SELECT site, pos, trim({d.replace('line', '#.*$')}) AS line FROM ({lines})"
    return f"SELECT site, pos, lower(trim({d.extract('line', '^([^:]*):')})) AS k, trim({d.extract('line', '^[^:]*:(.*)$')}) AS v FROM ({clean}) WHERE {d.rlike('line', ':')}"


def _robot_rules(d: Spark) -> str:
    lines = _robot_lines(d)
    marked = f"SELECT *, CASE WHEN k = 'user-agent' AND coalesce(lag(k) OVER (PARTITION BY site ORDER BY pos), '') <> 'user-agent' THEN 1 ELSE 0 END AS opens FROM ({lines}) WHERE k IN ('user-agent', 'allow', 'disallow')"
    grouped = f"SELECT *, sum(opens) OVER (PARTITION BY site ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ({marked})"
    agents = f"SELECT site, g, max(CASE WHEN v <> '*' AND (contains('{AGENT}', lower(v)) OR contains(lower(v), '{AGENT}')) THEN 2 WHEN v = '*' THEN 1 ELSE 0 END) AS fit FROM ({grouped}) WHERE k = 'user-agent' GROUP BY site, g"
    chosen = f"SELECT site, g FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY fit DESC, g) AS r FROM ({agents}) WHERE fit > 0) WHERE r = 1"
    return f"SELECT a.site, a.k, a.v FROM ({grouped}) a JOIN ({chosen}) c ON a.site = c.site AND a.g = c.g WHERE a.k IN ('allow', 'disallow') AND a.v <> ''"


def _targets(d: Spark) -> str:
    site = d.extract("host", r"([^.]+\.[^.]+)$")
    target = d.replace(d.replace("url", r"#.*$"), r"^[A-Za-z]+://[^/?#]*")
    return f"SELECT page_id, {site} AS site, CASE WHEN {target} = '' THEN '/' ELSE {target} END AS target FROM (SELECT page_id, url, {u.host(d, 'url')} AS host FROM pages)"


def _decided_plain(d: Spark, rules: str) -> str:
    """For the check: every rule of a site (site, k, v) with every page of it."""
    hits = f"SELECT p.page_id, r.k, r.v, length(r.v) AS size, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.v) DESC, r.k, r.v DESC) AS n FROM ({_targets(d)}) p JOIN (SELECT DISTINCT * FROM ({rules})) r ON p.site = r.site WHERE {s.rule_fits(d, 'r.v', 'p.target')}"
    return f"SELECT p.page_id, p.site, coalesce(h.v, '') AS pattern, coalesce(h.k, 'none') AS rule, coalesce(h.k <> 'disallow', true) OR p.target = '/robots.txt' AS allowed FROM ({_targets(d)}) p LEFT JOIN (SELECT * FROM ({hits}) WHERE n = 1) h ON p.page_id = h.page_id"


def _decided(spark: SparkSession, sf_dir: str, listed: str) -> DataFrame:
    targets, found = run_sql(spark, sf_dir, _targets(SPARK)).withColumnRenamed("page_id", "id"), run_sql(spark, sf_dir, listed)
    return rules.decide(targets, found.selectExpr("site", "k AS kind", "v AS rule")).selectExpr("id AS page_id", "site", "coalesce(rule, '') AS pattern", "coalesce(kind, 'none') AS rule", "allowed")


def _page_rules(d: Spark) -> str:
    """As many rules as pages have paths: whole ones, halves of them, with stars in and after them, and ends."""
    path = d.extract("url", r"^[a-z]+://[^/?#]*([^?#]*)")
    cut = f"substr({path}, 1, CAST(floor(length({path}) / 2) AS INT))"
    rule = f"CASE page_id % 5 WHEN 0 THEN {path} WHEN 1 THEN {cut} || '*' WHEN 2 THEN {path} || '$' WHEN 3 THEN substr({path}, 1, 2) || '*' || substr({path}, length({path}), 1) || '$' ELSE {cut} || '*' || '?page=' END"
    return f"SELECT {d.extract(u.host(d, 'url'), r'([^.]+\.[^.]+)$')} AS site, CASE WHEN page_id % 3 = 0 THEN 'allow' ELSE 'disallow' END AS k, {rule} AS v FROM pages"


def _robot_sitemaps(d: Spark) -> str:
    found = f"SELECT site, pos, v AS sitemap FROM ({_robot_lines(d)}) WHERE k = 'sitemap' AND v <> ''"
    sites = "SELECT DISTINCT site FROM (" + _robot_lines(d) + ") UNION SELECT 'example.net'"
    return f"SELECT s.site, coalesce(f.pos, 0) AS pos, coalesce(f.sitemap, 'https://' || s.site || '/sitemap.xml') AS sitemap FROM ({sites}) s LEFT JOIN ({found}) f ON s.site = f.site"


_BODIES = (
    (403, "server:x", "<p>Please verify you are a human</p>"), (200, "", "just a moment"), (200, "CF-Mitigated: challenge", "fine"), (503, "set-cookie:_abck=1", "<p>busy</p>"), (429, "", "plain"),
    (401, "", "/0123abcd-0123-0123-0123-0123456789ab/"), (200, "", "pardon the interruption datadome " + "w " * 1500), (200, "", "h-captcha " + "word " * 800),
)


def _challenge(d: Spark) -> str:
    rows = ", ".join(f"({-1 - i}, {st}, {d.lit(h)}, {d.lit(b)})" for i, (st, h, b) in enumerate(_BODIES))
    every = f"SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 403 ELSE 200 END AS status, '' AS headers, html AS body FROM pages UNION ALL SELECT * FROM (VALUES {rows}) AS v(page_id, status, headers, body)"
    low = f"SELECT page_id, status, {d.replace(u.ascii_lower('headers'), ': +', ':')} AS headers, {u.ascii_lower('body')} AS body, {t.solid_length(d, d.replace('body', '<[^>]*>', ' '))} AS solid FROM ({every})"
    return f"""SELECT page_id, {s.challenge(d, "status", "headers", "body", "solid")} AS challenge, status IN {s.BLOCKING} AS blocking, status IN (429, 503) AS retryable, status BETWEEN 200 AND 299 AS ok,
        solid > 0 AND solid * 5 < 1000 AS collapsed, {s.holds(d, "body", s.WALL_MARKERS)} AS wall FROM ({low})"""


# Hits that stand in for result lists: an engine ranks its users by value.
LISTED = """SELECT event_type AS engine, event_id, value, 'title ' || CAST(user_id AS VARCHAR(20)) AS title, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'about ' || CAST(event_id AS VARCHAR(20)) END AS description,
    CASE WHEN event_id % 2 = 0 THEN 'https://S.example/u/' ELSE 'http://s.example/u/' END || CAST(user_id AS VARCHAR(20)) || CASE WHEN event_id % 5 = 0 THEN '/?utm_source=q' ELSE '' END AS url FROM events"""
HITS = f"SELECT engine, row_number() OVER (PARTITION BY engine ORDER BY value DESC, event_id) AS rank, title, description, url FROM ({LISTED})"


def _over_hits(text: Callable[[Spark, str], str]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over hits that are numbered without a window over a whole engine."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = numbered(run_sql(spark, sf_dir, LISTED), ["engine"], [F.desc("value"), F.asc("event_id")])
        name = f"hits_{uuid.uuid4().hex}"
        hits.createOrReplaceTempView(name)
        try:
            return run_sql(spark, sf_dir, text(SPARK, f"SELECT * FROM {name}"))
        finally:
            spark.catalog.dropTempView(name)

    return run


def _fusion(d: Spark, hits: str) -> str:
    """The limit is applied after all hits are merged and sorted. Two levels of aggregates, whose minima are combined before the shuffle: a key's hits are
    never sorted in one place."""
    rich = f"{d.octets('trim(title)')} + {d.octets('trim(description)')} AS rich"
    keyed = d.once(hits, f"engine, rank, url, title, {rich}", u.canonical_key(d, "url"), "k")
    first = "named_struct('rank', rank, 'poor', -rich, 'url', url, 'title', title, 'engine', engine)"
    per = f"SELECT k, engine, min(rank) AS best, min({first}) AS o FROM ({keyed}) GROUP BY k, engine"
    fused = f"SELECT k, round(sum(CAST(1.0 AS DOUBLE) / best), 9) AS score, min(best) AS best_rank, {d.ordered('engine', ',', 'engine')} AS engines, count(*) AS n_engines, min(o) AS o FROM ({per}) GROUP BY k"
    return f"""SELECT k AS canonical, o.url, o.title, score, CAST(best_rank AS BIGINT) AS best_rank, engines, n_engines, CAST(row_number() OVER (ORDER BY score DESC, best_rank, o.url, o.title, o.engine) AS BIGINT) AS position FROM (
        SELECT * FROM ({fused}) ORDER BY score DESC, best_rank, o.url, o.title, o.engine LIMIT 100)"""


def _fusion_plain(d: Spark) -> str:
    """The same by windows over all hits."""
    keyed = f"SELECT *, {u.canonical_key(d, 'url')} AS k, {d.octets('trim(title)')} + {d.octets('trim(description)')} AS rich FROM ({HITS})"
    per = f"SELECT k, engine, min(rank) AS best FROM ({keyed}) GROUP BY k, engine"
    fused = f"SELECT k, round(sum(CAST(1.0 AS DOUBLE) / best), 9) AS score, min(best) AS best_rank, {d.ordered('engine', ',', 'engine')} AS engines, count(*) AS n_engines FROM ({per}) GROUP BY k"
    first = f"SELECT k, url, title, engine FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, rich DESC, url, title, engine) AS r FROM ({keyed})) WHERE r = 1"
    return f"""SELECT k AS canonical, url, title, score, CAST(best_rank AS BIGINT) AS best_rank, engines, n_engines, CAST(position AS BIGINT) AS position FROM (
        SELECT f.*, o.url, o.title, row_number() OVER (ORDER BY f.score DESC, f.best_rank, o.url, o.title, o.engine) AS position FROM ({fused}) f JOIN ({first}) o ON f.k = o.k) WHERE position <= 100"""


def _enriched(d: Spark, hits: str) -> str:
    docs = f"SELECT page_id, {d.extract('html', '(?is)<title[^>]*>(.*?)</title>')} AS page_title, CASE WHEN page_id % 4 = 0 THEN 'error' ELSE 'success' END AS status FROM pages"
    return f"""SELECT h.engine, CAST(h.rank AS BIGINT) AS rank, h.url, coalesce(p.page_title, h.title) AS title, coalesce(p.status, 'missing') AS status FROM ({hits}) h
        LEFT JOIN (SELECT * FROM ({docs}) WHERE status = 'success') p ON TRY_CAST({d.extract("h.url", "/u/([0-9]+)")} AS BIGINT) = p.page_id"""


def _engines(d: Spark) -> str:
    names = ("duckduckgo", "bing", "brave", "baidu", "zapmeta", "yandex", "view", "click")
    rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    counts = f"SELECT engine, count(*) AS n FROM ({LISTED}) GROUP BY engine"
    return f"""SELECT e.ord, e.engine, CASE WHEN c.n IS NULL THEN 'empty' ELSE 'ok' END AS status, coalesce(c.n, 0) AS results, 'https://' || e.engine || '.example/?' || CASE e.engine WHEN 'baidu' THEN 'wd' WHEN 'yandex' THEN 'text' ELSE 'q' END || '=' || replace('a b', ' ', '+') AS search_url,
        max(CASE WHEN c.n IS NOT NULL THEN 1 ELSE 0 END) OVER () = 0 AS all_failed FROM (SELECT CAST(ord AS BIGINT) AS ord, engine FROM (VALUES {rows}) AS v(ord, engine)) e LEFT JOIN ({counts}) c ON e.engine = c.engine"""


both("endpoint_scores", "J01 E11 E19 E20 E21 E22 E23 E24 E25 E26 E27 E28 E29 F09 F12", _scores)
both("best_endpoint", "J02 J03 F34", _best)
both("endpoint_catalog", "J04 L13", _catalog)
both("endpoint_counts", "I05 M06 H03", _counts)
both("endpoint_replay", "J05 G07 M02 M03 E38", _replay)
only("robots_decisions", "A08 E01 E02 E03 E04 G04", lambda spark, sf_dir: _decided(spark, sf_dir, _robot_rules(SPARK)), _decided_plain(DUCK, _robot_rules(DUCK)))
only("rule_index", "E02 E03 G04", lambda spark, sf_dir: _decided(spark, sf_dir, _page_rules(SPARK)), _decided_plain(DUCK, _page_rules(DUCK)))
both("robots_sitemaps", "A07 A08", _robot_sitemaps)
both("challenge_flags", "E06 E07 E08 E09 E10 E12 E13 E36 E37 E38 F13 G05", _challenge)
only("rank_fusion", "I01 I02 I03 J06 J07 F32 F33 L14 M12", _over_hits(_fusion), _fusion_plain(DUCK))
only("hits_enriched", "G01 G02 M13", _over_hits(_enriched), _enriched(DUCK, HITS))
both("engine_outcomes", "D37 I08", _engines)
