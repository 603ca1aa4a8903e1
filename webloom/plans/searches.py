"""Searches whose engines' answers are made of events: a user is a search, an event type an engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import search
from webloom.operators.ranks import numbered
from webloom.plans.base import only, run_sql

FOUND = """SELECT user_id AS search, event_type AS engine, event_id, value, 'title ' || CAST(event_id % 50 AS VARCHAR(20)) AS title, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'about ' || CAST(event_id AS VARCHAR(20)) END AS description,
    CASE WHEN event_id % 2 = 0 THEN 'https://S.example/p/' ELSE 'http://s.example/p/' END || CAST(event_id % 50 AS VARCHAR(20)) || CASE WHEN event_id % 5 = 0 THEN '/?utm_source=q' ELSE '' END AS url FROM events"""
OUTCOMES = """SELECT user_id AS search, event_type AS engine, min(event_id) AS place, user_id % 7 = 0 OR (user_id % 7 = 1 AND event_type = 'view') AS timed_out, CASE WHEN user_id % 7 = 2 AND event_type <> 'click' THEN 403 ELSE 200 END AS code,
    CASE WHEN user_id % 7 = 3 THEN 'no "route"' END AS message, count(*) AS hits FROM events GROUP BY user_id, event_type"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of all searches; of users by sevens all engines fail, or some."""
    hits = numbered(run_sql(spark, sf_dir, FOUND), ["search", "engine"], [F.desc("value"), F.asc("event_id")])
    outcomes = run_sql(spark, sf_dir, OUTCOMES)
    fine = outcomes.where("NOT timed_out AND message IS NULL AND code = 200").select("search", "engine")
    got = search.answered(outcomes, hits.join(fine, ["search", "engine"], "left_semi"))
    return got.select(
        "search", "success", "error", F.array_join(F.transform("results", lambda r: F.concat_ws("|", r["title"], r["description"], r["url"])), ";").alias("results"), F.array_join("engines", ",").alias("engines")
    )


_ANSWERS = f"""WITH o AS ({OUTCOMES}), h AS (SELECT f.*, row_number() OVER (PARTITION BY f.search, f.engine ORDER BY value DESC, event_id) AS rank FROM ({FOUND}) f),
    u AS (SELECT h.*, 's.example/p/' || CAST(event_id % 50 AS VARCHAR) AS k, octet_length(encode(trim(title))) + octet_length(encode(trim(description))) AS rich FROM h JOIN o ON o.search = h.search AND o.engine = h.engine WHERE NOT timed_out AND message IS NULL AND code = 200),
    b AS (SELECT search, k, engine, min(rank) AS best FROM u GROUP BY ALL), s AS (SELECT search, k, round(sum(CAST(1.0 AS DOUBLE) / best), 9) AS score, min(best) AS best FROM b GROUP BY ALL),
    f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY search, k ORDER BY rank, rich DESC, url, title, engine) = 1),
    p AS (SELECT f.*, row_number() OVER (PARTITION BY f.search ORDER BY s.score DESC, s.best, f.url, f.title, f.engine) AS position FROM f JOIN s ON s.search = f.search AND s.k = f.k QUALIFY position <= 5),
    r AS (SELECT search, string_agg(title || '|' || description || '|' || url, ';' ORDER BY position) AS results FROM p GROUP BY search),
    e AS (SELECT search, bool_or(NOT timed_out AND message IS NULL AND code = 200) AS success, string_agg('{{"engine":"' || engine || '","status":"' || CASE WHEN timed_out THEN 'timeout"' WHEN message IS NOT NULL THEN 'error","message":"no \\"route\\""'
        WHEN code <> 200 THEN 'http","code":' || code ELSE 'ok","results":' || hits END || '}}', ',' ORDER BY place) AS engines FROM o GROUP BY search)
    SELECT e.search, e.success, CASE WHEN NOT e.success THEN '{search.FAILED}' END AS error, CASE WHEN e.success THEN coalesce(r.results, '') ELSE '' END AS results, e.engines FROM e LEFT JOIN r ON r.search = e.search"""

only("search_answers", "M16 L14 I08 M14 J09", _answers, _ANSWERS)
