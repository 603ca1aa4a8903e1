"""Queries that run a stream over a table to its end and read what it left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from webloom.operators.storage import shared_dir
from webloom.plans.base import only, table
from webloom.streaming import jobs

#: Units that a job asks for; users' events are its reports.
UNITS = 20
#: Longer than the table spans, so that a job has one life.
LIFE_S = 10 * 366 * 86_400
EVENTS = f"""user_id AS job, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' AND event_id % 40 = 0 THEN 'cancel' WHEN event_type = 'signup' THEN 'ping' ELSE 'unit' END AS kind,
    event_id % 64 AS unit, CAST({UNITS} AS BIGINT) AS total, concat('failed ', event_id) AS text"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's last state, from a stream of all events."""
    at = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/jobs-{uuid.uuid4().hex[:12]}"
    # a pattern, as a stream's source may not be a single file
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").where("user_id IS NOT NULL AND ts IS NOT NULL")
    stream = jobs.job_stream(events.selectExpr(*[e.strip() for e in _split(EVENTS)]), life_s=LIFE_S)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(jobs.OUT).parquet(f"{at}/rows").where("status <> 'expired'")
    last = rows.groupBy("job").agg({"version": "max"}).withColumnRenamed("max(version)", "version")
    return rows.join(last, ["job", "version"]).dropDuplicates(["job"]).selectExpr("job", "version", "status", "completed", "n_errors", "array_join(errors, ',') AS errors", "created", "last_at")


def _split(text: str) -> list[str]:
    """Columns of a select list, at commas outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


_JOBS = f"""WITH e AS (SELECT {EVENTS.replace("concat('failed ', event_id)", "'failed ' || event_id")}, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    f AS (SELECT *, kind = 'unit' AND row_number() OVER (PARTITION BY job, kind, unit ORDER BY pos) = 1 AS fresh FROM e),
    n AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY pos) AS done FROM f),
    j AS (SELECT job, min(CASE WHEN kind = 'cancel' THEN pos END) AS stopped, min(CASE WHEN done >= {UNITS} THEN pos END) AS full_at, max(pos) AS last_pos FROM n GROUP BY job),
    k AS (SELECT *, least(coalesce(stopped, last_pos), coalesce(full_at, last_pos)) AS until FROM j)
    SELECT n.job, CAST(max(k.until) AS BIGINT) AS version, CASE WHEN min(k.full_at) IS NOT NULL AND min(k.full_at) <= coalesce(min(k.stopped), min(k.full_at)) THEN 'completed' WHEN min(k.stopped) IS NOT NULL THEN 'cancelled' ELSE 'scraping' END AS status,
        CAST(max(n.done) AS BIGINT) AS completed, count(*) FILTER (kind = 'error') AS n_errors, coalesce(string_agg(text, ',' ORDER BY pos) FILTER (kind = 'error' AND errs <= {jobs.MOST_ERRORS}), '') AS errors, min(tm) AS created, max(tm) AS last_at
    FROM (SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY pos) AS errs FROM n) n JOIN k ON k.job = n.job WHERE n.pos <= k.until GROUP BY n.job"""

only("job_stream", "H08 H11 H16 H17 H18", _jobs, _JOBS)
