"""The data of pages by stages: embedded state, the framework's data route, then the requests that pages make.

Only pages that a stage leaves unresolved go on to the next. Each stage is written to the shared folder as one narrow row a page
(no HTML), as the next one and the result both read it. Recorded answers take the place of the network: a table of
(method, url, status, body[, seq]), the earliest of a request counting.

* Stage 0 parses each page once (Arrow batches): the first well-formed embedded state is its data.
* Stage 1 takes pages with a build id whose framework serves data routes: the route's URL is an equi-join with the answers; it counts
  if the answer is 2xx and JSON.
* Stage 2 scores the requests of the pages that are left. A page whose requests show a challenge, with no rendered document or one with
  little in it, needs a browser. Else its best requests that are worth it and safe, ``tries`` of them (1 unless told otherwise),
  are joined with the answers, and the first that is 2xx and JSON is the data.

Defined results: null or empty HTML has no state; a page without answers to its request ends as an error if that was its first; repeated page ids are
pages of their own in stage 0 and share their requests; null methods, headers and URLs of requests count as empty; empty tables give empty ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import records, signals, state, urlparse
from webloom.functions.dialect import SPARK
from webloom.html import page as p
from webloom.html import weburl
from webloom.operators.pages import per_row
from webloom.operators.storage import materialise

#: The notes of a stage that finds nothing.
NO_VIABLE = "no viable JSON endpoint among intercepts"
UNSAFE = "viable endpoint withheld: unsafe state-changing method (use --allow-unsafe-replay to replay it)"
#: Below so many solid characters a rendered document is no more than a wall.
WALL_CHARS = 1000
REQUEST = ("url", "method", "accept", "content_type")


def answers_by_request(answers: DataFrame) -> DataFrame:
    """(a_method, a_url, a_status, a_body), the earliest answer of each request."""
    seq = F.col("seq") if "seq" in answers.columns else F.lit(0)
    first = F.min_by(F.struct("status", "body"), F.struct(seq, "status", "body"))
    by = answers.where("url is not null").groupBy(F.upper(F.trim(F.coalesce("method", F.lit("GET")))).alias("a_method"), F.col("url").alias("a_url"))
    return by.agg(first.alias("a")).select("a_method", "a_url", F.col("a.status").alias("a_status"), F.col("a.body").alias("a_body"))


def once(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Adds a column whose expression is planned and evaluated once, however often the column is used."""
    return df.select("*", F.explode(F.array(F.expr(expression))).alias(name))


def good() -> Column:
    return F.coalesce(F.col("a_status").between(200, 299) & F.expr("try_parse_json(a_body) IS NOT NULL"), F.lit(False))


def embedded(pages: DataFrame) -> DataFrame:
    """Stage 0: (page_id, url, origin, data, build_id, app_router, route): origin is null for pages without state, route is the URL of a page's data, null where its framework serves none."""

    def make(url, html, build_id, app_router, path):
        got = p.embedded_state(html or "")
        return [{
            "url": url, "origin": got[0] if got else None, "data": json.dumps(got[1], ensure_ascii=False) if got else None, "build_id": build_id, "app_router": bool(app_router),
            "route": path and (weburl.joined(url or "", path) or path),
        }]

    marked = once(once(pages.select("page_id", "url", "html"), "build_id", state.build_id(SPARK, "html")), "app_router", state.app_router(SPARK, "html"))
    path, pairs = records.path_and_pairs("url")
    placed = marked.withColumn("path", F.when(~F.col("app_router") & F.col("build_id").isNotNull(), records.data_route(F.col("build_id"), path, pairs)))
    return per_row(placed, "page_id", ["url", "html", "build_id", "app_router", "path"], "url string, origin string, data string, build_id string, app_router boolean, route string", make)


def routed(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Stage 1 over unresolved pages: adds a_status and routed (the JSON of a page's route)."""
    met = pages.join(answers.where("a_method = 'GET'"), F.col("route") == F.col("a_url"), "left")
    return met.withColumn("routed", F.when(good(), F.col("a_body"))).drop("a_method", "a_url", "a_body")


def scored(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """The requests (page_id, seq, url, method, accept, content_type) of the pages, with score, replayable and challenge."""
    plain = requests.select("page_id", "seq", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in REQUEST))
    mine = plain.join(pages.select("page_id", F.coalesce("url", F.lit("")).alias("target")).distinct(), "page_id")
    name = f"requests_{uuid.uuid4().hex}"
    mine.createOrReplaceTempView(name)
    spark = requests.sparkSession
    try:
        return spark.sql(f"SELECT *, {signals.network_challenge(SPARK, 'url')} AS challenge FROM ({signals.scored(SPARK, f'SELECT * FROM {name}')})")
    finally:
        spark.catalog.dropTempView(name)


def per_page(requests: DataFrame, allow_unsafe: bool = False) -> DataFrame:
    """What a page's scored requests amount to, without sorting them: counts, the first challenge, and whether any is worth it, or may be replayed."""
    viable = F.col("score") >= signals.MIN_VIABLE
    return requests.groupBy("page_id").agg(
        F.count("*").alias("n_requests"),
        F.count_if(viable & eligible(allow_unsafe)).alias("n_replayable"),
        F.min_by(F.when(F.col("challenge").isNotNull(), F.col("challenge")), F.when(F.col("challenge").isNotNull(), F.col("seq"))).alias("challenge"),
        F.coalesce(F.bool_or(viable), F.lit(False)).alias("viable"),
        F.coalesce(F.bool_or(viable & eligible(False)), F.lit(False)).alias("safe"),
    )


def eligible(allow_unsafe: bool) -> Column:
    return ~F.expr(signals.is_streaming(SPARK, "url", "accept")) if allow_unsafe else F.col("replayable")


def replayed(requests: DataFrame, answers: DataFrame, tries: int = 1, allow_unsafe: bool = False) -> DataFrame:
    """(page_id, tried, answered, detail, replay): of each page's best requests that may be replayed the first with a good answer, how many of them there are, and how many had any answer
    up to it. The best are ranked with a limit, so that only ``tries`` rows a page and task are moved."""
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "seq")
    ranked = requests.where(eligible(allow_unsafe) & (F.col("score") >= signals.MIN_VIABLE)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= tries)
    # the URL parser is planned by itself, not again with every stage of the joins around it
    few = materialise(ranked.select("page_id", "place", "score", F.upper(F.trim("method")).alias("method"), "target", "url"), "ladder-tried")
    placed = materialise(once(few, "at", f"coalesce({urlparse.joined('target', 'url')}, url)").drop("target", "url"), "ladder-asked")
    met = placed.join(
        answers, (F.col("method") == F.col("a_method")) & (F.col("at") == F.col("a_url")), "left"
    )
    detail = F.concat("method", F.lit(" "), "at", F.lit(" (score "), "score", F.lit(")"))
    row = F.struct(detail.alias("detail"), F.col("a_body").alias("data"))
    return met.groupBy("page_id").agg(F.count("*").alias("tried"), F.min_by(F.col("a_status"), F.col("place")).alias("first_status"), F.min_by(F.when(good(), row), F.when(good(), F.col("place"))).alias("got")).select(
        "page_id", "tried", "first_status", F.col("got.detail").alias("detail"), F.col("got.data").alias("replay")
    )


def walls(rendered: DataFrame) -> DataFrame:
    """(page_id, wall): whether a rendered document (page_id, rendered_html) holds little; none counts as a wall."""

    def make(html):
        return [{"wall": html is None or p.solid(p.scrape(html, "about:blank", only_main=False, formats=("markdown",))["markdown"]) < WALL_CHARS}]

    return per_row(rendered, "page_id", ["rendered_html"], "wall boolean", make)


def data_of_pages(pages: DataFrame, answers: DataFrame, requests: DataFrame, rendered: DataFrame | None = None, tier_max: int = 2, tries: int = 1, allow_unsafe: bool = False) -> DataFrame:
    """(page_id, status, tier, detail, data, trace): status is success, needs_browser, error or unsupported; tier, detail and data are null but for what was found; trace
    has a line for each step."""
    facts = materialise(embedded(pages), "ladder-state")
    found = facts.where("origin is not null").select("page_id", F.lit("success").alias("status"), F.lit("static").alias("tier"), F.col("origin").alias("detail"), "data", F.array(F.concat(F.lit("static."), "origin", F.lit(" matched"))).alias("trace"))
    left = facts.where("origin is null").drop("origin", "data")
    first = F.lit("static.scan missed")
    known = answers_by_request(answers)
    if tier_max < 1:
        return found.unionByName(left.select("page_id", F.lit("unsupported").alias("status"), *_none("tier", "detail", "data"), F.array(first).alias("trace")))
    stage1 = materialise(routed(left, known), "ladder-route")
    route_step = (
        F.when(F.col("app_router"), F.lit("tier1.build_id skipped")).when(F.col("build_id").isNull(), F.lit("tier1.build_id missed")).when(F.col("a_status").isNull(), F.lit("tier1.replay failed"))
        .when(~F.col("a_status").between(200, 299), F.concat(F.lit("tier1.replay missed: "), "a_status")).when(F.col("routed").isNull(), F.lit("tier1.parse failed")).otherwise(F.lit("tier1.parse matched"))
    )
    stage1 = stage1.withColumn("trace", F.array(first, route_step))
    found = found.unionByName(stage1.where("routed is not null").select("page_id", F.lit("success").alias("status"), F.lit("heuristic_api_replay").alias("tier"), F.col("route").alias("detail"), F.col("routed").alias("data"), "trace"))
    left = stage1.where("routed is null")
    if tier_max < 2:
        return found.unionByName(left.select("page_id", F.lit("unsupported").alias("status"), *_none("tier", "detail", "data"), "trace"))
    mine = materialise(scored(requests, left), "ladder-requests")
    sums = per_page(mine, allow_unsafe)
    shown = sums.where("challenge is not null").select("page_id")
    wall = walls(rendered.select("page_id", "rendered_html").join(shown, "page_id", "left_semi")).groupBy("page_id").agg(F.bool_and("wall").alias("wall")) if rendered is not None else shown.withColumn("wall", F.lit(True))
    wide = left.join(sums, "page_id", "left").join(wall, "page_id", "left").join(replayed(mine, known, tries, allow_unsafe), "page_id", "left")
    blocked = F.col("challenge").isNotNull() & F.coalesce("wall", F.lit(True))
    note = F.when(F.col("viable") & ~F.col("safe"), F.lit(UNSAFE)).otherwise(F.lit(NO_VIABLE))
    lost = F.col("tried").isNotNull() & F.col("first_status").isNull() & F.col("replay").isNull()
    status = F.when(blocked, F.lit("needs_browser")).when(F.col("replay").isNotNull(), F.lit("success")).when(lost, F.lit("error")).otherwise(F.lit("unsupported"))
    last = F.when(blocked, F.concat(F.lit("core.challenge matched: network:"), "challenge")).when(F.col("replay").isNotNull(), F.concat(F.lit("runtime.replay matched: "), "detail")).when(lost, F.lit("runtime.replay failed")).otherwise(F.concat(F.lit("runtime.rank missed: "), note))
    captured = F.concat(F.lit("runtime.capture "), F.when(F.coalesce("n_requests", F.lit(0)) == 0, F.lit("missed")).otherwise(F.concat(F.lit("matched: "), "n_requests")))
    fine = status == "success"
    end = wide.select(
        "page_id", status.alias("status"), F.when(fine, F.lit("runtime_interception")).alias("tier"), F.when(fine, F.col("detail")).alias("detail"), F.when(fine, F.col("replay")).alias("data"),
        F.concat("trace", F.array(captured, last)).alias("trace"),
    )
    return found.unionByName(end)


def _none(*names: str) -> list[Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


def discovered(pages: DataFrame, requests: DataFrame, answers: DataFrame, rendered: DataFrame | None = None, tries: int = 1, allow_unsafe: bool = False) -> DataFrame:
    """Discovery: (page_id, status, n_endpoints, n_replayable, detail, data) of every page. A challenge ends it without a catalog; else it succeeds, and data is that of a
    replay on top, whose failure changes nothing else."""
    mine = materialise(scored(requests, pages), "discover-requests")
    sums = per_page(mine, allow_unsafe)
    shown = sums.where("challenge is not null").select("page_id")
    wall = walls(rendered.select("page_id", "rendered_html").join(shown, "page_id", "left_semi")).groupBy("page_id").agg(F.bool_and("wall").alias("wall")) if rendered is not None else shown.withColumn("wall", F.lit(True))
    wide = pages.select("page_id").join(sums, "page_id", "left").join(wall, "page_id", "left").join(replayed(mine, answers_by_request(answers), tries, allow_unsafe), "page_id", "left")
    blocked = F.col("challenge").isNotNull() & F.coalesce("wall", F.lit(True))
    shown_to = lambda c: F.when(~blocked, c)
    return wide.select(
        "page_id", F.when(blocked, F.lit("needs_browser")).otherwise(F.lit("success")).alias("status"), *(F.coalesce(shown_to(F.col(n)), F.lit(0)).alias(a) for n, a in (("n_requests", "n_endpoints"), ("n_replayable", "n_replayable"))),
        shown_to(F.col("detail")).alias("detail"), shown_to(F.col("replay")).alias("data"),
    )
