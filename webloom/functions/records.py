"""Columns for requests, results and traces: labels, header and cookie lists, query pairs, envelopes, steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def action_label(kind: Column, selector: Column, key: Column, direction: Column, milliseconds: Column) -> Column:
    """what a session's action is called in its report."""
    what = (
        F.when(kind == "type", F.coalesce(selector, F.lit("<focused>")))
        .when(kind == "press", key)
        .when(kind == "scroll", F.coalesce(selector, direction, F.lit("down")))
        .when(kind == "wait", F.coalesce(selector, F.concat(milliseconds.cast("string"), F.lit("ms"))))
        .otherwise(selector)
    )
    return F.concat_ws(" ", kind, what)


def header_list(headers: Column) -> Column:
    """(name, value) of an ordered list whose values are bytes; bytes that are no text are replaced."""
    return F.transform(headers, lambda h: F.struct(h["name"].alias("name"), F.make_valid_utf8(h["value"].cast("string")).alias("value")))


def merge_cookies(headers: Column, cookies: Column) -> Column:
    """lists of (name, value); the cookies, by name, follow what an explicit Cookie header says, and the
    merged header comes last. Without cookies the headers stay as they are."""
    is_cookie = lambda h: F.lower(h["name"]) == "cookie"
    made = F.array_join(F.transform(F.array_sort(cookies), lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ")
    given = F.try_element_at(F.filter(headers, is_cookie), F.lit(-1))["value"]
    line = F.when(F.trim(given) != "", F.concat(given, F.lit("; "), made)).otherwise(made)
    merged = F.concat(F.filter(headers, lambda h: ~is_cookie(h)), F.array(F.struct(F.lit("Cookie").alias("name"), line.alias("value"))))
    return F.when(F.size(cookies) == 0, headers).otherwise(merged)


def path_and_pairs(url: str) -> tuple[Column, Column]:
    """the path ('/' for none) and the decoded (name, value) pairs of an address; a relative one is cut at its
    first question mark, and keeps a fragment there."""
    u = F.col(url)
    absolute = u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    plain = F.regexp_replace(u, "#.*$", "")
    path = F.when(absolute, F.regexp_extract(plain, "^[^:]*://[^/?]*([^?]*)", 1)).otherwise(F.regexp_extract(u, "^([^?]*)", 1))
    query = F.regexp_extract(F.when(absolute, plain).otherwise(u), r"(?s)\?(.*)$", 1)
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("name"), decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value"))
    )
    return F.when(path == "", "/").otherwise(path), pairs


def rendered(markdown: Column, envelope: Column, as_json: Column, only_markdown: Column) -> Column:
    """Bare Markdown where it alone was asked for and is not blank, else the envelope."""
    return F.concat(F.when(~as_json & only_markdown & (F.trim(markdown) != ""), markdown).otherwise(envelope), F.lit("\n"))


def step(tier: str, action: str, outcome: str, elapsed_ms: Column, detail: Column | None = None) -> Column:
    detail = F.lit(None) if detail is None else detail
    return F.struct(F.lit(tier).alias("tier"), F.lit(action).alias("action"), F.lit(outcome).alias("outcome"), elapsed_ms.cast("long").alias("elapsed_ms"), detail.cast("string").alias("detail"))


def with_logs(trace: Column, lines: Column, wanted: Column) -> Column:
    """A step for each line of the page's log, where they are wanted."""
    return F.when(wanted, F.concat(trace, F.transform(lines, lambda x: step("runtime_interception", "runtime.log", "matched", F.lit(0), x)))).otherwise(trace)


def with_warnings(trace: Column, tier: str, warnings: Column) -> Column:
    """A step for each warning of the extraction."""
    return F.concat(trace, F.transform(warnings, lambda x: step(tier, "extract.warning", "matched", F.lit(0), x)))


def warnings_of(trace: Column) -> Column:
    """I09."""
    return F.transform(F.filter(trace, lambda t: (t["action"] == "extract.warning") & t["detail"].isNotNull()), lambda t: t["detail"])


def engine_outcome(engine: Column, timed_out: Column, code: Column, message: Column, hits: Column) -> Column:
    """One engine's outcome as JSON without nulls."""
    status = F.when(timed_out, "timeout").when(message.isNotNull(), "error").when(~code.between(200, 299), "http").when(hits == 0, "empty").otherwise("ok")
    only = lambda s, c: F.when(status == s, c)
    return F.to_json(F.struct(engine.alias("engine"), status.alias("status"), only("ok", hits).alias("results"), only("http", code).alias("code"), only("error", message).alias("message")))


def search_url(base: Column, name: str, query: Column) -> Column:
    """An engine's address with the query in its own parameter."""
    return F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit(name + "="), F.url_encode(query))


def data_route(build: Column, path: Column, pairs: Column) -> Column:
    """Where a route's data lie: no trailing slashes, the index for the root, and the encoded query."""
    route = F.regexp_replace(F.trim(path), "/+$", "")
    route = F.when(route == "", "/index").when(F.startswith(route, F.lit("/")), route).otherwise(F.concat(F.lit("/"), route))
    # form encoding but for the space, the star and the tilde
    encode = lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(encode(p["name"]), F.lit("="), encode(p["value"]))), "&")
    return F.concat(F.lit("/_next/data/"), build, route, F.lit(".json"), F.when(F.size(pairs) > 0, F.concat(F.lit("?"), query)).otherwise(""))


def find_ignoring_case(text: Column, needle: Column) -> Column:
    """the 0-based place of needle in text, the case of A to Z aside; null where there is none."""
    low = lambda x: F.translate(x, UPPER, LOWER)
    return F.nullif(F.call_function("locate", low(needle), low(text)), F.lit(0)).cast("long") - 1
