"""Scoring and classification of requests, responses and pages, as SQL text for a dialect."""

from __future__ import annotations

import re

from webloom.functions import urls as u
from webloom.functions.dialect import Spark

# Weights, markers, extensions and vendor signatures decide results and are kept as they must be.
SAME_ORIGIN, API_PATH, JSON, ANALYTICS_PENALTY, ASSET_PENALTY, MIN_VIABLE = 10, 8, 5, -100, -50, 13
API_MARKERS = ("/api/", "/api.", "/graphql", "/gql", "/rest/", "/rpc", "/query")
READ_POST_MARKERS = ("/graphql", "/gql", "/rpc", "/query")
ASSET_EXTENSIONS = (
    ".js", ".mjs", ".css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp4", ".webm", ".avif", ".wasm", ".txt", ".xml", ".pdf",
)
ANALYTICS_MARKERS = (
    "google-analytics.com", "googletagmanager.com", "analytics.google", "/collect", "/gtm.js", "/gtag/", "doubleclick.net", "facebook.com/tr", "connect.facebook.net", "segment.io", "segment.com/v1", "sentry.io", "/sentry",
    "bugsnag.com", "datadoghq.com", "/rum", "/beacon", "/telemetry", "/metrics", "/pixel", "hotjar.com", "mixpanel.com", "amplitude.com", "newrelic.com", "nr-data.net",
)
TRACKER_HOSTS = (
    "fullstory.com", "doubleverify.com", "doubleclick.net", "googlesyndication.com", "google-analytics.com", "googletagmanager.com", "analytics.google.com", "amplitude.com", "segment.io", "segment.com", "attentivemobile.com",
    "attn.tv", "medallia.com", "intercomcdn.com", "intercom.io", "api-iam.intercom", "px-cloud.net", "perimeterx", "zeronaught.com", "hotjar.com", "hotjar.io", "mixpanel.com", "heapanalytics.com", "sentry.io", "bugsnag.com",
    "datadoghq.com", "nr-data.net", "newrelic.com", "optimizely.com", "criteo.com", "criteo.net", "taboola.com", "outbrain.com", "connect.facebook.net", "bat.bing.com", "clarity.ms", "onetrust.com", "cookielaw.org", "branch.io",
    "appsflyer.com", "adjust.com", "quantserve.com", "scorecardresearch.com", "launchdarkly.com", "mouseflow.com", "analytics.tiktok.com", "ads.linkedin.com",
)
PHRASES = (
    ("perimeterx", ("pardon the interruption", "press and hold to confirm you are a human", "access to this page has been denied")),
    ("cloudflare", ("attention required!", "checking your browser before accessing", "verifying you are human", "enable javascript and cookies to continue", "why have i been blocked?", "just a moment")),
    ("imperva", ("request unsuccessful. incapsula incident",)),
    ("recaptcha", ("please verify you are a human",)),
)
VENDOR_MARKERS = (
    ("datadome", ("datadome", "js.datadome.co", "geo.captcha-delivery.com", "captcha-delivery.com", "dd_cookie_test", "x-datadome")),
    ("perimeterx", ("_px", "px-captcha", "_pxhd", "px-cloud", "px-cdn", "_pxappid")),
    ("cloudflare", ("__cf_chl", "cf-chl", "cf_chl_opt", "/cdn-cgi/challenge-platform/", "cf_clearance", "challenges.cloudflare.com", "cf-browser-verification")),
    ("akamai", ("_abck", "ak_bmsc", "/akam/", "bm-verify", "errors.edgesuite.net", "akamai bot manager")),
    ("kasada", ("kpsdk", "x-kpsdk-", "ips.js")),
    ("imperva", ("visid_incap", "incap_ses", "_incapsula_resource", "imperva", "incapsula")),
    ("recaptcha", ("google.com/recaptcha", "google.com/recaptcha/api.js", "g-recaptcha")),
    ("hcaptcha", ("hcaptcha.com", "h-captcha")),
)
NETWORK_MARKERS = (
    ("perimeterx", ("px-cloud.net", "perimeterx.net", "captcha.px-cdn")),
    ("datadome", ("cdn.datadome.co", "js.datadome.co", "captcha-delivery.com")),
    ("cloudflare", ("challenges.cloudflare.com", "/cdn-cgi/challenge-platform/")),
    ("hcaptcha", ("hcaptcha.com",)),
    ("recaptcha", ("google.com/recaptcha", "recaptcha.net/recaptcha")),
    ("imperva", ("imperva.com", "incapsula.com", "_incapsula_resource")),
    ("kasada", ("kpsdk", "x-kpsdk-", "ips.js")),
)
WALL_MARKERS = ("cf-chl-", "cf-turnstile", "just a moment", "datadome", "captcha-delivery", "verify you are human", "checking your browser")
BLOCKING = (401, 403, 429, 503)
TINY_BYTES, THIN_CHARS = 2048, 1000


def any_of(d: Spark, x: str, markers) -> str:
    """Whether x holds one of the markers: one pattern, so that x is evaluated once."""
    return d.rlike(x, "|".join(map(re.escape, markers)))


def holds(d: Spark, x: str, markers) -> str:
    """The same for long texts that are at hand: each marker is searched by itself, several times as fast as a pattern of them all."""
    return "(" + " OR ".join(f"contains({x}, {d.lit(m)})" for m in markers) + ")"


def first_kind(d: Spark, x: str, table, found=any_of) -> str:
    """Kind of the first signature of a table with a token in x; null if there is none."""
    return "CASE " + " ".join(f"WHEN {found(d, x, tokens)} THEN '{kind}'" for kind, tokens in table) + " END"


def is_analytics(d: Spark, url: str) -> str:
    """E19."""
    return any_of(d, u.ascii_lower(url), ANALYTICS_MARKERS)


def is_tracker(d: Spark, url: str) -> str:
    """E20."""
    return any_of(d, u.ascii_lower(f"CASE WHEN contains({url}, '://') THEN {d.extract(url, r'://([^/?#]*)')} ELSE {url} END"), TRACKER_HOSTS)


def is_asset(d: Spark, path: str) -> str:
    """By what follows the last dot, as no extension holds another."""
    return f"({d.extract(u.ascii_lower(path), r'([.][^.]*)$')} IN ({', '.join(map(d.lit, ASSET_EXTENSIONS))}))"


def same_origin(d: Spark, url: str, target: str) -> str:
    """A relative URL, or one of the target's host."""
    return f"({u.host(d, url)} IN ('', {u.host(d, target)}))"


def json_intent(accept: str, content_type: str) -> str:
    """E24, over the first header of each name ('' for none)."""
    return f"(contains(lower({accept}), 'application/json') OR {json_type(content_type)})"


def json_type(content_type: str) -> str:
    c = f"lower({content_type})"
    return f"(contains({c}, 'application/json') OR contains({c}, 'application/graphql') OR contains({c}, '+json'))"


def is_safe(method: str) -> str:
    """E25."""
    return f"(upper(trim({method})) IN ('GET', 'HEAD', 'OPTIONS'))"


def is_read_post(d: Spark, method: str, url: str, content_type: str, path: str = "") -> str:
    """E26; path: the url's path in lower case, where it is at hand."""
    return f"(upper(trim({method})) IN ('POST', 'PUT') AND ({any_of(d, path or u.ascii_lower(u.path(d, url)), READ_POST_MARKERS)} OR {json_type(content_type)}))"


def is_streaming(d: Spark, url: str, accept: str) -> str:
    """E27."""
    return f"({d.rlike(url, r'^\s*[wW][sS][sS]?://')} OR contains(lower({accept}), 'text/event-stream'))"


def is_replayable(d: Spark, method: str, url: str, accept: str, content_type: str, unsafe: bool = False, path: str = "") -> str:
    """E28."""
    return f"(NOT {is_streaming(d, url, accept)} AND ({'true' if unsafe else 'false'} OR {is_safe(method)} OR {is_read_post(d, method, url, content_type, path)}))"


def score(d: Spark, url: str, target: str, accept: str, content_type: str) -> str:
    """J01."""
    return score_of(d, u.ascii_lower(u.path(d, url)), same_origin(d, url, target), is_analytics(d, url), json_intent(accept, content_type))


def score_of(d: Spark, path: str, same: str, analytics: str, intent: str) -> str:
    """J01 over a path in lower case and facts that are at hand."""
    return (
        f"(CASE WHEN {same} THEN {SAME_ORIGIN} ELSE 0 END + CASE WHEN {any_of(d, path, API_MARKERS)} OR {u.versioned(d, path)} THEN {API_PATH} ELSE 0 END"
        f" + CASE WHEN {intent} THEN {JSON} ELSE 0 END + CASE WHEN {analytics} THEN {ANALYTICS_PENALTY} ELSE 0 END + CASE WHEN {is_asset(d, path)} THEN {ASSET_PENALTY} ELSE 0 END)"
    )


def scored(d: Spark, rows: str) -> str:
    """Requests with their facts: what several operators read is its own column, made once a row."""
    facts = f"SELECT *, {u.ascii_lower(u.path(d, 'url'))} AS url_path, {same_origin(d, 'url', 'target')} AS same_origin, {is_analytics(d, 'url')} AS analytics, {json_intent('accept', 'content_type')} AS json_intent FROM ({rows})"
    return f"SELECT *, {score_of(d, 'url_path', 'same_origin', 'analytics', 'json_intent')} AS score, {is_replayable(d, 'method', 'url', 'accept', 'content_type', path='url_path')} AS replayable, {is_asset(d, 'url_path')} AS asset FROM ({facts})"


def vendor(d: Spark, x: str) -> str:
    return f"coalesce({first_kind(d, x, VENDOR_MARKERS, holds)}, CASE WHEN {u.guid_segment(d, x)} THEN 'kasada' END)"


def challenge(d: Spark, status: str, headers: str, body: str, solid: str) -> str:
    """Headers are name:value lines in lower case, body is lower-cased, solid its rendered non-space length."""
    phrase, marker = first_kind(d, body, PHRASES, holds), f"coalesce({vendor(d, body)}, {vendor(d, headers)})"
    blocking = f"{status} IN {BLOCKING}"
    return (
        f"CASE WHEN contains({headers}, 'cf-mitigated:challenge') THEN 'cloudflare' "
        f"WHEN {phrase} IS NOT NULL AND ({blocking} OR {d.octets(body)} < {TINY_BYTES} OR ({marker} IS NOT NULL AND {solid} < {THIN_CHARS})) THEN coalesce({marker}, {phrase}) "
        f"WHEN {blocking} THEN {marker} END"
    )


def network_challenge(d: Spark, url: str) -> str:
    """E11."""
    x = u.ascii_lower(url)
    return f"coalesce({first_kind(d, x, NETWORK_MARKERS)}, CASE WHEN {u.guid_segment(d, x)} THEN 'kasada' END)"


def rule_fits(d: Spark, rule: str, path: str) -> str:
    """An access rule's pieces between stars are found in the path one after the other, each where it first
    occurs, the first one at the start; a dollar at the end asks for nothing after the last piece."""
    anchored = d.ends(rule, d.lit("$"))
    pattern = f"CASE WHEN {anchored} THEN substr({rule}, 1, length({rule}) - 1) ELSE {rule} END"
    # what is left of the path after a Y, or N
    begin = f"CASE WHEN {d.starts(path, 'x')} THEN 'Y' || substr({path}, length(x) + 1) ELSE 'N' END"
    step = f"CASE WHEN a = '' THEN {begin} WHEN a = 'N' OR x = '' THEN a WHEN instr(substr(a, 2), x) = 0 THEN 'N' ELSE 'Y' || substr(a, 1 + instr(substr(a, 2), x) + length(x)) END"
    left = d.fold(d.split(pattern, "*"), "a", "x", step)
    return d.let("rest", left, f"rest <> 'N' AND (NOT {anchored} OR rest = 'Y' OR {d.ends(rule, d.lit('*$'))})")
