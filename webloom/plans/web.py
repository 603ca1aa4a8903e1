"""Queries on page URLs, links, embedded data and Markdown text."""

from __future__ import annotations

import re

from webloom.functions import state
from webloom.functions import text as t
from webloom.functions import urls as u
from webloom.functions.dialect import Spark
from webloom.plans.base import both

HREF = r'<a [^>]*href="([^"]*)"'


def _url_parts(d: Spark) -> str:
    return f"""SELECT page_id, {u.scheme(d, "url")} AS scheme, {u.host(d, "url")} AS host, {u.path(d, "url")} AS path, {u.query(d, "url")} AS query,
        {u.has_query(d, "url")} AS has_query, {u.is_http(d, "url")} AS is_http, {u.has_scheme(d, "url")} AS has_scheme, {u.versioned(d, u.path(d, "url"))} AS versioned,
        {u.without_fragment(d, "url")} AS normalized, {u.guid_segment(d, "url")} AS guid FROM pages"""


#: References as pages hold them, and what each names on a page, for the check: {o} is the page's origin, {s} its scheme, {d} its folder, {u} its folder's
#: folder, {p} the page without query and fragment, {q} with its query; null where the reference stays as it is.
CASES = (
    ("  y ", "{d}y"), ("a b?c d#e f", "{d}a%20b?c%20d#e%20f"), ("..\\x", "{u}x"), ("//X.com/../z", "{s}://x.com/z"), ("//b\u00fccher.example/\u00fc?\u00e4'", "{s}://xn--bcher-kva.example/%C3%BC?%C3%A4%27"),
    ("/./a/%2E%2e/b", "{o}/b"), ("?x=1", "{p}?x=1"), ("#z", None), ("", None), ("//0x7F.1/", "{s}://127.0.0.1/"), ("//[2001:DB8:0:0:1:0:0:1]:08080/", "{s}://[2001:db8::1:0:0:1]:8080/"),
    ("//u:p@h.example:21/a", "{s}://u:p@h.example:21/a"), ("//exa mple/", None), ("mailto:A@b.c", None), ("HTTPS://E.com:443", None), ("\\\\h\\p\\..\\q", "{s}://h/q"), ("/a\tb\nc", "{o}/abc"), ("//256.1.1.1/", None),
    ("//\u4f8b\u3048.\u30c6\u30b9\u30c8/", "{s}://xn--r8jz45g.xn--zckzah/"), (".", "{d}"), ("x{y}|z^", "{d}x%7By%7D|z^"), ("/a//../b/", "{o}/a/b/"), ("//h:99999/", None), ("//\uff25\uff38.com/%zz", "{s}://ex.com/%zz"),
)


def _url_cases(d: Spark) -> str:
    """Every reference of CASES on every page."""
    at = d.explode("SELECT page_id, url FROM pages", "page_id, url", d.array([d.lit(r) for r, _ in CASES]), "ref")
    met = d.once(at, "page_id, pos, ref", u.joined(d, "url", "ref"), "named")
    return f"SELECT page_id, pos, {u.resolved(d, 'ref', 'named')} AS resolved, named IS NOT NULL AS joins FROM ({met})"


def _url_cases_plain() -> str:
    part = {
        "o": "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)", "s": "regexp_extract(url, '^([a-z]+)', 1)", "d": "regexp_extract(url, '^([a-z]+://[^/?#]*/([^?#]*/)?)', 1)",
        "u": "regexp_extract(url, '^([a-z]+://[^/?#]*/([^?#]*/)?)', 1)", "p": "regexp_extract(url, '^([^?#]*)', 1)", "q": "regexp_extract(url, '^([^#]*)', 1)",
    }
    part["u"] = f"regexp_replace({part['d']}, '([^/:])/[^/]+/$', '\\1/')"

    def row(k: int, ref: str, want: str | None) -> str:
        fixed = ref.replace("'", "''")
        value = "'" + fixed + "'" if want is None else " || ".join(part[w[1]] if w[:1] == "{" else "'" + w.replace("'", "''") + "'" for w in re.split(r"([{][osdupq][}])", want) if w)
        joins = want is not None or ref in ("#z", "", "HTTPS://E.com:443", "mailto:A@b.c")
        return f"SELECT page_id, CAST({k} AS BIGINT) AS pos, {value} AS resolved, {str(joins).lower()} AS joins FROM pages"

    return " UNION ALL ".join(row(k, r, w) for k, (r, w) in enumerate(CASES))


def _spellings(d: Spark) -> str:
    """the key of every page's URL, spelled in ways that a parser takes for the same."""
    host, rest = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)", "regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)"
    spelled = ["url", f"upper(regexp_extract(url, '^([a-z]+)', 1)) || '://' || upper({host}) || {rest}", f"'https://' || {host} || ':443' || {rest}", f"'http://u:p@' || {host} || ':080' || {rest}", f"'  ' || {host} || {rest} || ' '",
               f"'https:' || {host} || {rest}", f"'https:\\\\\\\\' || {host} || '/%2e/x/..' || {rest}", f"'https://' || {host} || {rest} || '#top'", f"'https://' || replace({host}, 'e', '%65') || {rest}"]
    every = d.explode("SELECT page_id, url FROM pages", "page_id", d.array(spelled), "spelled")
    return d.once(every, "page_id, pos", u.canonical_key(d, "spelled"), "canonical")


def _spellings_plain() -> str:
    path = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    kept = "array_to_string(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|ref|fbclid)(=|$)')), '&')"
    key = f"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || {path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"
    return f"SELECT page_id, CAST(n AS BIGINT) AS pos, {key} AS canonical FROM pages, range(9) AS r(n)"


def _canonical(d: Spark) -> str:
    return f"SELECT canonical, count(*) AS n_pages, min(page_id) AS first_page FROM ({d.once('SELECT page_id, url FROM pages', 'page_id', u.canonical_key(d, 'url'), 'canonical')}) GROUP BY canonical"


def _links(d: Spark) -> str:
    hrefs = d.explode("SELECT page_id, url, html FROM pages", "page_id, url", d.extract_all("html", HREF), "href")
    plain = f"SELECT * FROM ({hrefs}) WHERE trim(href) <> '' AND NOT {d.rlike('trim(href)', r'^(#|(?i)(javascript|mailto|tel):)')}"
    kept = d.once(plain, "page_id, pos", u.joined(d, "url", "trim(href)"), "link")
    return f"SELECT page_id, link, min(pos) AS pos FROM ({kept}) WHERE link IS NOT NULL GROUP BY page_id, link"


def _hrefs(d: Spark) -> str:
    hrefs = d.explode("SELECT page_id, url, html FROM pages", "page_id, url", d.extract_all("html", r"""(?i)href\s*=\s*["']([^"']*)["']"""), "href")
    return f"SELECT * FROM ({d.once(hrefs, 'page_id, pos', u.joined(d, 'url', 'href'), 'link')}) WHERE {u.is_http(d, 'link')}"


def _titles(d: Spark) -> str:
    return f"""SELECT page_id, {t.collapse(d, d.extract("html", r"(?is)<title[^>]*>(.*?)</title>"))} AS title, trim({d.extract("html", r'(?is)<html[^>]*\slang="([^"]*)"')}) AS lang,
        {d.extract("html", r'(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"')} AS canonical, {d.size(d.extract_all("html", "(?i)(<p>)"))} AS n_paragraphs FROM pages"""


def _host_stats(d: Spark) -> str:
    return f"""SELECT {u.host(d, "url")} AS host, count(*) AS n_pages, count(DISTINCT {u.path(d, "url")}) AS n_paths, CAST(sum(CASE WHEN {u.has_query(d, "url")} THEN 1 ELSE 0 END) AS BIGINT) AS n_with_query,
        CAST(sum(length(html)) AS BIGINT) AS html_chars FROM pages GROUP BY 1"""


def _markdown(d: Spark) -> str:
    md = "text || " + d.lit("\n\n\n\n![x](data:image/png;base64,AA==) [Skip to content](#main)\n\n\nend")
    done = f"trim({t.collapse_blank_lines(d, t.drop_skip_links(d, t.drop_base64_images(d, md)))})"
    return f"SELECT doc_id, {done} AS markdown, {t.solid_length(d, done)} AS solid, {t.is_thin(d, done)} AS thin FROM documents"


def _skeleton(d: Spark) -> str:
    extra = ", ".join(
        f"({-1 - i}, {d.lit(x)})"
        for i, x in enumerate(["# Loading...\nLoading\n- **Please wait**…\ntext", "1. loading content\nloaded", "> *Loading*\n\n\n\n`loading`\n\nkeep\nplease wait.", ""])
    )
    rows = f"SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {extra}) AS v(doc_id, text)"
    return f"""SELECT doc_id, {t.skeleton_lines(d, "text")} AS n_skeleton, {t.skeleton_lines(d, "text")} >= 3 AS incomplete, CAST(length({t.strip_skeletons(d, "text")}) AS BIGINT) AS kept_chars FROM ({rows})"""


def _thin(d: Spark) -> str:
    body = d.replace(d.replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return f"SELECT page_id, {t.solid_length(d, body)} AS solid, {t.is_thin(d, body, 2000)} AS thin FROM pages"


def _markdown_links(d: Spark) -> str:
    md = d.lit("see [a](https://a.example/x 'title') ![i](http://i.example/p.png) <https://auto.example/> [r](/rel) <mailto:q@w> [b](https://b.example)") + " || text"
    inline = d.transform(d.extract_all("md", r"\]\(([^)]*)\)"), "x", d.extract("trim(x)", r"^(\S*)"))
    auto = d.extract_all("md", r"<(http[^>\s]*)>")
    every = f"{'concat' if d.name == 'spark' else 'list_concat'}({inline}, {auto})"
    links = d.explode(f"SELECT doc_id, {md} AS md FROM documents", "doc_id", every, "link")
    return f"SELECT doc_id, pos, link FROM ({links}) WHERE {d.rlike('link', '^https?://')}"


_STATES = [
    '<script id="__NEXT_DATA__" type="application/json">{"buildId":"b-1","props":{"x":1}}</script>',
    '<script type="application/ld+json">{"@type":"Product"}</script><script type="application/ld+json">{bad</script><script type="application/ld+json">[1,2]</script>',
    '<script>self.__next_f.push([1,"x"])</script><script src="/_next/static/chunks/a.js"></script><script src="/_next/static/XyZ-9/_buildManifest.js"></script>',
    '<script>window.__BUILD_ID = "id_77";</script>', "<p>none</p>",
]


def _state(d: Spark) -> str:
    rows = ", ".join(f"({i}, {d.lit(x)})" for i, x in enumerate(_STATES))
    blob = state.next_data(d, "html")
    ld = d.filter(d.extract_all("html", r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), "x", state.valid_json(d, "x"))
    facts = f"""SELECT id, CASE WHEN {blob} <> '' AND {state.valid_json(d, blob)} THEN 'next_data' WHEN {d.size(ld)} > 0 THEN 'json_ld' ELSE 'miss' END AS origin, {d.size(ld)} AS n_ld,
        {state.build_id(d, "html")} AS build_id, {state.app_router(d, "html")} AS app_router FROM (SELECT id, html FROM (VALUES {rows}) AS v(id, html) UNION ALL SELECT 1000 + page_id, html FROM pages)"""
    return f"SELECT *, CASE WHEN build_id IS NOT NULL THEN '/_next/data/' || build_id || '/index.json' END AS data_url FROM ({facts})"


def _scripts(d: Spark) -> str:
    tags = d.explode("SELECT page_id, html || '<script type=\"module\" src=\"m.js\"></script><script type=\"application/json\">{}</script>' AS html FROM pages", "page_id", d.extract_all("html", r"(?is)(<script\b[^>]*>)"), "tag")
    kind = d.extract("lower(tag)", r"""\stype\s*=\s*["']?([^"'\s>]*)""")
    return f"""SELECT page_id, pos, CASE WHEN {kind} = 'module' THEN 'module' WHEN {kind} IN ('', 'text/javascript', 'application/javascript', 'text/ecmascript', 'application/ecmascript', 'application/x-javascript') THEN 'classic' ELSE 'data' END AS kind,
        {d.rlike("lower(tag)", r"\ssrc\s*=")} AS external FROM ({tags})"""


def _cleaned(d: Spark) -> str:
    no_comments = d.replace("html", r"(?s)<!--.*?-->")
    head, body = d.extract("html", r"(?is)(<head[^>]*>.*?</head>)"), d.extract("html", r"(?is)(<body[^>]*>.*?</body>)")
    return f"""SELECT page_id, md5({no_comments}) AS no_comments, CAST(length({head}) AS BIGINT) AS head_chars, CAST(length({body}) AS BIGINT) AS body_chars,
        md5('<html>' || {head} || CASE WHEN {body} = '' THEN html ELSE {body} END || '</html>') AS spliced, md5({t.strip_tags(d, d.extract("html", r"(?is)<footer>(.*?)</footer>"))}) AS footer FROM pages"""


def _text_functions(d: Spark) -> str:
    cases = ["language-js x", "lang-py hl", "hljs rust", "hljs", "", "a  b"]
    rows = ", ".join(f"({i}, {d.lit(c)})" for i, c in enumerate(cases))
    sets = ["a.png 1x, b.png 2x", "s.jpg 320w, l.jpg 1280w, m.jpg 640w", "only.png", ""]
    srcs = ", ".join(f"({i}, {d.lit(c)})" for i, c in enumerate(sets))
    part = d.explode(f"SELECT id, s FROM (VALUES {srcs}) AS v(id, s)", "id", d.split("s", ","), "c")
    size = f"CAST(coalesce(TRY_CAST({d.extract('trim(c)', r'\s([0-9.]+)[wx]$')} AS DOUBLE), 1) AS DOUBLE)"
    ranked = f"SELECT id, {d.extract('trim(c)', r'^(\S*)')} AS src, row_number() OVER (PARTITION BY id ORDER BY {size} DESC, pos) AS r FROM ({part})"
    return f"""SELECT 'code' AS what, id, {t.code_language(d, "c")} AS value FROM (VALUES {rows}) AS v(id, c)
        UNION ALL SELECT 'srcset', id, src FROM ({ranked}) WHERE r = 1
        UNION ALL SELECT 'collapse', id, {t.collapse(d, "c || '  x '")} FROM (VALUES {rows}) AS v(id, c)
        UNION ALL SELECT 'stub', id, coalesce(nullif(trim(c), ''), '{{}}') FROM (VALUES {rows}) AS v(id, c)
        UNION ALL SELECT 'tokens', id, CASE WHEN {d.exists(d.split("c", " "), "x", "x = 'hljs'")} THEN 'has' ELSE 'not' END FROM (VALUES {rows}) AS v(id, c)
        UNION ALL SELECT 'truncate', doc_id, md5({t.truncate(d, "text")}) FROM documents"""


def _meta(d: Spark) -> str:
    html = d.lit('<meta property="og:title" content="T1"><meta name="og:title" content="T0"><meta name="description" content=" D "><meta name="robots" content=""><meta name="robots" content="noindex">')
    metas = d.explode(f"SELECT page_id, {html} || html AS html FROM pages", "page_id", d.extract_all("html", r"(?is)(<meta\b[^>]*>)"), "tag")
    attr = lambda n: d.extract("tag", rf'(?i)\s{n}="([^"]*)"')
    rows = f"SELECT page_id, pos, CASE WHEN {attr('property')} <> '' THEN 0 ELSE 1 END AS kind, CASE WHEN {attr('property')} <> '' THEN {attr('property')} ELSE {attr('name')} END AS k, trim({attr('content')}) AS v FROM ({metas})"
    ranked = f"SELECT page_id, k, v, row_number() OVER (PARTITION BY page_id, k ORDER BY kind, pos) AS r FROM ({rows}) WHERE k <> '' AND v <> ''"
    return f"SELECT page_id, k AS key, v AS value FROM ({ranked}) WHERE r = 1"


def _encoded(d: Spark) -> str:
    enc = "replace(replace(url_encode(x), '%7E', '~'), '*', '%2A')" if d.name == "spark" else "replace(url_encode(x), '%20', '+')"
    return f"SELECT page_id, {enc} AS encoded FROM (SELECT page_id, url || ' a~b*é(/)' AS x FROM pages)"


def _log_lines(d: Spark) -> str:
    first = "SELECT event_type || ' ' || CAST(user_id % 60 AS VARCHAR(10)) AS line, min(event_id) AS first_at, count(*) AS n FROM events GROUP BY 1"
    return f"SELECT line, first_at, n FROM ({first}) ORDER BY first_at LIMIT 96"


both("percent_encoded", "F31", _encoded)
both("log_lines", "K07", _log_lines)
both("url_parts", "F02 F04 F09 F10 F11 E10 E22 E32", _url_parts)
both("url_cases", "F01 F02 F03 F39 M28", _url_cases, lambda d: _url_cases_plain())
both("url_spellings", "F05 F06 F07", _spellings, lambda d: _spellings_plain())
both("canonical_urls", "F05 F06 F07", _canonical)
both("page_links", "D01 F01 C09 J08", _links)
both("page_hrefs", "D02", _hrefs)
both("page_titles_lang", "C25 C26 C22", _titles)
both("host_stats", "A01 A13 F11", _host_stats)
both("markdown_post", "C17 C18 C20 C21 F22", _markdown)
both("skeleton_lines", "E14 E15 E16 I04", _skeleton)
both("thin_pages", "E17 F22", _thin)
both("markdown_links", "D03", _markdown_links)
both("embedded_state", "D04 D05 D06 D11 D12 D13 D14 D15 D16", _state)
both("page_scripts", "D23 D34 D35", _scripts)
both("cleaned_parts", "C06 C28 C29 F16", _cleaned)
both("text_functions", "C08 C11 F18 F21 F23 F38 D35", _text_functions)
both("named_meta", "C23 C24", _meta)
