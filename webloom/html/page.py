"""One page: cleaning, Markdown, metadata, links, selector schemas and result lists.

Every function takes text and returns plain values; none raises on bad input.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import parse_qs, urlsplit

from webloom.html import weburl
from webloom.html.markdown import render
from webloom.html.readable import readable
from webloom.html.select import Matcher, Matches, SelectorError, compile_selector, matches, select
from webloom.html.tree import Comment, Element, inner, parse, serialise

# Lists of selectors, names and limits that decide results and are kept as they must be.
ALWAYS_STRIP = "head, meta, noscript, style, script, template, svg, iframe, object, embed"
NOT_MAIN = (
    "header", "footer", "nav", "aside", ".header", ".top", ".navbar", "#header", ".footer", ".bottom", "#footer", ".sidebar", ".side", ".aside", "#sidebar", ".modal", ".popup", "#modal", ".overlay", ".ad", ".ads", ".advert", "#ad",
    ".lang-selector", ".language", "#language-selector", ".social", ".social-media", ".social-links", "#social", ".menu", ".navigation", "#nav", ".breadcrumbs", "#breadcrumbs", ".share", "#share", ".widget", "#widget", ".cookie", "#cookie", ".fc-decoration",
)
KEEP_MAIN = ("#main", ".swoogo-cols", ".swoogo-text", ".swoogo-table-div", ".swoogo-space", ".swoogo-alert", ".swoogo-sponsors", ".swoogo-title", ".swoogo-tabs", ".swoogo-logo", ".swoogo-image", ".swoogo-button", ".swoogo-agenda")
NAMED_META = {
    "og:title": "ogTitle", "og:description": "ogDescription", "og:url": "ogUrl", "og:image": "ogImage", "og:audio": "ogAudio", "og:determiner": "ogDeterminer", "og:locale": "ogLocale", "og:site_name": "ogSiteName", "og:video": "ogVideo",
    "article:section": "articleSection", "article:tag": "articleTag", "article:published_time": "publishedTime", "article:modified_time": "modifiedTime", "dcterms.keywords": "dcTermsKeywords", "dc.description": "dcDescription", "dc.subject": "dcSubject",
    "dcterms.subject": "dcTermsSubject", "dcterms.audience": "dcTermsAudience", "dc.type": "dcType", "dcterms.type": "dcTermsType", "dc.date": "dcDate", "dc.date.created": "dcDateCreated", "dcterms.created": "dcTermsCreated", "keywords": "keywords",
    "robots": "robots", "description": "description",
}
THIN, SKELETONS = 200, 3
MAX_DEPTH, MAX_MATCHES, MAX_FIELDS = 5, 1000, 100
URL_ATTRIBUTES = ("href", "src", "action", "poster")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def solid(text: str) -> int:
    return len("".join(text.split()))


def resolve(base: str | None, ref: str) -> str:
    """An absolute URL for a reference; fragments, other schemes and unusable bases leave it as it is."""
    t = ref.strip()
    if not t or t.startswith("#") or SCHEME.match(t) or not base:
        return ref
    got = weburl.joined(base, t)
    return ref if got is None else got


def base_of(doc: Element, url: str) -> str:
    b = next((e for e in doc.walk() if e.tag == "base" and e.attrs.get("href")), None)
    return resolve(url, b.attrs["href"]) if b is not None else url


def largest_source(candidates: str, current: str | None = None) -> str | None:
    """The largest entry of a srcset; where all sizes are densities, the present source counts as 1x."""
    found = []
    for part in candidates.split(","):
        words = part.split()
        if words:
            m = re.fullmatch(r"([0-9.]+)([wx])", words[1]) if len(words) > 1 else None
            try:
                found.append((float(m[1]) if m else 1.0, m[2] if m else "x", words[0]))
            except ValueError:
                continue
    if found and current and all(k == "x" for _, k, _ in found):
        found.append((1.0, "x", current))
    return max(found, key=lambda f: f[0])[2] if found else None


def clean_tree(doc: Element, url: str, only_main: bool) -> Element:
    """The body without what is never content and, if asked, without page furniture; URLs absolute."""
    base = base_of(doc, url)
    for e in select(doc, ALWAYS_STRIP):
        e.detach()
    for e in [doc, *doc.walk()]:
        e.children = [c for c in e.children if not isinstance(c, Comment)]
    if only_main:
        keep = ", ".join(KEEP_MAIN)
        for e in select(doc, ", ".join(NOT_MAIN)):
            if not select(e, keep, 1):
                e.detach()
    for e in doc.walk():
        if e.tag == "img":
            source = largest_source(e.attrs.get("srcset") or e.attrs.get("data-srcset") or "", e.attrs.get("src")) or e.attrs.get("src") or e.attrs.get("data-src")
            if source:
                e.attrs["src"] = resolve(base, source)
        elif e.tag == "a" and e.attrs.get("href"):
            e.attrs["href"] = resolve(base, e.attrs["href"])
        elif e.tag in ("pre", "code") and e.attrs.get("class"):
            names = e.classes()
            if not any(n.startswith("language-") for n in names):
                lang = next((n[5:] for n in names if n.startswith("lang-")), None) or next((n for n in names if n != "hljs"), None)
                if lang:
                    e.attrs["class"] += f" language-{lang}"
    return doc.first("body") or doc


def clean_html(source: str, url: str, only_main: bool = True) -> str:
    return inner(clean_tree(parse(source), url, only_main))


def filter_tags(source: str, include: list[str] = (), exclude: list[str] = ()) -> str:
    """Without the excluded elements; of the rest the included ones, selector by selector, none within another."""
    if not include and not exclude:
        return source
    doc = parse(source)
    for s in exclude:
        try:
            for e in select(doc, s):
                e.detach()
        except SelectorError:
            continue
    if not include:
        return inner(doc.first("body"))
    found: dict[int, Element] = {}
    for s in include:
        try:
            found |= {id(e): e for e in select(doc, s) if id(e) not in found}
        except SelectorError:
            continue
    return "".join(serialise(e) for e in found.values() if not any(id(a) in found for a in e.ancestors()))


def post_process(md: str) -> str:
    md = re.sub(r"(?i)(!\[[^\]]*\])\(\s*data:[^)]*\)", r"\1(<Base64-Image-Removed>)", md)
    md = re.sub(r"\[([^\[\]]*\n[^\[\]]*)\]\(", lambda m: "[" + m[1].replace("\n", "\\\n") + "](", md)
    md = re.sub(r"(?i)\[skip to content\]\(#[^)]*\)", "", md)
    return re.sub(r"\n{3,}", "\n\n", md).strip()


def is_skeleton(line: str) -> bool:
    core = re.sub(r"^[#>\-*+. \t0-9]+", "", line.strip()).strip().strip("*_` \t").rstrip(".… ")
    return core.lower() in ("loading", "please wait", "loading content")


def metadata(doc: Element, url: str, status: int, content_type: str) -> dict:
    out: dict = {}
    title = doc.first("title")
    if title is not None and (text := title.text(" ")):
        out["title"] = text
    if lang := doc.first("html").attrs.get("lang", "").strip():
        out["language"] = lang
    metas = [e.attrs for e in doc.walk() if e.tag == "meta"]
    for key, name in NAMED_META.items():
        for attr in ("property", "name"):
            if got := next((c for m in metas if m.get(attr) == key and (c := m.get("content", "").strip())), None):
                out.setdefault(name, got)
                break
    if alternates := [c for m in metas if m.get("property") == "og:locale:alternate" and (c := m.get("content", "").strip())]:
        out["ogLocaleAlternate"] = alternates
    for m in metas:
        key = (m.get("name") if "name" in m else m.get("property") if "property" in m else m.get("itemprop") or "").strip()
        if key and (content := m.get("content", "").strip()):
            out.setdefault(key, content)
    if "title" not in out and (got := out.get("ogTitle") or out.get("og:title") or out.get("twitter:title")):
        out["title"] = got
    links = [(e.attrs.get("rel", "").lower(), e.attrs.get("href", "").strip()) for e in doc.walk() if e.tag == "link"]
    if got := next((h for r, h in links if r.strip() == "canonical" and h), None):
        out["canonical"] = resolve(url, got)
    if got := next((h for r, h in links if "icon" in r.split() and h), None) or next((h for r, h in links if any("icon" in t for t in r.split()) and h), None):
        out["favicon"] = resolve(url, got)
    return out | {"sourceURL": url, "url": url, "statusCode": status, "contentType": content_type}


def links(doc: Element, url: str) -> list[str]:
    """What the anchors name, in order and once; as written where the page's own URL is none."""
    base, out = weburl.parse(url), {}
    tag = next((e for e in doc.walk() if e.tag == "base" and "href" in e.attrs), None)
    if base and tag is not None:
        base = weburl.parse(tag.attrs["href"].strip(), base) or base
    for e in doc.walk():
        href = e.attrs.get("href", "").strip() if e.tag == "a" else ""
        if href and not href.startswith("#") and not re.match(r"(?i)(javascript|mailto|tel):", href):
            if got := weburl.written(weburl.parse(href, base)) if base else href:
                out[got] = None
    return list(out)


FORMATS = ("markdown", "html", "links", "metadata")


def scrape(source: str | None, url: str | None, status: int = 200, content_type: str = "text/html", only_main: bool = True, include: list[str] = (), exclude: list[str] = (), formats: tuple[str, ...] = FORMATS) -> dict:
    """markdown, incomplete, metadata, html and links of one page; a page that fails has its error said. What is
    not among formats is not built and is None, and so is incomplete without markdown."""
    url, source = url or "", source or ""
    out = dict.fromkeys(("markdown", "incomplete", "metadata", "html", "links", "error"))
    try:
        media = content_type.split(";")[0].strip().lower()
        if media == "application/json" or media.endswith("+json"):
            try:
                md = json.dumps(json.loads(source), indent=2, ensure_ascii=False)
            except ValueError:
                md = source.strip()
            made = {"markdown": md, "incomplete": False, "metadata": metadata(parse(""), url, status, content_type), "html": source, "links": []}
            return out | {k: v for k, v in made.items() if k in formats or k == "incomplete" and "markdown" in formats}
        kept = filter_tags(source, include, exclude)
        doc = parse(kept)
        if "metadata" in formats:
            out["metadata"] = metadata(doc, url, status, content_type)
        if "links" in formats:
            out["links"] = links(doc, url)
        if "html" not in formats and "markdown" not in formats:
            return out
        body = clean_tree(doc, url, only_main)
        if "html" in formats:
            out["html"] = inner(body)
        if "markdown" not in formats:
            return out
        md = post_process(render(body))
        if only_main and solid(md) < THIN:
            whole = clean_tree(parse(kept), url, False)
            article = readable(whole.parent or whole)
            for alt in ([article] if article is not None else []) + [whole]:
                if solid(md) >= THIN:
                    break
                text = post_process(render(alt))
                if solid(text) > solid(md):
                    md = text
        lines = md.split("\n")
        loading = [is_skeleton(x) for x in lines]
        md = re.sub(r"\n{3,}", "\n\n", "\n".join(x for x, s in zip(lines, loading, strict=True) if not s))
        return out | {"markdown": md, "incomplete": sum(loading) >= SKELETONS}
    except RecursionError as e:
        return {"markdown": "", "incomplete": True, "metadata": {"url": url}, "html": "", "links": [], "error": str(e)}


def scripts(source: str) -> list[tuple[str, str | None, str]]:
    """(kind, source URL, text) of the scripts that run, in document order."""
    out = []
    for e in parse(source).walk():
        if e.tag == "script":
            kind = e.attrs.get("type", "").strip().lower()
            kind = "module" if kind == "module" else "classic" if kind in ("", "text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript", "application/x-javascript") else "data"
            out.append((kind, e.attrs.get("src"), "".join(e.texts())))
    return out


def balanced(text: str, start: int, opening: str = "{", closing: str = "}") -> str | None:
    """The span from an opening bracket to its partner; brackets in quoted strings do not count."""
    depth, quote, at = 0, "", start
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return text[start : at + 1]
        at += 1
    return None


def relaxed_json(text: str):
    """JSON that may be wrapped in a comment or CDATA, or be followed by other code; None if there is none."""
    text = re.sub(r"^\s*(?:<!--|//<!\[CDATA\[|<!\[CDATA\[)|(?:-->|//\]\]>|\]\]>)\s*$", "", text).strip().rstrip(";")
    try:
        return json.loads(text)
    except ValueError:
        pass
    starts = sorted((i, c) for c in "{[" if (i := text.find(c)) >= 0)
    for i, c in starts[:1]:
        span = balanced(text, i, c, "}" if c == "{" else "]")
        try:
            return json.loads(span) if span else None
        except ValueError:
            return None
    return None


def embedded_state(source: str) -> tuple[str, object] | None:
    """(origin, data) of the first well-formed state in a page."""
    doc = parse(source)
    tags = [e for e in doc.walk() if e.tag == "script"]
    for e in tags:
        if e.attrs.get("id") == "__NEXT_DATA__" and (got := relaxed_json("".join(e.texts()))) is not None:
            return "next_data", got
    ld = [g for e in tags if e.attrs.get("type", "").lower() == "application/ld+json" and (g := relaxed_json("".join(e.texts()))) is not None]
    if ld:
        return "json_ld", ld
    for e in tags:
        text = "".join(e.texts())
        m = re.search(r"window\.__NUXT__\s*=\s*", text)
        if m and text[m.end() : m.end() + 1] == "{" and (span := balanced(text, m.end())):
            try:
                return "nuxt", json.loads(span)
            except ValueError:
                continue
    return None


# --- selector schemas ---------------------------------------------------------------------------------------


def extract_schema(source: str, url: str, schema: dict) -> tuple[dict, list[str]]:
    """Values of a selector schema, and warnings for what of it cannot be used. The selectors of all fields, nested ones too, are matched in one traversal."""
    doc, warnings = parse(source), []
    found = _matcher(tuple(_selectors(schema, 0))).over(doc)
    return _fields(doc, found, schema, base_of(doc, url), 0, warnings), warnings


@lru_cache(maxsize=64)
def _matcher(selectors: tuple[str, ...]) -> Matcher:
    return Matcher(list(selectors))


def _selectors(schema: dict, depth: int) -> Iterator[str]:
    """The selectors of a schema that can be used."""
    for spec in list(schema.values())[:MAX_FIELDS]:
        spec = {"selector": spec} if isinstance(spec, str) else spec
        if not isinstance(spec, dict) or not isinstance(spec.get("selector"), str):
            continue
        try:
            compile_selector(spec["selector"])
        except SelectorError:
            continue
        yield spec["selector"]
        if isinstance(spec.get("fields"), dict) and depth < MAX_DEPTH:
            yield from _selectors(spec["fields"], depth + 1)


def _fields(scope: Element, found: Matches, schema: dict, base: str, depth: int, warnings: list[str]) -> dict:
    if len(schema) > MAX_FIELDS:
        warnings.append(f"only the first {MAX_FIELDS} fields are used")
    return {name: _spec(scope, found, name, spec, base, depth, warnings) for name, spec in list(schema.items())[:MAX_FIELDS]}


def _spec(scope: Element, found: Matches, name: str, spec, base: str, depth: int, warnings: list[str]):
    spec = {"selector": spec} if isinstance(spec, str) else spec
    if not isinstance(spec, dict) or not isinstance(spec.get("selector"), str):
        warnings.append(f"field {name!r}: no selector")
        return None
    fields, many = spec.get("fields"), bool(spec.get("all"))
    try:
        compile_selector(spec["selector"])
    except SelectorError:
        warnings.append(f"field {name!r}: invalid selector {spec['selector']!r}")
        return None
    if fields is not None and depth >= MAX_DEPTH:
        warnings.append(f"field {name!r}: nested deeper than {MAX_DEPTH}")
        return None
    got = [_fields(e, found, fields, base, depth + 1, warnings) if fields is not None else _read(e, spec.get("attr", "text"), base) for e in found.of(spec["selector"], scope, MAX_MATCHES if many else 1)]
    return [v for v in got if v is not None] if many else got[0] if got else None


def _read(e: Element, attr: str, base: str) -> str | None:
    if attr == "text":
        return e.text()
    if attr == "html":
        return inner(e)
    got = e.attrs.get(attr.lower())
    return resolve(base, got) if got is not None and attr in URL_ATTRIBUTES else got


def schema_type(schema: dict) -> str:
    """The Spark type of a selector schema's values."""

    def one(spec) -> str:
        if not isinstance(spec, dict):
            return "string"
        t = schema_type(spec["fields"]) if isinstance(spec.get("fields"), dict) else "string"
        return f"array<{t}>" if spec.get("all") else t

    return "struct<" + ",".join(f"`{k}`:{one(v)}" for k, v in list(schema.items())[:MAX_FIELDS]) + ">"


# --- result lists -------------------------------------------------------------------------------------------

#: Engine: selectors of a block, its link, its title and its description, each tried in turn.
ENGINES = {
    "duckduckgo": ("a.result__a", None, None, (".result__snippet",)),
    "bing": ("li.b_algo", ("h2 a",), None, (".b_caption p", ".b_algoSlug")),
    "brave": ("div.snippet[data-type=web]", ("a.l1",), (".title", ".search-snippet-title"), (".content", ".desktop-default-regular", ".t-primary")),
    "baidu": ("div.result.c-container", ("h3 a",), None, ("[class*=content-right]", "[class*=abstract]", "[data-module=abstract]")),
    "zapmeta": ("article", ("h2 a", ".organic-results__display-url-link"), ("h2",), ("p",)),
    "yandex": ("li.serp-item", ("h2 a", "a.OrganicTitle-Link", "a.Link", "a.Path", "a[class*=Path-Item]"), ("h2",), (".TextContainer", "[class*=OrganicText]")),
    "mojeek": ("ul.results-standard li", ("a.title", "h2 a"), None, ("p",)),
}


def result_url(raw: str, base: str) -> str | None:
    """Absolute http URL of a result; a redirect that carries its target in uddg is unwrapped."""
    url = weburl.written(weburl.parse(raw)) or weburl.joined(base, raw) or ""
    if not raw.strip() or not url:
        return None
    parts = urlsplit(url)
    if parts.hostname in ("duckduckgo.com", "html.duckduckgo.com") and parts.path.startswith("/l/"):
        url = weburl.written(weburl.parse(parse_qs(parts.query).get("uddg", [url])[0])) or url
    return url if urlsplit(url).scheme in ("http", "https") else None


def parse_results(engine: str, source: str, base: str) -> list[dict]:
    """Hits in page order; ranks count blocks, also those that give no hit."""
    block, link_by, title_by, text_by = ENGINES[engine]
    doc = parse(source)
    blocks, out = select(doc, block), []
    for rank, b in enumerate(blocks, 1):
        pick = lambda selectors, b=b: next((e for s in selectors or () for e in select(b, s, 1)), None)
        a = b if link_by is None else pick(link_by)
        if a is None or not a.attrs.get("href"):
            continue
        title = (pick(title_by).text() if title_by and pick(title_by) is not None else "") or a.text()
        url = result_url(a.attrs["href"], base)
        if not title or not url:
            continue
        text = pick(text_by)
        if text is None and link_by is None:  # the snippet follows the link, before the next one
            order = list(doc.walk())
            at, end = order.index(a), order.index(blocks[rank]) if rank < len(blocks) else len(order)
            text = next((e for e in order[at:end] if any(matches(e, s) for s in text_by)), None)
        out.append({"engine": engine, "rank": rank, "title": title, "description": text.text() if text is not None else "", "url": url})
    return out
