"""Links, metadata and scripts of pages out of their token stream: native expressions from the scan on, no Python workers.

Each page's tags are cut once (``once``) and read as an array; links and scripts need no shuffle, metadata one over the few values of each page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from webloom.functions import text, urlparse
from webloom.functions.dialect import SPARK as S
from webloom.functions.markup import attribute, decoded, tags
from webloom.html.page import NAMED_META

SPACE = r"^\s+|\s+\z"
CLASSIC = ("", "text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript", "application/x-javascript")


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, {S.lit(SPACE)}, '')"


def _once(df: DataFrame, columns: list[str], name: str, expression: str) -> DataFrame:
    return df.selectExpr(*columns, f"explode(array({expression})) AS {name}")


def _tags(pages: DataFrame, names: str) -> DataFrame:
    return _once(pages.select("page_id", "url", "html"), ["page_id", "url"], "tags", tags("html", names))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): what the anchors name, in order and once. A base tag counts; where the page's own URL is none, references stay as they are. Anchors without a
    reference and those of scripts, mail, telephones and places on the page are left out; null pages have no links."""
    href = attribute("t", "href")
    base = f"element_at(transform(filter(tags, t -> t.tag = 'base' AND array_contains(t.n, 'href')), t -> {href}), 1)"
    based = _once(_tags(pages, "a|base"), ["page_id", "url", "tags"], "first_base", f"try_{base}")
    placed = _once(based, ["page_id", "url", "tags"], "at", f"CASE WHEN first_base IS NULL THEN {urlparse.normal('url')} ELSE coalesce({urlparse.joined('url', _trimmed('first_base'))}, {urlparse.normal('url')}) END")
    hrefs = f"filter(transform(filter(tags, t -> t.tag = 'a' AND array_contains(t.n, 'href')), t -> {_trimmed(href)}), h -> h <> '' AND NOT {S.rlike('h', '^(?:#|(?i:javascript|mailto|tel):)')})"
    found = f"array_distinct(filter(transform({hrefs}, h -> CASE WHEN at IS NULL THEN h ELSE {urlparse.joined('at', 'h')} END), l -> l IS NOT NULL))"
    return _once(placed, ["page_id", "at"], "found", found).selectExpr("page_id", "posexplode(found) AS (pos, link)").selectExpr("page_id", "CAST(pos AS BIGINT) AS pos", "link")


def metadata(pages: DataFrame) -> DataFrame:
    """(page_id, key, value): title, language, the named metas by their own names, all metas by theirs, the alternate locales (joined by commas), canonical
    address and icon. The first value of a key counts, named ones before the others; a title is taken from the metas where the page has none."""
    get = lambda name: attribute("t", name)
    first = lambda rows, value: f"try_element_at(transform(filter(tags, t -> {rows}), t -> {value}), 1)"
    metas = "filter(tags, t -> t.tag = 'meta')"
    meta = f"transform({metas}, (t, i) -> named_struct('i', i, 'property', {get('property')}, 'name', {get('name')}, 'item', {get('itemprop')}, 'content', {_trimmed('coalesce(' + get('content') + ', ' + chr(39) * 2 + ')')}))"
    head = _tags(pages, "html|title|meta|link|base").selectExpr(
        "page_id",
        "url",
        f"{first('t.tag = ' + chr(39) + 'title' + chr(39), text.collapse(S, decoded('t.text')))} AS title",
        f"{first('t.tag = ' + chr(39) + 'html' + chr(39) + ' AND array_contains(t.n, ' + chr(39) + 'lang' + chr(39) + ')', _trimmed(get('lang')))} AS lang",
        f"filter({meta}, m -> m.content <> '') AS metas",
        f"filter(transform(filter(tags, t -> t.tag = 'link'), t -> named_struct('rel', lower(coalesce({get('rel')}, '')), 'href', {_trimmed('coalesce(' + get('href') + ', ' + chr(39) * 2 + ')')})), l -> l.href <> '') AS links",
    )
    names = "map(" + ", ".join(f"{S.lit(k)}, {S.lit(v)}" for k, v in NAMED_META.items()) + ")"
    # key, order of the kind of value, place
    own = [
        "transform(array_compact(array(nullif(title, ''))), x -> named_struct('k', 'title', 'o', 0, 'i', 0, 'v', x))",
        "transform(array_compact(array(nullif(lang, ''))), x -> named_struct('k', 'language', 'o', 0, 'i', 0, 'v', x))",
        f"transform(filter(metas, m -> map_contains_key({names}, m.property)), m -> named_struct('k', {names}[m.property], 'o', 1, 'i', m.i, 'v', m.content))",
        f"transform(filter(metas, m -> map_contains_key({names}, m.name)), m -> named_struct('k', {names}[m.name], 'o', 2, 'i', m.i, 'v', m.content))",
        "CASE WHEN exists(metas, m -> m.property = 'og:locale:alternate') THEN array(named_struct('k', 'ogLocaleAlternate', 'o', 3, 'i', 0, 'v', array_join(transform(filter(metas, m -> m.property = 'og:locale:alternate'), m -> m.content), ','))) ELSE array() END",
        f"transform(filter(metas, m -> {_trimmed('coalesce(m.name, m.property, m.item)')} <> ''), m -> named_struct('k', {_trimmed('coalesce(m.name, m.property, m.item)')}, 'o', 4, 'i', m.i, 'v', m.content))",
        "transform(filter(metas, m -> m.property = 'og:title' OR m.name = 'og:title'), m -> named_struct('k', 'title', 'o', CASE WHEN m.property = 'og:title' THEN 5 ELSE 6 END, 'i', m.i, 'v', m.content))",
        f"transform(filter(metas, m -> {_trimmed('coalesce(m.name, m.property, m.item)')} = 'twitter:title'), m -> named_struct('k', 'title', 'o', 7, 'i', m.i, 'v', m.content))",
    ]
    canonical = f"try_element_at(transform(filter(links, l -> {_trimmed('l.rel')} = 'canonical'), l -> l.href), 1)"
    token = "split(trim(regexp_replace(l.rel, '\\\\s+', ' ')), ' ')"
    icon = f"coalesce(try_element_at(transform(filter(links, l -> array_contains({token}, 'icon')), l -> l.href), 1), try_element_at(transform(filter(links, l -> exists({token}, x -> contains(x, 'icon'))), l -> l.href), 1))"
    named = [f"transform(array_compact(array({ref})), x -> named_struct('k', '{key}', 'o', -1, 'i', 0, 'v', x))" for key, ref in (("canonical", canonical), ("favicon", icon))]
    rows = head.selectExpr("page_id", "url", f"explode(concat({', '.join(own + named)})) AS r")
    best = rows.selectExpr("page_id", "url", "r.k AS key", "struct(r.o, r.i) AS place", "r.v AS value").groupBy("page_id", "key").agg(*_first())
    kept = S.rlike("key", "^(?:canonical|favicon)$") + " AND place.o = -1"
    return _once(best, ["page_id", "key", "value", "place", "url"], "full", f"CASE WHEN {kept} THEN {urlparse.resolve('url', 'value')} ELSE value END").selectExpr("page_id", "key", "full AS value")


def _first() -> list:
    from pyspark.sql import functions as F

    return [F.min_by("value", "place").alias("value"), F.min("place").alias("place"), F.min("url").alias("url")]


def scripts(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, src, chars): the scripts in order; kind is classic, module or data, src null for inline ones."""
    kind = f"lower({_trimmed('coalesce(' + attribute('t', 'type') + ', ' + chr(39) * 2 + ')')})"
    row = f"named_struct('kind', CASE WHEN {kind} = 'module' THEN 'module' WHEN {kind} IN ({', '.join(map(S.lit, CLASSIC))}) THEN 'classic' ELSE 'data' END, 'src', {attribute('t', 'src')}, 'chars', CAST(length(t.text) AS BIGINT))"
    return _tags(pages, "script").selectExpr("page_id", f"posexplode(transform(tags, t -> {row})) AS (pos, s)").selectExpr("page_id", "CAST(pos AS BIGINT) AS pos", "s.kind", "s.src", "s.chars")
