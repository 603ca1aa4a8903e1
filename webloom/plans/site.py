"""Queries on site maps, crawl frontiers and URL batches."""

from __future__ import annotations

from webloom.functions import urls as u
from webloom.functions.dialect import Spark
from webloom.plans.base import both
from webloom.plans.web import _links

MAX_CHILDREN = 5
MAPS = (
    ("https://example.org/sitemap.xml", 200, "<sitemapindex>" + "".join(f"<sitemap><loc> https://example.org/s{i}.xml </loc></sitemap>" for i in range(7)) + "</sitemapindex>"),
    *((f"https://example.org/s{i}.xml", 200 if i != 3 else 404, f"<urlset><url><loc>https://example.org/p/{i}?a=1&amp;b=2</loc></url><url><loc></loc></url><url><loc>https://example.org/p/x#f</loc></url></urlset>") for i in range(7)),
    ("https://example.com/sitemap.xml", 200, "<urlset><url><loc>https://example.com/one</loc></url><url><loc>https://sub.example.com/two</loc></url><url><loc>https://other.example/3</loc></url><loc>open"),
    ("https://example.net/sitemap.xml", 200, ""),
)


def _map_rows(d: Spark) -> str:
    rows = ", ".join(f"({d.lit(a)}, {b}, {d.lit(c)})" for a, b, c in MAPS)
    return f"SELECT url AS map, status, xml FROM (VALUES {rows}) AS v(url, status, xml)"


def _locs(d: Spark) -> str:
    every = d.explode(_map_rows(d), "map, status, xml", d.extract_all("xml", r"(?s)<loc>(.*?)</loc>"), "raw")
    return f"SELECT map, status, contains(xml, '<sitemapindex') AS is_index, pos, replace(trim(raw), '&amp;', '&') AS loc FROM ({every}) WHERE trim(raw) <> ''"


def _expanded(d: Spark) -> str:
    """Links of plain maps, and of the first children of an index, one level deep."""
    locs = _locs(d)
    return f"""SELECT map AS root, loc, pos, CAST(0 AS BIGINT) AS child FROM ({locs}) WHERE NOT is_index AND status < 400 AND map LIKE '%/sitemap.xml'
        UNION ALL SELECT i.map, c.loc, c.pos, i.pos FROM ({locs}) i JOIN ({locs}) c ON i.loc = c.map WHERE i.is_index AND i.status < 400 AND i.pos < {MAX_CHILDREN} AND c.status < 400 AND NOT c.is_index"""


def _map(d: Spark) -> str:
    """Site map links before page links, on the site or below it, without fragments, first ones kept."""
    # a host that is an address or one label is its own site
    site = f"CASE WHEN {d.rlike('host', r'^[0-9.]+$|:|^[^.]*$')} THEN host ELSE {d.extract('host', '([^.]+[.][^.]+)$')} END"
    return _placed(d, f"SELECT page_id, {site} AS site FROM (SELECT page_id, {u.host(d, 'url')} AS host FROM pages)", "site <> ''")


def _placed(d: Spark, pages: str, sites: str) -> str:
    listed = f"SELECT {d.extract('root', '://([^/]*)')} AS site, {u.without_fragment(d, 'loc')} AS link, 0 AS source, child, pos, CAST(0 AS BIGINT) AS page_id FROM ({_expanded(d)})"
    linked = f"SELECT p.site, {u.without_fragment(d, 'l.link')} AS link, 1 AS source, CAST(0 AS BIGINT) AS child, l.pos, l.page_id FROM ({_links(d)}) l JOIN ({pages}) p ON l.page_id = p.page_id"
    every = f"SELECT *, {u.host(d, 'link')} AS host FROM ({listed} UNION ALL {linked})"
    kept = f"SELECT *, row_number() OVER (PARTITION BY site, link ORDER BY source, child, page_id, pos) AS n FROM ({every}) WHERE {sites} AND {u.is_http(d, 'link')} AND {u.same_site(d, 'host', 'site')}"
    placed = f"SELECT site, link, source, row_number() OVER (PARTITION BY site ORDER BY source, child, page_id, pos, link) AS place FROM ({kept}) WHERE n = 1"
    return f"SELECT site, link, CAST(source AS BIGINT) AS source, CAST(place AS BIGINT) AS place FROM ({placed}) WHERE place <= least(greatest(500, 1), 100000)"


def _searched(d: Spark) -> str:
    return f"SELECT site, count(*) AS n, CAST(sum(CASE WHEN contains(lower(link), 'p/') OR contains(lower(link), 'e') THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN source = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_listed FROM ({_map(d)}) GROUP BY site"


def _admitted(d: Spark, link: str, seed: str) -> str:
    """Http, on the seed's host, excluded patterns first, then included ones."""
    path = u.path(d, link)
    return f"{u.is_http(d, link)} AND {u.host(d, link)} = {u.host(d, seed)} AND NOT {d.rlike(path, '(?i)privacy|^/x')} AND {d.rlike(path, '[a-z]')}"


def _frontier(d: Spark) -> str:
    """Candidate links of pages that are not pages themselves."""
    candidates = f"SELECT l.page_id, p.url AS seed, l.pos, {u.without_fragment(d, 'l.link')} AS link FROM ({_links(d)}) l JOIN pages p ON l.page_id = p.page_id"
    return f"""SELECT link, min(page_id) AS first_page, count(*) AS n FROM ({candidates}) c WHERE {_admitted(d, "link", "seed")}
        AND NOT EXISTS (SELECT 1 FROM (SELECT {u.without_fragment(d, "url")} AS known FROM pages) k WHERE k.known = c.link) GROUP BY link"""


def _batch(d: Spark) -> str:
    """Valid and invalid URLs of a request, in order."""
    raw = ["https://a.example/1", "ftp://b.example", " https://c.example/2 ", "nope", "", "http://", "HTTP://D.example"]
    rows = ", ".join(f"({i}, {d.lit(x)})" for i, x in enumerate(raw))
    return f"""SELECT CAST(id AS BIGINT) AS id, trim(raw) AS url, {u.is_http(d, "trim(raw)")} AS valid, CASE WHEN {u.is_http(d, "trim(raw)")} THEN NULL ELSE raw END AS invalid,
        count(*) OVER () AS total, CAST(sum(CASE WHEN {u.is_http(d, "trim(raw)")} THEN 1 ELSE 0 END) OVER () AS BIGINT) AS n_valid FROM (VALUES {rows}) AS v(id, raw)"""


both("sitemap_locs", "A05", _locs)
both("sitemap_expanded", "A06 G06", _expanded)
both("site_map", "K01 K03 E34 J08 J09 L15 M17", _map)
both("site_map_counts", "E34 M17", _searched)
both("frontier_new", "G03 E30 F04", _frontier)
both("url_batch", "E33 K04 M19 I13", _batch)
