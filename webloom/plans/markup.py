"""Queries on the token stream of pages: links, metadata and scripts without a tree.

An odd tail is put at the end of each page: what stands in comments, quotes and raw elements, tags in capitals, references, repeated attributes. The SQL of the
comparison knows what the tail holds, and reads the pages' own markup, which is plain, by simple patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.functions.dialect import DUCK
from webloom.operators import markup
from webloom.plans.base import only, run_sql
from webloom.plans.web import _links

TAIL = (
    """<!-- <a href="/in/comment"> --><script type=application/json>{"x":"<a href='/in/script'>"}</script><A Title='a > b' HREF = /odd?a=1&amp;b=2#f href=/second>x</A><a href="#top"><a href=" /odd/ü ">""",
    """<meta PROPERTY=og:title content="A &lt; B &#8364;"><meta name='og:title' content=later><meta name=Keywords content=' a, b '><meta itemprop=item content=i><meta name=empty content=""><link rel="Shortcut ICON" href='fav.ico'><script src='/s.js?x=1&amp;y' type=" MODULE ">a<b</SCRIPT >""",
)
PAGES = "SELECT page_id, url, html || {0} || {1} AS html FROM pages"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.functions.dialect import SPARK

    return run_sql(spark, sf_dir, PAGES.format(*map(SPARK.lit, TAIL)))


ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_LINKS = f"""WITH l AS (SELECT page_id, link, pos FROM ({_links(DUCK)}) UNION ALL SELECT page_id, {ORIGIN} || '/odd?a=1&b=2#f', 1000000 FROM pages UNION ALL SELECT page_id, {ORIGIN} || '/odd/%C3%BC', 1000001 FROM pages)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, link FROM (SELECT page_id, link, min(pos) AS pos FROM l GROUP BY page_id, link)"""
PLAIN = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
TITLE = "trim(regexp_replace(" + PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + r", '\s+', ' ', 'g'))"
LANGUAGE = """regexp_extract(html, '<html lang="([^"]*)"', 1)"""
_METADATA = f"""WITH t AS (SELECT page_id, url, {TITLE} AS title, {LANGUAGE} AS lang FROM pages)
    SELECT page_id, 'title' AS key, CASE WHEN title = '' THEN 'A < B €' ELSE title END AS value FROM t UNION ALL SELECT page_id, 'language', lang FROM t WHERE lang <> ''
    UNION ALL SELECT page_id, k, v FROM t, (VALUES ('ogTitle', 'A < B €'), ('og:title', 'A < B €'), ('Keywords', 'a, b'), ('item', 'i')) AS m(k, v)
    UNION ALL SELECT page_id, 'favicon', regexp_extract(url, '^([a-z]+://[^/?#]*/([^?#]*/)?)', 1) || 'fav.ico' FROM t"""
_SCRIPTS = """WITH own AS (SELECT page_id, unnest(s) AS body, generate_subscripts(s, 1) - 1 AS pos, len(s) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1) AS s FROM pages)),
    k AS (SELECT page_id, len(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS n FROM pages)
    SELECT page_id, CAST(pos AS BIGINT) AS pos, 'classic' AS kind, NULL AS src, length(body) AS chars FROM own UNION ALL SELECT page_id, n, 'data', NULL, 29 FROM k UNION ALL SELECT page_id, n + 1, 'module', '/s.js?x=1&y', 3 FROM k"""

only("native_links", "D01 C09 C10 F03 J08", lambda s, d: markup.links(_pages(s, d)), _LINKS)
only("native_metadata", "C22 C23 C24 C25 C26 C27 F16", lambda s, d: markup.metadata(_pages(s, d)), _METADATA)
only("native_scripts", "D22 D23 D34", lambda s, d: markup.scripts(_pages(s, d)), _SCRIPTS)
