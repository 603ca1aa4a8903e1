"""Page operators over DataFrames of acquired pages: one parse per page, in Arrow batches.

Each operator reads the named columns only. ``url`` and ``html`` may be null; a page that cannot be read gives
an error text instead of failing its task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.html import page as p
from webloom.html.readable import readable
from webloom.html.tree import parse
from webloom.session import ship

PAGE = "markdown string, incomplete boolean, metadata string, html string, links array<string>, error string"
FORMATS = p.FORMATS


def per_row(df: DataFrame, key: str, extra: list[str], fields: str, make) -> DataFrame:
    """Adds fields to (key, *extra): ``make`` takes a row's extra values and gives a list of dicts of fields."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {fields}"
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                keys, *rest = (c.to_pylist() for c in b.slice(s, 500).columns)
                rows = [{key: k} | r for k, *x in zip(keys, *rest, strict=True) for r in make(*x)]
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return df.select(key, *extra).mapInArrow(run, schema)


def scrape_pages(pages: DataFrame, key: str = "page_id", formats: tuple[str, ...] = FORMATS, only_main: bool = True, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Markdown, cleaned HTML, metadata (JSON) and links of every page; formats not asked for are not
    built and null, and so is incomplete without Markdown.
    Columns status and content_type are used where they exist."""
    df = pages
    for name, default in (("status", F.lit(200)), ("content_type", F.lit("text/html"))):
        if name not in df.columns:
            df = df.withColumn(name, default)

    def make(url, html, status, content_type):
        got = p.scrape(html, url, status or 200, content_type or "text/html", only_main, include, exclude, formats)
        if got["metadata"] is not None:
            got["metadata"] = json.dumps(got["metadata"], ensure_ascii=False)
        return [got]

    return per_row(df, key, ["url", "html", "status", "content_type"], PAGE, make)


def schema_rows(pages: DataFrame, schema: dict, key: str = "page_id") -> DataFrame:
    """Selector-schema extraction: a struct whose type follows from the schema, and warnings."""

    def make(url, html):
        data, warnings = p.extract_schema(html or "", url or "", schema)
        return [{"data": data, "warnings": list(dict.fromkeys(warnings))}]

    return per_row(pages, key, ["url", "html"], f"data {p.schema_type(schema)}, warnings array<string>", make)


def page_state(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Embedded state of each page that has some: its origin and its JSON."""

    def make(html):
        got = p.embedded_state(html or "")
        return [{"origin": got[0], "data": json.dumps(got[1], ensure_ascii=False)}] if got else []

    return per_row(pages, key, ["html"], "origin string, data string", make)


def page_scripts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Script inventory in document order."""

    def make(html):
        return [{"pos": i, "kind": k, "src": s, "chars": len(t)} for i, (k, s, t) in enumerate(p.scripts(html or ""))]

    return per_row(pages, key, ["html"], "pos long, kind string, src string, chars long", make)


def tree_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Links by the tree: base href, trimmed, resolved, without repeats, in order."""
    return per_row(pages, key, ["url", "html"], "pos long, link string", lambda url, html: [{"pos": i, "link": x} for i, x in enumerate(p.links(parse(html or ""), url or ""))])


def main_content(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The text of each page's main content by scores, whatever its selectors say; null where it has none."""

    def make(html):
        got = readable(parse(html or ""))
        return [{"text": got.text(" ") if got is not None else None}]

    return per_row(pages, key, ["html"], "text string", make)


def search_hits(results: DataFrame, key: str = "id") -> DataFrame:
    """Hits of result pages (key, engine, url, html); engines that are not known give none."""

    def make(engine, url, html):
        return p.parse_results(engine, html or "", url or "") if engine in p.ENGINES else []

    return per_row(results, key, ["engine", "url", "html"], "engine string, rank int, title string, description string, url string", make)


def with_rendered(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The render stage: pages with shell html and rendered_html; which of both wins, by Markdown length, skeleton
    lines and collapse."""

    def make(url, html, rendered):
        shell = p.scrape(html, url)
        if rendered is None:
            return [{"winner": "shell", "markdown": shell["markdown"]}]
        live = p.scrape(rendered, url)
        a, b = p.solid(shell["markdown"]), p.solid(live["markdown"])
        if a > 0 and b * 5 < a:
            return [{"winner": "needs_browser" if a < 1000 else "shell", "markdown": shell["markdown"]}]
        wins = not live["incomplete"] and (shell["incomplete"] or (b > a and b >= p.THIN))
        return [{"winner": "rendered" if wins else "shell", "markdown": (live if wins else shell)["markdown"]}]

    return per_row(pages, key, ["url", "html", "rendered_html"], "winner string, markdown string", make)
