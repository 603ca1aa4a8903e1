"""Command line: ``python -m webloom VERB INPUT OUT``; INPUT is a Parquet table, OUT a folder of text or JSON lines."""

from __future__ import annotations

import argparse
import sys

from webloom import api
from webloom.functions.jsonpath import PathError, compile_path, filter_json
from webloom.session import get_session
from webloom.sources.pages import write_results


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webloom", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, help=about)
        v.add_argument("input")
        v.add_argument("out")
        return v

    for name, about in (("scrape", "pages to Markdown and other formats"), ("batch", "scrape the pages whose URLs are listed")):
        v = verb(name, about)
        v.add_argument("--format", action="append", choices=api._pages.FORMATS, dest="formats")
        v.add_argument("--json", action="store_true")
        v.add_argument("--pretty", action="store_true")
        v.add_argument("--whole", action="store_true", help="the whole page, not its main part")
        if name == "batch":
            v.add_argument("--urls", required=True, help="Parquet table with a column url")
    v = verb("map", "links to a site")
    v.add_argument("site")
    v.add_argument("--limit", type=int, default=5000)
    v.add_argument("--search")
    v = verb("crawl", "breadth first from a URL")
    v.add_argument("seed")
    v.add_argument("--limit", type=int, default=10)
    v.add_argument("--include", action="append")
    v.add_argument("--exclude", action="append")
    v = verb("discover", "ranked requests of each page, from a table of intercepted ones")
    v.add_argument("--limit", type=int, default=20)
    verb("search", "hits of result pages (id, engine, url, html)")
    v = verb("extract", "what a JSONPath finds in a column of JSON text")
    v.add_argument("path")
    v.add_argument("--key", default="page_id")
    v.add_argument("--column", default="data")
    return p


def run(spark, a: argparse.Namespace) -> None:
    table = api.TableSource(a.input).pages(spark)
    if a.verb in ("scrape", "batch"):
        given = {"formats": tuple(a.formats or ("markdown",)), "only_main": not a.whole}
        found = api.scrape(table, **given) if a.verb == "scrape" else api.batch(table, spark.read.parquet(a.urls), **given)
        api.render(found, formats=given["formats"], as_json=a.json, pretty=a.pretty).select("output").write.mode("overwrite").text(a.out)
        return
    if a.verb == "map":
        found = api.map_site(table, a.site, a.limit, a.search)
    elif a.verb == "crawl":
        found = api.crawl(table, a.seed, a.limit, include=a.include, exclude=a.exclude)
    elif a.verb == "discover":
        found = api.discover(table, a.limit)
    elif a.verb == "search":
        found = api.search(table)
    else:
        found = filter_json(table, a.key, a.column, a.path)
    write_results(found, a.out)


def main(args: list[str]) -> int:
    try:
        a = arguments().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if a.verb == "extract":
            compile_path(a.path)  # before a session is made
        run(get_session(), a)
    except (PathError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
