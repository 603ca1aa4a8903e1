"""Marks of the framework that a page was built with, as SQL text for a dialect."""

from __future__ import annotations

from webloom.functions.dialect import Spark

# Names below the static folder that are no build ids.
RESERVED = ("chunks", "css", "media", "image")


def valid_json(d: Spark, x: str) -> str:
    return f"try_parse_json({x}) IS NOT NULL" if d.name == "spark" else f"json_valid({x})"


def next_data(d: Spark, html: str) -> str:
    """The text of the state script; '' for none."""
    return d.extract(html, r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>')


def build_id(d: Spark, html: str) -> str:
    """Of the state script, an assignment, the manifests' folder, or any folder below the static one; null for none. Pages without any of these marks, nearly
    all, are told by three plain searches."""
    plausible = lambda x: d.let("i", x, f"CASE WHEN {d.rlike('i', '^[A-Za-z0-9_.-]{1,128}$')} THEN i END")
    ids = d.filter(d.extract_all(html, r"/_next/static/([A-Za-z0-9_.-]+)/"), "x", f"x NOT IN ({', '.join(map(d.lit, RESERVED))})")
    own = d.let("b", next_data(d, html), f"CASE WHEN {valid_json(d, 'b')} THEN {d.json_text('b', 'buildId')} END")
    assigned = d.extract(html, r"""__BUILD_ID\s*=\s*["']([A-Za-z0-9_.-]+)["']""")
    manifest = d.extract(html, r"/_next/static/([A-Za-z0-9_.-]+)/_(?:build|ssg)Manifest")
    found = f"coalesce({plausible(own)}, {plausible(assigned)}, {plausible(manifest)}, {plausible(d.at(ids, 1))})"
    return f"CASE WHEN contains({html}, '__NEXT_DATA__') OR contains({html}, '__BUILD_ID') OR contains({html}, '/_next/static/') THEN {found} END"


def app_router(d: Spark, html: str) -> str:
    """D16."""
    return f"(contains({html}, '__next_f') OR ((contains({html}, '__RSC_') OR contains({html}, 'react-server-dom')) AND NOT contains({html}, '__NEXT_DATA__')))"
