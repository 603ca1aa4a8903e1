"""HTML as a stream of tokens in native expressions: Spark SQL text, no tree and no Python.

One pattern cuts a page into comments, declarations, raw elements (scripts, titles and the like, with what they hold), tags and text. It knows quoted
attribute values, so a > in one ends no tag, and what stands in comments and raw elements is no tag. Its repetitions are possessive or lazy over
single characters, so it runs in linear time and never backtracks into what it has passed. Attributes are cut by a second
pattern out of the tags that are asked for alone; the first of a name counts, and references in values are decoded.

Not followed: where a tag ends up in a browser's tree, which no operator here depends on, and named references beyond the 252 of HTML 4.
"""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from webloom.functions.dialect import SPARK as S
from webloom.functions.urlparse import let, struct

VALUE = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s"'>][^\s>]*+)"""
ATTRIBUTES = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{VALUE}?+)?+)*+"
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
TOKEN = (
    rf"(?s)<!--(?:-?>|.*?(?:--!?>|\z))|(?i:<({RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z))"
    rf"|</?[A-Za-z][^\s/>]*+{ATTRIBUTES}(?:>|\z)|<[!?/][^>]*+(?:>|\z)|[^<]++|<"
)
ATTRIBUTE = rf"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({VALUE})?+)?+"""
OPEN = rf"(?s)^<([A-Za-z][^\s/>]*+)({ATTRIBUTES})>"
REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+[;=]?)|[^&]++|&"
#: Names of HTML 4 with their semicolon, and those that also stand without one.
NAMES = {f"{n};": html5[f"{n};"] for n in sorted(name2codepoint)} | {n: html5[n] for n in sorted(name2codepoint) if n in html5}
#: What the numbers 128 to 159 stand for: Windows-1252, where it has a character.
ODD = "".join(bytes([b]).decode("cp1252", "replace") for b in range(128, 160))


def decoded(x: str) -> str:
    """Character references: all numeric ones, and the names of HTML 4; a name without its semicolon counts unless a letter, a digit or = follows."""
    number = "CASE WHEN lower(r) LIKE '&#x%' THEN conv(regexp_extract(r, '^&#[xX]0*([0-9a-fA-F]{0,7})', 1), 16, 10) ELSE regexp_extract(r, '^&#0*([0-9]{0,9})', 1) END"
    other = S.lit("�")
    char = f"CASE WHEN c BETWEEN 128 AND 159 THEN substr({S.lit(ODD)}, CAST(c AS INT) - 127, 1) WHEN c IS NULL OR c = 0 OR c BETWEEN 55296 AND 57343 OR c > 1114111 THEN {other} ELSE decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') END"
    named = f"coalesce(try_element_at(from_json({S.lit(json.dumps(NAMES, ensure_ascii=True))}, 'map<string,string>'), substr(r, 2)), r)"
    each = f"CASE WHEN r LIKE '&#%' AND length(r) > 2 THEN {let('c', f'try_cast({number} AS BIGINT)', char)} WHEN r LIKE '&_%' THEN {named} ELSE r END"
    return f"CASE WHEN contains({x}, '&') THEN array_join(transform(regexp_extract_all({x}, {S.lit(REFERENCE)}, 0), r -> {each}), '') ELSE {x} END"


def tags(html: str, names: str) -> str:
    """The opening tags of some names (a|b|...) in order: structs of tag, n (attribute names, lower-cased), v (their values, decoded; '' for none) and
    text (what a raw element holds, as it stands)."""
    bare = "CASE WHEN x LIKE '\"%' OR x LIKE '\\'%' THEN regexp_replace(substr(x, 2), '[\"\\']\\\\z', '') ELSE x END"
    cut = struct(
        tag=f"lower(regexp_extract(t, {S.lit(OPEN)}, 1))",
        n=f"transform(regexp_extract_all(a, {S.lit(ATTRIBUTE)}, 1), x -> lower(x))",
        v=f"transform(transform(regexp_extract_all(a, {S.lit(ATTRIBUTE)}, 2), x -> {bare}), y -> {decoded('y')})",
        text=f"regexp_replace(regexp_replace(t, {S.lit(OPEN)}, ''), {S.lit(rf'(?i)</(?:{RAW})(?=[\s/>])[^>]*>?\z')}, '')",
    )
    wanted = f"filter(regexp_extract_all(coalesce({html}, ''), {S.lit(TOKEN)}, 0), t -> {S.rlike('t', rf'^<(?i:{names})[\s/>]')} AND {S.rlike('t', OPEN)})"
    return f"transform({wanted}, t -> {let('a', f'regexp_extract(t, {S.lit(OPEN)}, 2)', cut)})"


def attribute(tag: str, name: str) -> str:
    """The value of a tag's first attribute of a name; null for none."""
    return f"CASE WHEN array_contains({tag}.n, '{name}') THEN element_at({tag}.v, CAST(array_position({tag}.n, '{name}') AS INT)) END"
