"""Text and Markdown functions as SQL text for a dialect."""

from __future__ import annotations

from webloom.functions.dialect import Spark

SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def collapse(d: Spark, x: str) -> str:
    """white space by Unicode's property becomes one space; trimmed."""
    return f"trim({d.replace(x, SPACES + '+', ' ')})"


def solid_length(d: Spark, x: str) -> str:
    """code points that are not white space."""
    return f"CAST(length({d.replace(x, SPACES + '+')}) AS BIGINT)"


def is_thin(d: Spark, x: str, least: int = 200) -> str:
    """E17."""
    return f"({solid_length(d, x)} < {least})"


def drop_base64_images(d: Spark, x: str) -> str:
    """C18."""
    return d.replace(x, r"(?i)(!\[[^\]]*\])\(\s*data:[^)]*\)", "$1(<Base64-Image-Removed>)")


def drop_skip_links(d: Spark, x: str) -> str:
    """C20."""
    return d.replace(x, r"(?i)\[skip to content\]\(#[^)]*\)")


def collapse_blank_lines(d: Spark, x: str) -> str:
    """C21."""
    return d.replace(x, r"\n{3,}", "\n\n")


def is_skeleton(d: Spark, line: str) -> str:
    """A line that says no more than that content is loading."""
    core = d.replace(d.replace(f"trim({line})", r"^[#>\-*+. \t0-9]+"), r"^[*_` \t]+|[*_` \t]+$")
    return f"(lower({d.replace(core, '[.… ]+$')}) IN ('loading', 'please wait', 'loading content'))"


def skeleton_lines(d: Spark, md: str) -> str:
    """I04."""
    return d.size(d.filter(d.split(md, "\n"), "x", is_skeleton(d, "x")))


def strip_skeletons(d: Spark, md: str) -> str:
    """E16."""
    return collapse_blank_lines(d, d.join(d.filter(d.split(md, "\n"), "x", f"NOT {is_skeleton(d, 'x')}"), "\n"))


def strip_tags(d: Spark, x: str) -> str:
    """F16 with the named entities that F17 lists."""
    out = d.replace(x, "<[^>]*>")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("amp", "&")):
        out = f"replace({out}, '&{name};', {d.lit(char)})"
    return collapse(d, out)


def truncate(d: Spark, x: str, most: int = 1024) -> str:
    """F23."""
    return f"CASE WHEN length({x}) > {most} THEN substring({x}, 1, {most}) || '…' ELSE {x} END"


def code_language(d: Spark, cls: str) -> str:
    """C11: the language token to add to a class attribute, null if there is one or none is told."""
    tokens = d.filter(d.split(cls, " "), "t", "t <> ''")
    lang = d.at(d.filter(tokens, "t", d.starts("t", d.lit("lang-"))), 1)
    other = d.at(d.filter(tokens, "t", "t <> 'hljs'"), 1)
    return f"CASE WHEN {d.exists(tokens, 't', d.starts('t', d.lit('language-')))} THEN NULL WHEN {lang} IS NOT NULL THEN 'language-' || substring({lang}, 6) ELSE 'language-' || {other} END"
