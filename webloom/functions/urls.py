"""URL functions as SQL text for a dialect. Arguments are SQL expressions.

The engine resolves references and makes keys by the parser in ``urlparse``; the check has texts of its own, which know
the forms that the tables' links have.
"""

from __future__ import annotations

from webloom.functions import urlparse
from webloom.functions.dialect import Spark

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def scheme(d: Spark, u: str) -> str:
    return ascii_lower(d.extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):"))


def has_scheme(d: Spark, u: str) -> str:
    """a protocol-relative reference has none."""
    return d.rlike(u, r"^[A-Za-z][A-Za-z0-9+.-]*:")


def authority(d: Spark, u: str) -> str:
    return d.extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")


def host(d: Spark, u: str) -> str:
    """Lower-cased host without user and port; '' where there is none."""
    return ascii_lower(d.extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"))


def port(d: Spark, u: str) -> str:
    return d.extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)")


def path(d: Spark, u: str) -> str:
    """path of an absolute URL ('/' for none), or what precedes the query of a relative one."""
    absolute = d.extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")
    return f"CASE WHEN {authority(d, u)} = '' THEN {d.extract(u, r'^([^?]*)')} WHEN {absolute} = '' THEN '/' ELSE {absolute} END"


def query(d: Spark, u: str) -> str:
    return d.extract(u, r"^[^?#]*[?]([^#]*)")


def has_query(d: Spark, u: str) -> str:
    return d.rlike(u, r"^[^#?]*[?]")


def is_http(d: Spark, u: str) -> str:
    """E32."""
    return f"({scheme(d, u)} IN ('http', 'https') AND {host(d, u)} <> '')"


def without_fragment(d: Spark, u: str) -> str:
    """F04."""
    return d.replace(u, r"#.*$")


def is_tracking(d: Spark, name: str) -> str:
    """F06."""
    n = ascii_lower(name)
    return f"({d.starts(n, d.lit('utm_'))} OR {n} IN ('ref', 'fbclid'))"


def without_dots(d: Spark, p: str) -> str:
    """For the check: a path that begins with a slash, its dot segments resolved."""
    step = f"CASE WHEN x = '.' THEN a WHEN x = '..' THEN {d.replace('a', '/[^/]*$')} ELSE a || '/' || x END"
    folded = d.fold(d.split(f"substr({p}, 2)", "/"), "a", "x", step)
    return f"CASE WHEN NOT contains({p}, '/.') THEN {p} WHEN {d.rlike(p, r'/[.][.]?$')} THEN {folded} || '/' ELSE {folded} END"


def _coded(d: Spark, x: str) -> str:
    """For the check: characters that no URL holds, as percent-encoded UTF-8."""
    odd = r"""[^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7a\x7c\x7e]"""
    each = f"CASE WHEN {d.rlike('c', odd)} THEN url_encode(c) ELSE c END"
    return f"CASE WHEN {d.rlike(x, odd)} THEN {d.join(d.transform(d.extract_all(x, '(?s)(.)'), 'c', each), '')} ELSE {x} END"


def canonical_key(d: Spark, u: str) -> str:
    """no scheme, the host as a parser writes it, port unless it is the scheme's own, path without dot segments and
    trailing slashes, parameters in order without trackers and written anew, no fragment. What is no URL is tried with https before it,
    and else lowered and cut at its fragment."""
    if d.name == "spark":
        return urlparse.canonical_key(u, is_tracking(d, "n"))
    raw = f"trim({u})"
    url = f"CASE WHEN {has_scheme(d, raw)} AND contains({raw}, '://') THEN {raw} ELSE 'https://' || {raw} END"
    name, value = d.decoded(d.extract("p", r"^([^=]*)")), d.decoded(d.extract("p", r"^[^=]*=(.*)$"))
    pairs = d.filter(d.split(query(d, "w"), "&"), "p", f"p <> '' AND NOT {is_tracking(d, name)}")
    kept = d.join(d.transform(pairs, "p", f"{d.encoded(name)} || '=' || {d.encoded(value)}"), "&")
    own = f"CASE WHEN {port(d, 'w')} = '' OR ({scheme(d, 'w')} = 'http' AND {port(d, 'w')} = '80') OR ({scheme(d, 'w')} = 'https' AND {port(d, 'w')} = '443') THEN '' ELSE ':' || {port(d, 'w')} END"
    full = f"{host(d, 'w')} || {own} || {d.replace(without_dots(d, path(d, 'w')), '/+$')} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"
    key = f"CASE WHEN {raw} = '' THEN '' WHEN {host(d, 'w')} <> '' AND NOT {d.rlike(host(d, 'w'), r'[\s<>^|%]')} THEN {full} ELSE lower({d.replace(without_fragment(d, raw), '/+$')}) END"
    return d.let("w", url, key)


def resolve(d: Spark, base: str, ref: str) -> str:
    """what a reference names on a page; references that are empty, fragments, have a scheme or name nothing stay as they are."""
    if d.name == "spark":
        return urlparse.resolve(base, ref)
    t = f"trim({ref})"
    return f"CASE WHEN {t} = '' OR {d.starts(t, d.lit('#'))} OR {has_scheme(d, t)} THEN {ref} ELSE {joined(d, base, t)} END"


def resolved(d: Spark, ref: str, named: str) -> str:
    """F01, F03 where it is at hand what the reference is joined to."""
    if d.name == "spark":
        return urlparse.kept_or(ref, named)
    t = f"trim({ref})"
    return f"CASE WHEN {t} = '' OR {d.starts(t, d.lit('#'))} OR {has_scheme(d, t)} THEN {ref} ELSE coalesce({named}, {ref}) END"


def joined(d: Spark, base: str, ref: str) -> str:
    """The URL that a reference names on a page, null where it names none."""
    if d.name == "spark":
        return urlparse.joined(base, ref)
    root = f"{d.extract(base, r'^([A-Za-z][A-Za-z0-9+.-]*)://')} || '://' || {authority(d, base)}"
    folder = d.extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^/?#]*)*/)")
    place, rest = d.extract(ref, r"^([^?#]*)"), d.extract(ref, r"^[^?#]*(.*)$")
    below = f"CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {place}"
    made = (
        f"CASE WHEN {has_scheme(d, ref)} THEN {ref} WHEN {d.starts(ref, d.lit('//'))} THEN {d.extract(base, r'^([A-Za-z][A-Za-z0-9+.-]*):')} || ':' || {ref} "
        f"WHEN {d.starts(ref, d.lit('/'))} THEN {root} || {without_dots(d, place)} || {rest} "
        f"WHEN {d.starts(ref, d.lit('?'))} THEN {d.extract(base, r'^([^?#]*)')} || {ref} "
        f"WHEN {ref} = '' OR {d.starts(ref, d.lit('#'))} THEN {without_fragment(d, base)} || {ref} "
        f"ELSE {root} || {d.let('b', below, without_dots(d, 'b'))} || {rest} END"
    )
    return d.let("j", made, _coded(d, "j"))


def same_site(d: Spark, h: str, site: str) -> str:
    """The host itself or one below it."""
    return f"({h} = {site} OR {d.ends(h, chr(39) + '.' + chr(39) + ' || ' + site)})"


def redact_credentials(d: Spark, x: str) -> str:
    """F19."""
    return d.replace(x, r"(https?|socks5h?)://[^\s/]*@", "$1://***@")


def guid_segment(d: Spark, x: str) -> str:
    """36 characters in the 8-4-4-4-12 pattern between separators."""
    return d.rlike(x, r"""(?i)(?:^|[/?#'"<> ])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?:$|[/?#'"<> ])""")


def versioned(d: Spark, p: str) -> str:
    """E22."""
    return d.rlike(p, r"(?:^|/)v[0-9]+(?:/|$)")
