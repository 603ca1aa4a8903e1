"""A URL parser in native expressions, by the WHATWG URL standard: Spark SQL text that Catalyst plans, no Python.

The parser's states follow one another as named values: what precedes the authority, the authority, the host, the path, query and
fragment. Each is bound once (``let``) and read by the next. Plain URLs, which are nearly all, are
recognised by one pattern and cut by others; only the rest goes through the states. Failure is null, as
are the parts that a URL does not have.

Hosts are percent-decoded, lower-cased, mapped from full-width forms and written in Bootstring where they are not ASCII; IPv4 and IPv6
addresses in any of their forms are written in the standard one. Not done, as Spark has no function for it: normalisation of
composed characters (NFC) and the mapping table of IDNA beyond case and width.
"""

from __future__ import annotations

from webloom.functions.dialect import SPARK as S

SPECIAL = "('http', 'https', 'ws', 'wss', 'ftp')"
#: Fixed values of the standard: percent-encode sets as character classes, and code points that no host has.
CONTROL = r"\x00-\x1f\x7f-\x{10FFFF}"
FRAGMENT_SET = CONTROL + r' "<>`'
PATH_SET = FRAGMENT_SET + r"#?{}"
QUERY_SET = CONTROL + r' "#<>'
SPECIAL_QUERY_SET = QUERY_SET + "'"
USERINFO_SET = PATH_SET + r"/:;=@\[\\\]^|"
FORBIDDEN_HOST = r"[\x00-\x20\x{FFFD}#/:<>?@\[\\\]^|%\x7f]"

DOTS = r"/(?:[.]|%2[eE]){1,2}(?:/|\z)"
PLAIN_PATH = r"(?:/(?!(?:[.]|%2[eE]){1,2}(?:[/?#]|\z))[A-Za-z0-9._~!$&()*+,;=:@%-]*)"
PLAIN_TAIL = r"(?:[?][A-Za-z0-9._~!$&()*+,;=:@%/?-]*)?(?:#[A-Za-z0-9._~!$&()*+,;=:@%/?-]*)?\z"
#: A URL that only differs from how the standard writes it in the case of its scheme and host, and in an empty path.
PLAIN = r"^(?i:https?)://(?:[A-Za-z0-9-]+[.])+[A-Za-z][A-Za-z0-9-]*" + PLAIN_PATH + "*" + PLAIN_TAIL
PLAIN_ROOTED = "^" + PLAIN_PATH.replace("(?!", "(?!/|", 1) + PLAIN_PATH + "*" + PLAIN_TAIL
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def encoded(x: str, kinds: str) -> str:
    """Characters of a class as percent-encoded UTF-8."""
    each = f"CASE WHEN c RLIKE {S.lit(f'^(?:[{kinds}])\\z')} THEN regexp_replace(hex(c), '(..)', '%$1') ELSE c END"
    return f"CASE WHEN {S.rlike(x, f'[{kinds}]')} THEN array_join(transform(split({x}, ''), c -> {each}), '') ELSE {x} END"


def percent_decoded(x: str) -> str:
    """Percent-decoded text; a % that begins no code stays."""
    kept = f"replace(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25'), '+', '%2B')"
    return f"CASE WHEN contains({x}, '%') THEN try_url_decode({kept}) ELSE {x} END"


def form_decoded(x: str) -> str:
    """A form's name or value: + is a space."""
    return f"CASE WHEN {S.rlike(x, '[%+]')} THEN try_url_decode(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25')) ELSE {x} END"


def without_dots(p: str) -> str:
    """A path's dot segments, percent-encoded ones too, resolved."""
    step = f"CASE WHEN {S.rlike('x', r'^(?:[.]|%2[eE])\z')} THEN a WHEN {S.rlike('x', r'^(?:[.]|%2[eE]){2}\z')} THEN regexp_replace(a, '/[^/]*\\\\z', '') ELSE concat(a, '/', x) END"
    ends = S.rlike(p, r"/(?:[.]|%2[eE]){1,2}\z")
    return f"CASE WHEN {S.rlike(p, DOTS)} THEN concat(aggregate(split(substr({p}, 2), '/', -1), CAST('' AS STRING), (a, x) -> {step}), CASE WHEN {ends} THEN '/' ELSE '' END) ELSE {p} END"


def bootstring(label: str) -> str:
    """A lower-cased label that is not ASCII, as xn-- and Bootstring (RFC 3492). The characters beyond ASCII are inserted by code point, then
    place: what a decoder counts between two insertions follows from both, so no pass over the code space is needed."""
    t = "CASE WHEN w.k <= z.bias THEN 1L WHEN w.k >= z.bias + 26 THEN 26L ELSE w.k - z.bias END"
    digit = lambda v: f"substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST({v} AS INT) + 1, 1)"
    emit = let(
        "t",
        t,
        f"CASE WHEN w.done THEN w WHEN w.q < t THEN {struct(q='w.q', o='concat(w.o, ' + digit('w.q') + ')', k='w.k', done='true')} "
        f"ELSE {struct(q='(w.q - t) div (36 - t)', o='concat(w.o, ' + digit('t + (w.q - t) % (36 - t)') + ')', k='w.k + 36', done='false')} END",
    )
    digits = f"aggregate(sequence(1, 14), {struct(q='v', o='CAST(z.o AS STRING)', k='36L', done='false')}, (w, i) -> {emit}).o"
    first = "CASE WHEN z.h = y.b THEN v div 700 ELSE v div 2 END"
    shrink = f"aggregate(sequence(1, 8), {struct(d='g + g div (z.h + 1)', k='0L')}, (w, i) -> CASE WHEN w.d > 455 THEN {struct(d='w.d div 35', k='w.k + 36')} ELSE w END, w -> w.k + 36 * w.d div (w.d + 38))"
    after = struct(o=digits, n="e.c", i="e.at + 1", h="z.h + 1", bias=let("g", first, shrink))
    step = let("v", "(e.c - z.n) * (z.h + 1) + e.at - z.i", after)
    events = "array_sort(filter(transform(y.c, (x, i) -> named_struct('c', x, 'i', i, 'at', CAST(size(filter(y.c, (u, j) -> j < i AND u <= x)) AS BIGINT))), e -> e.c >= 128))"
    start = struct(o="CASE WHEN y.b > 0 THEN concat(y.a, '-') ELSE '' END", n="128L", i="0L", h="y.b", bias="72L")
    out = f"concat('xn--', aggregate({events}, {start}, (z, e) -> {step}).o)"
    chars = struct(c=f"transform(split({label}, ''), x -> CAST(ascii(x) AS BIGINT))", a=f"regexp_replace({label}, '[^\\\\x00-\\\\x7f]', '')", b=f"CAST(length(regexp_replace({label}, '[^\\\\x00-\\\\x7f]', '')) AS BIGINT)")
    return let("y", chars, out)


def ipv4(h: str) -> str:
    """The address of a host that ends in a number, in any of its forms; null where it is none."""
    number = r"^(?:0[xX][0-9a-fA-F]*|0[0-7]*|[1-9][0-9]*)\z"
    value = "CAST(CASE WHEN lower(x) LIKE '0x%' THEN conv(concat('0', substr(x, 3)), 16, 10) WHEN x LIKE '0%' THEN conv(x, 8, 10) ELSE x END AS DECIMAL(38, 0))"
    parts = f"split(regexp_replace({h}, '[.]\\\\z', ''), '[.]', -1)"
    fits = "forall(transform(n, (x, i) -> CASE WHEN i < size(n) - 1 THEN x < 256 ELSE x < power(256, 5 - size(n)) END), x -> x)"
    total = "CAST(aggregate(transform(n, (x, i) -> CASE WHEN i < size(n) - 1 THEN CAST(x AS DOUBLE) * power(256, 3 - i) ELSE CAST(x AS DOUBLE) END), 0D, (a, x) -> a + x) AS BIGINT)"
    dotted = let("v", total, "array_join(transform(array(24, 16, 8, 0), s -> CAST(shiftright(v, s) & 255 AS STRING)), '.')")
    numbers = let("n", f"transform(p, x -> {value})", f"CASE WHEN {fits} THEN {dotted} END")
    return let("p", parts, f"CASE WHEN size(p) <= 4 AND forall(p, x -> {S.rlike('x', number)} AND length(x) < 30) THEN {numbers} END")


def ipv6(inner: str) -> str:
    """The address between brackets in its shortest form, with brackets; null where it is none."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    tail = rf"(?:{octet}[.]){{3}}{octet}\z"
    two = "concat(lower(hex(CAST(q[0] AS INT) * 256 + CAST(q[1] AS INT))), ':', lower(hex(CAST(q[2] AS INT) * 256 + CAST(q[3] AS INT))))"
    dotted = S.lit(f"({tail})")
    last = let("q", f"split(regexp_extract(a, {dotted}, 1), '[.]')", two)
    flat = let("a", f"lower({inner})", f"CASE WHEN contains(a, '.') THEN CASE WHEN {S.rlike('a', ':' + tail)} THEN concat(regexp_replace(a, {S.lit(tail)}, ''), {last}) END ELSE a END")
    half = lambda i: f"filter(split(split(a, '::', -1)[{i}], ':', -1), x -> x <> '')"
    pieces = f"CASE WHEN contains(a, '::') THEN concat({half(0)}, array_repeat('0', 8 - size({half(0)}) - size({half(1)})), {half(1)}) ELSE split(a, ':', -1) END"
    shape = S.rlike("a", r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)\z")
    written = f"concat(':', array_join(transform({pieces}, x -> regexp_replace(x, '^0+(?=.)', '')), ':'), ':')"
    # the first of the longest runs of zeros is left out
    at = lambda n: f"instr(a, concat(':', repeat('0:', {n})))"
    run = f"CASE {' '.join(f'WHEN {at(n)} > 0 THEN {n}' for n in range(8, 1, -1))} ELSE 0 END"
    cut = let("n", run, f"CASE WHEN n = 0 THEN trim(BOTH ':' FROM a) ELSE concat(trim(BOTH ':' FROM substr(a, 1, {at('n')})), '::', trim(BOTH ':' FROM substr(a, {at('n')} + 2 * n))) END")
    checked = f"CASE WHEN {shape} AND (NOT contains(a, '::') OR size({half(0)}) + size({half(1)}) <= 7) THEN concat('[', {let('a', written, cut)}, ']') END"
    return let("a", flat, checked)


def host(raw: str, special: str) -> str:
    """The standard's host of an authority's host text; null where it is none."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "。｡"
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + ".."
    plain = f"lower(translate({percent_decoded(raw)}, {S.lit(wide)}, {S.lit(narrow)}))"
    ascii_form = f"CASE WHEN {S.rlike('h', '[^\\x00-\\x7f]')} THEN array_join(transform(split(h, '[.]', -1), l -> CASE WHEN {S.rlike('l', '[^\\x00-\\x7f]')} THEN {bootstring('l')} ELSE l END), '.') ELSE h END"
    numeric = S.rlike("h", r"(?:^|[.])(?:[0-9]+|0[xX][0-9a-fA-F]*)[.]?\z")
    named = let("h", let("h", plain, ascii_form), f"CASE WHEN h IS NULL OR h = '' OR {S.rlike('h', FORBIDDEN_HOST)} THEN CAST(NULL AS STRING) WHEN {numeric} THEN {ipv4('h')} ELSE h END")
    opaque = f"CASE WHEN {S.rlike(raw, FORBIDDEN_HOST.replace('%', ''))} THEN CAST(NULL AS STRING) ELSE {encoded(raw, CONTROL)} END"
    return f"CASE WHEN {raw} LIKE '[%]' THEN {ipv6(f'substr({raw}, 2, length({raw}) - 2)')} WHEN {special} THEN {named} ELSE {opaque} END"


def _cut(u: str) -> str:
    """A plain URL's parts."""
    host = f"lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1))"
    return struct(
        scheme=f"lower(regexp_extract({u}, '^([A-Za-z]+):', 1))",
        auth=host,
        host=host,
        port="''",
        path=f"CASE WHEN {S.rlike(u, '^[A-Za-z]+://[^/?#]*/')} THEN regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) ELSE '/' END",
        query=f"CASE WHEN {S.rlike(u, '^[^?#]*[?]')} THEN regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1) END",
        fragment=f"CASE WHEN contains({u}, '#') THEN regexp_extract({u}, '#((?s:.*))', 1) END",
    )


def _states(raw: str, base: str | None) -> str:
    """The parts of any URL, or of a reference with a base's parts; null where it fails."""
    same = f"{base}.scheme" if base else "CAST(NULL AS STRING)"
    clean = f"regexp_replace(regexp_replace({raw}, {S.lit(r'^[\x00-\x20]+|[\x00-\x20]+\z')}, ''), {S.lit(r'[\t\n\r]')}, '')"
    relative = f"coalesce(c = {same} AND c IN {SPECIAL} AND NOT {S.rlike('substr(s, length(c) + 2)', '^//')}, false)" if base else "false"
    # scheme: what is read on, and whether by itself
    opened = let("s", clean, let("c", f"lower(regexp_extract(s, {S.lit(SCHEME)}, 1))", struct(r="CASE WHEN c = '' THEN s ELSE substr(s, length(c) + 2) END", e=f"CASE WHEN c = '' THEN {same} ELSE c END", absolute=f"c <> '' AND NOT {relative}")))
    split = struct(
        e="o.e",
        sp=f"o.e IN {SPECIAL}",
        absolute="o.absolute",
        head=f"CASE WHEN o.e IN {SPECIAL} THEN translate(regexp_extract(o.r, '^[^?#]*', 0), {S.lit(chr(92))}, '/') ELSE regexp_extract(o.r, '^[^?#]*', 0) END",
        query=f"CASE WHEN {S.rlike('o.r', '^[^?#]*[?]')} THEN regexp_extract(o.r, '^[^?#]*[?]([^#]*)', 1) END",
        fragment="CASE WHEN contains(o.r, '#') THEN regexp_extract(o.r, '#((?s:.*))', 1) END",
    )
    own = "((o.absolute AND o.sp) OR o.head LIKE '//%')"
    slashes = "CASE WHEN o.sp THEN regexp_replace(o.head, '^/+', '') ELSE substr(o.head, 3) END"
    b = (lambda f: f"{base}.{f}") if base else (lambda f: "CAST(NULL AS STRING)")
    placed = struct(
        e="o.e",
        sp="o.sp",
        opaque="o.absolute AND NOT o.sp AND NOT o.head LIKE '//%'",
        authority=f"CASE WHEN {own} THEN regexp_extract({slashes}, '^[^/]*', 0) END",
        path=f"CASE WHEN {own} THEN regexp_extract({slashes}, '^[^/]*((?s:.*))', 1) WHEN o.absolute OR o.head LIKE '/%' THEN o.head WHEN o.head = '' THEN {b('path')} ELSE concat(regexp_extract({b('path')}, '^((?s:.*)/)', 1), o.head) END",
        query=f"CASE WHEN o.head = '' AND NOT o.absolute THEN coalesce(o.query, {b('query')}) ELSE o.query END",
        fragment="o.fragment",
    )
    port_text = r"^(?:\[[^\]]*\]|[^:]*):0*([0-9]*)\z"
    default = "CASE WHEN g.n = '' THEN '' WHEN o.e IN ('http', 'ws') AND g.n = '80' OR o.e IN ('https', 'wss') AND g.n = '443' OR o.e = 'ftp' AND g.n = '21' THEN '' ELSE concat(':', g.n) END"
    user = f"regexp_extract(o.authority, '^((?s:.*))@', 1)"
    name, word = encoded("regexp_extract(u, '^[^:]*', 0)", USERINFO_SET), encoded("regexp_extract(u, '^[^:]*:((?s:.*))', 1)", USERINFO_SET)
    login = let("u", user, f"CASE WHEN u = '' OR u = ':' THEN '' ELSE concat({name}, CASE WHEN {S.rlike('u', '^[^:]*:.')} THEN concat(':', {word}) ELSE '' END, '@') END")
    place = "regexp_replace(o.authority, '^(?s:.*)@', '')"
    zero = f"CASE WHEN {S.rlike(place, r':0+\z')} THEN '0' ELSE regexp_extract({place}, {S.lit(port_text)}, 1) END"
    found = struct(h=host(r"regexp_extract(q, '^(\\[[^\\]]*\\]|[^:]*)', 1)", "o.sp"), n=zero.replace(place, "q"), ok=f"{S.rlike('q', r'^(?:\[[^\]]*\]|[^:]*)(?::[0-9]*)?\z')} AND length(regexp_extract(q, {S.lit(port_text)}, 1)) <= 5 AND coalesce(try_cast(regexp_extract(q, {S.lit(port_text)}, 1) AS INT), 0) <= 65535")
    authority = let("q", place, let("g", found, f"CASE WHEN g.ok AND g.h IS NOT NULL THEN {struct(auth=f'concat({login}, g.h, {default})', host='g.h', port=f'substr({default}, 2)')} END"))
    inherited = struct(auth=b("auth"), host=b("host"), port=b("port"))
    path = let("p", "CASE WHEN o.sp AND o.path = '' THEN '/' ELSE o.path END", let("p", encoded("p", PATH_SET), without_dots("p")))
    query = f"CASE WHEN o.sp THEN {encoded('o.query', SPECIAL_QUERY_SET)} ELSE {encoded('o.query', QUERY_SET)} END"
    done = struct(scheme="o.e", auth="a.auth", host="a.host", port="a.port", path=path, query=query, fragment=encoded("o.fragment", FRAGMENT_SET))
    none = struct(scheme="o.e", auth="CAST(NULL AS STRING)", host="CAST(NULL AS STRING)", port="CAST(NULL AS STRING)", path=encoded("o.path", CONTROL), query=encoded("o.query", QUERY_SET), fragment=encoded("o.fragment", FRAGMENT_SET))
    full = f"CASE WHEN o.e IS NULL THEN NULL WHEN o.opaque THEN {none} ELSE {let('a', f'CASE WHEN o.authority IS NULL THEN {inherited} ELSE {authority} END', f'CASE WHEN a.auth IS NOT NULL THEN {done} END')} END"
    return let("o", opened, let("o", split, let("o", placed, full)))


def parsed(raw: str, base: str | None = None) -> str:
    """The parts (scheme, auth, host, port, path, query, fragment) of a URL, or of a reference with the name of a base's parts, which may be null."""
    rooted = ""
    if base:
        cut = struct(
            scheme=f"{base}.scheme", auth=f"{base}.auth", host=f"{base}.host", port=f"{base}.port", path=f"regexp_extract({raw}, '^[^?#]*', 0)",
            query=f"CASE WHEN {S.rlike(raw, '^[^?#]*[?]')} THEN regexp_extract({raw}, '^[^?#]*[?]([^#]*)', 1) END",
            fragment=f"CASE WHEN contains({raw}, '#') THEN regexp_extract({raw}, '#((?s:.*))', 1) END",
        )
        rooted = f"WHEN {base}.auth IS NOT NULL AND {S.rlike(raw, PLAIN_ROOTED)} THEN {cut} "
    return f"CASE WHEN {S.rlike(raw, PLAIN)} THEN {_cut(raw)} {rooted}ELSE {_states(raw, base)} END"


PARTS = "struct<scheme: string, auth: string, host: string, port: string, path: string, query: string, fragment: string>"


def written(p: str) -> str:
    """A URL of its parts; null for those that failed."""
    return f"concat({p}.scheme, CASE WHEN {p}.auth IS NULL THEN ':' ELSE concat('://', {p}.auth) END, {p}.path, coalesce(concat('?', {p}.query), ''), coalesce(concat('#', {p}.fragment), ''))"


def joined(base: str, ref: str) -> str:
    """The URL that a reference names on a page; null where base or reference is none. The parser is written
    once: folded over the base, then the reference with the base's parts."""
    start = struct(n="0", p=f"CAST(NULL AS {PARTS})")
    step = f"CASE WHEN f.n = 1 AND f.p IS NULL THEN f ELSE {struct(n='f.n + 1', p=parsed('t', 'f.p'))} END"
    return f"aggregate(array({base}, {ref}), {start}, (f, t) -> {step}, f -> {let('up', 'CASE WHEN f.n = 2 THEN f.p END', written('up'))})"


def normal(url: str) -> str:
    """A URL as the standard writes it; null where it is none."""
    return let("up", parsed(url), written("up"))


def kept_or(ref: str, named: str) -> str:
    t = f"regexp_replace({ref}, {S.lit(r'^\s+|\s+\z')}, '')"
    return f"CASE WHEN {t} = '' OR {t} LIKE '#%' OR {S.rlike(t, SCHEME)} THEN {ref} ELSE coalesce({named}, {ref}) END"


def resolve(base: str, ref: str) -> str:
    """references that are empty, fragments or have a scheme stay as they are, as do those that cannot be joined."""
    return kept_or(ref, joined(base, f"regexp_replace({ref}, {S.lit(r'^\s+|\s+\z')}, '')"))


def canonical_key(url: str, is_tracking: str) -> str:
    """Host, port unless it is the scheme's own, path without closing slashes, parameters but trackers written anew. What is no URL is
    tried with https before it, then cut at its fragment and lowered. is_tracking: SQL of a parameter's name ``n``."""
    pairs = "filter(transform(filter(split(k.query, '&', -1), x -> x <> ''), x -> named_struct('n', {n}, 'v', {v})), x -> NOT {t})".format(
        n=form_decoded("regexp_extract(x, '^[^=]*', 0)"), v=form_decoded("regexp_extract(x, '^[^=]*=((?s:.*))', 1)"), t=let("n", "x.n", is_tracking)
    )
    kept = f"CASE WHEN k.query IS NULL OR k.query = '' THEN '' ELSE array_join(transform({pairs}, x -> concat(url_encode(x.n), '=', url_encode(x.v))), '&') END"
    full = let("m", kept, "concat(lower(k.host), CASE WHEN k.port = '' THEN '' ELSE concat(':', k.port) END, rtrim('/', k.path), CASE WHEN m = '' THEN '' ELSE concat('?', m) END)")
    fallback = "lower(regexp_replace(regexp_replace(r, '#(?s:.*)', ''), '/+\\\\z', ''))"
    parts = f"aggregate(array(r, concat('https://', r)), CAST(NULL AS {PARTS}), (f, t) -> CASE WHEN f IS NOT NULL THEN f ELSE {parsed('t')} END)"
    return let("r", f"regexp_replace({url}, {S.lit(r'^\s+|\s+\z')}, '')", f"CASE WHEN r = '' THEN '' ELSE {let('k', parts, f'CASE WHEN k.host IS NULL THEN {fallback} ELSE {full} END')} END")
