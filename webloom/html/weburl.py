"""References joined to a page's URL inside the tree operators, by the same standard as ``functions/urlparse.py``."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote_to_bytes

PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
#: Fixed values of the standard: percent-encode sets, and code points that no host has.
FRAGMENT_SET = ' "<>`'
PATH_SET = FRAGMENT_SET + "#?{}"
QUERY_SET = ' "#<>'
USERINFO_SET = PATH_SET + "/:;=@[\\]^|"
FORBIDDEN_HOST = re.compile(r"[\x00-\x20\ufffd#/:<>?@\[\\\]^|\x7f]")
WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {ord("。"): ".", ord("｡"): "."}


def encoded(x: str, kinds: str) -> str:
    return "".join("".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) if c < " " or c > "~" or c in kinds else c for c in x)


def without_dots(path: str) -> str:
    steps, out = path.split("/")[1:], []
    for k, step in enumerate(steps):
        plain = step.lower().replace("%2e", ".")
        if plain == "..":
            del out[-1:]
        elif plain != ".":
            out.append(step)
        if plain in (".", "..") and k == len(steps) - 1:
            out.append("")
    return "/" + "/".join(out)


def _number(x: str) -> int | None:
    if re.fullmatch(r"0[xX][0-9a-fA-F]*", x):
        return int(x[2:] or "0", 16)
    if re.fullmatch(r"0[0-7]*", x):
        return int(x, 8)
    return int(x) if re.fullmatch(r"[1-9][0-9]*", x) else None


def host_of(raw: str, special: bool) -> str | None:
    """The standard's host; None where it is none."""
    if raw[:1] == "[" and raw[-1:] == "]":
        try:
            got = ipaddress.IPv6Address(raw[1:-1].split("%")[0] if "%" not in raw else "")
        except ValueError:
            return None
        # written without the dotted form that the library gives to mapped addresses
        pieces = [f"{int.from_bytes(got.packed[i : i + 2]):x}" for i in range(0, 16, 2)]
        runs = [(n, -i) for i in range(8) for n in range(2, 9 - i) if pieces[i : i + n] == ["0"] * n]
        if runs:
            n, i = max(runs)
            return f"[{':'.join(pieces[:-i])}::{':'.join(pieces[n - i :])}]"
        return f"[{':'.join(pieces)}]"
    if not special:
        return None if FORBIDDEN_HOST.search(raw) else encoded(raw, "")
    host = unquote_to_bytes(raw.encode("utf-8", "replace")).decode("utf-8", "replace").translate(WIDE).lower()
    host = ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in host.split("."))
    if not host or "%" in host or FORBIDDEN_HOST.search(host):
        return None
    parts = host.removesuffix(".").split(".")
    if not re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]):
        return host
    numbers = [_number(p) for p in parts]
    if len(numbers) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1])) + numbers[-1]
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _authority(raw: str, scheme: str) -> str | None:
    login, _, place = raw.rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place, re.S)
    host = host_of(m[1], scheme in PORTS) if m else None
    port = str(int(m[2])) if m and m[2] else ""
    if host is None or (port and int(port) > 65535):
        return None
    name, _, word = login.partition(":")
    user = encoded(name, USERINFO_SET) + (":" + encoded(word, USERINFO_SET) if word else "")
    return (user + "@" if user else "") + host + (f":{port}" if port and PORTS.get(scheme) != port else "")


def parse(raw: str, base: tuple | None = None) -> tuple | None:
    """(scheme, authority, path, query, fragment) of a URL, or of a reference to a parsed base; None where it fails; authority is None for mailto: and the like."""
    s = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    m = SCHEME.match(s)
    scheme, rest = (m[1].lower(), s[m.end() :]) if m else ("", s)
    if m and base and scheme == base[0] and scheme in PORTS and not rest.startswith("//"):
        m = None
    if not m:
        if not base:
            return None
        scheme = base[0]
    special = scheme in PORTS
    head = re.match(r"[^?#]*", rest)[0]
    after, hash_, fragment = rest[len(head) :].partition("#")
    query = after[1:] if after else None
    if special:
        head = head.replace("\\", "/")
    if (m and special) or head.startswith("//"):
        whole = head.lstrip("/") if special else head[2:]
        raw_authority, slash, path = whole.partition("/")
        authority, path = _authority(raw_authority, scheme), slash + path
    elif m:
        return scheme, None, encoded(head, ""), None if query is None else encoded(query, QUERY_SET), encoded(fragment, FRAGMENT_SET) if hash_ else None
    else:
        authority, path = base[1], head if head.startswith("/") else base[2].rpartition("/")[0] + "/" + head if head else base[2]
        query = base[3] if not head and query is None else query
    if authority is None:
        return None
    path = encoded(path, PATH_SET)
    path = without_dots(path or "/") if special or path else path
    mark = QUERY_SET + "'" if special else QUERY_SET
    return scheme, authority, path, None if query is None else encoded(query, mark), encoded(fragment, FRAGMENT_SET) if hash_ else None


def written(parts: tuple | None) -> str | None:
    if parts is None:
        return None
    scheme, authority, path, query, fragment = parts
    return f"{scheme}:{path if authority is None else f'//{authority}{path}'}" + ("" if query is None else f"?{query}") + ("" if fragment is None else f"#{fragment}")


def joined(base: str, ref: str) -> str | None:
    at = parse(base)
    return written(parse(ref, at)) if at else None
