"""Markdown of a tree: ATX headings, fenced code, inlined links, GFM tables, "-" bullets."""

from __future__ import annotations

import re

from webloom.html.tree import BLOCK, Comment, Element, Text

SKIP = frozenset("script style noscript iframe template head title".split())
MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_", "del": "~~", "s": "~~", "strike": "~~"}


def _inline(nodes, pre: bool = False) -> str:
    out = []
    for c in nodes:
        if isinstance(c, Comment):
            continue
        if isinstance(c, Text):
            out.append(str(c) if pre else re.sub(r"\s+", " ", str(c)))
        elif c.tag in SKIP:
            continue
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})" if c.attrs.get("src") else "")
        elif c.tag == "code":
            body = "".join(c.texts())
            out.append(f"`{body}`" if body.strip() else "")
        else:
            body = _inline(c.children, pre)
            solid = body.strip()
            if c.tag == "a" and c.attrs.get("href"):
                out.append(f"[{solid}]({c.attrs['href']})" if solid else "")
            elif c.tag in MARKS and solid:
                lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
                out.append(f"{lead}{MARKS[c.tag]}{solid}{MARKS[c.tag]}{tail}")
            elif c.tag in MARKS:
                out.append(body)
            else:
                out.append(body)
    return "".join(out)


def _list(e: Element, depth: int) -> str:
    lines, n = [], int(e.attrs.get("start", "1") or 1) if e.attrs.get("start", "1").isdigit() else 1
    for c in e.children:
        if not isinstance(c, Element):
            continue
        mark = f"{n}. " if e.tag == "ol" else "- "
        n += 1
        body = _blocks(c.children, depth + 1).strip("\n")
        pad = " " * len(mark)
        lines.append(mark + body.replace("\n", "\n" + pad).replace("\n" + pad + "\n", "\n\n") if body else mark.rstrip())
    return "\n".join(lines)


def _table(e: Element) -> str:
    rows = []
    for r in (x for x in e.walk() if x.tag == "tr"):
        cells = [c for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")]
        if cells:
            rows.append([re.sub(r"\s+", " ", _blocks(c.children, 0)).strip().replace("|", "\\|") for c in cells])
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _fence(e: Element) -> str:
    code = e.first("code")
    classes = (code.classes() if code is not None else []) + e.classes()
    lang = next((c[9:] for c in classes if c.startswith("language-")), "")
    body = "".join((code or e).texts()).strip("\n")
    ticks = "`" * max(3, max((len(m) for m in re.findall(r"`+", body)), default=0) + 1)
    return f"{ticks}{lang}\n{body}\n{ticks}"


def _blocks(nodes, depth: int) -> str:
    out, run = [], []

    def flush():
        text = _inline(run)
        text = "\n".join(x.strip() + ("  " if x.endswith("  ") and k < n else "") for n in [text.count("\n")] for k, x in enumerate(text.split("\n"))).strip()
        run.clear()
        if text:
            out.append(text)

    for c in nodes:
        if not isinstance(c, Element) or c.tag not in BLOCK and not any(x.tag in BLOCK for x in c.walk()):
            run.append(c)
            continue
        flush()
        if c.tag in SKIP:
            continue
        if c.tag[0] == "h" and c.tag[1:].isdigit():
            text = re.sub(r"\s+", " ", _inline(c.children)).strip()
            out.append("#" * int(c.tag[1:]) + " " + text if text else "")
        elif c.tag in ("ul", "ol"):
            out.append(_list(c, depth))
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag == "pre":
            out.append(_fence(c))
        elif c.tag == "hr":
            out.append("* * *")
        elif c.tag == "blockquote":
            out.append("\n".join("> " + x if x else ">" for x in _blocks(c.children, depth).strip().split("\n")))
        else:
            out.append(_blocks(c.children, depth))
    flush()
    return ("\n" if depth and len(out) > 1 and all("\n\n" not in x for x in out) else "\n\n").join(x for x in out if x)


def render(root: Element) -> str:
    return _blocks(root.children, 0)
