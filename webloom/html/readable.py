"""The main content of a page by scores that are carried up its tree.

Text blocks give points to up to five ancestors, with decay; points are lowered by the share of link text; the best of the candidates, or an ancestor that several
good ones share, is the main node, and siblings that are like it or read like prose are joined to it. What is then
left of furniture inside is cleaned by its own weights. If little text comes out, the page is read again with one rule less each time: unlikely
names, class weights, cleaning. Of attempts that all stay short the longest counts.
"""

from __future__ import annotations

import re

from webloom.html.tree import BLOCK, Comment, Element, Text

# Names, scores and limits that decide which node is the main one and are kept as they must be.
UNLIKELY = re.compile(
    r"-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote", re.I
)
MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.I)
GOOD_NAMES = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
BAD_NAMES = re.compile(
    r"-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I
)
UNLIKELY_ROLES = frozenset("menu menubar complementary navigation alert alertdialog dialog".split())
SCORED = frozenset("section h2 h3 h4 h5 h6 p td pre".split())
TAG_SCORES = {"div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
NEVER = frozenset("script style noscript template link meta head title".split())
DROPPED = frozenset("object embed footer link aside h1 iframe input textarea select button".split())
CLEANED = frozenset("form fieldset table ul div".split())
BLOCK_CHARS, ENOUGH_CHARS, CANDIDATES, LEVELS, CLASS_POINTS = 25, 500, 5, 5, 25
STRIP, WEIGH, CLEAN = 1, 2, 4


def names(e: Element) -> str:
    return f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}"


def class_weight(e: Element, flags: int) -> int:
    if not flags & WEIGH:
        return 0
    marks = [e.attrs[a] for a in ("class", "id") if e.attrs.get(a)]
    return sum(CLASS_POINTS * (bool(GOOD_NAMES.search(m)) - bool(BAD_NAMES.search(m))) for m in marks)


def link_share(e: Element) -> float:
    """Link text in proportion to all text; links within the page count for less."""
    total = len(e.text())
    return sum(len(a.text()) * (0.3 if a.attrs.get("href", "").startswith("#") else 1) for a in e.walk() if a.tag == "a") / total if total else 0.0


def inside(e: Element, tags: frozenset) -> bool:
    return any(a.tag in tags for a in e.ancestors())


def copy(e: Element, parent: Element | None = None) -> Element:
    """The elements and texts below e, without what is never content."""
    root = Element(e.tag, dict(e.attrs), parent)
    stack = [(e, root)]
    while stack:
        old, new = stack.pop()
        for c in old.children:
            if isinstance(c, Element):
                if c.tag not in NEVER:
                    made = Element(c.tag, dict(c.attrs), new)
                    new.children.append(made)
                    stack.append((c, made))
            elif not isinstance(c, Comment):
                new.children.append(c)
    return root


def strip_unlikely(body: Element) -> None:
    for e in list(body.walk()):
        hidden = "hidden" in e.attrs or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", e.attrs.get("style", "")) or e.attrs.get("aria-hidden") == "true"
        name = names(e)
        odd = UNLIKELY.search(name) and not MAYBE.search(name) and e.tag not in ("a", "body") and not inside(e, frozenset(("table", "code")))
        if hidden or odd or e.attrs.get("role") in UNLIKELY_ROLES:
            e.detach()


def blocks(body: Element) -> list[Element]:
    """What is scored: text blocks, and divisions that hold no block."""
    return [e for e in body.walk() if e.tag in SCORED or (e.tag == "div" and not any(c.tag in BLOCK or c.tag == "table" for c in e.walk()))]


def scores(body: Element, flags: int) -> dict[int, tuple[Element, float]]:
    found: dict[int, list] = {}
    for e in blocks(body):
        text = e.text()
        if e.parent is None or len(text) < BLOCK_CHARS:
            continue
        points = 2 + len(re.findall("[,،﹐︐︑⹁⸴⸲，]", text)) + min(len(text) // 100, 3)
        for level, a in zip(range(LEVELS), e.ancestors(), strict=False):
            if a.tag in ("#document", "html"):
                break
            if id(a) not in found:
                found[id(a)] = [a, TAG_SCORES.get(a.tag, 0) + class_weight(a, flags)]
            found[id(a)][1] += points / (1 if level == 0 else 2 if level == 1 else level * 3)
    return {k: (a, s * (1 - link_share(a))) for k, (a, s) in found.items()}


def main_node(body: Element, flags: int) -> tuple[Element, dict]:
    """The main node and all scores; the body where nothing scores."""
    scored = scores(body, flags)
    best = sorted(scored.values(), key=lambda x: -x[1])[:CANDIDATES]
    if not best or best[0][0].tag == "body":
        return body, scored
    top, most = best[0]
    # an ancestor that at least three more candidates nearly as good have in common
    others = [set(map(id, a.ancestors())) for a, s in best[1:] if most > 0 and s / most >= 0.75]
    if len(others) >= 3:
        for a in top.ancestors():
            if a.tag in ("body", "html", "#document"):
                break
            if sum(id(a) in o for o in others) >= 3:
                top = a
                break
    # parents that score more hold further content; those that score far less do not
    last, least = scored.get(id(top), (top, most))[1], scored.get(id(top), (top, most))[1] / 3
    for a in list(top.ancestors()):
        if a.tag in ("body", "html", "#document"):
            break
        if id(a) not in scored:
            continue
        score = scored[id(a)][1]
        if score < least:
            break
        if score > last:
            top = a
            break
        last = score
    while top.parent is not None and top.parent.tag not in ("body", "html", "#document") and sum(isinstance(c, Element) for c in top.parent.children) == 1:
        top = top.parent
    return top, scored


def joined(top: Element, scored: dict) -> Element:
    """The main node with the siblings that belong to it."""
    most = scored[id(top)][1] if id(top) in scored else 0
    enough = max(10, most * 0.2)
    out = Element("div")
    for c in list(top.parent.children) if top.parent is not None and top.tag != "body" else [top]:
        if not isinstance(c, Element):
            continue
        keep = c is top
        if not keep:
            bonus = most * 0.2 if c.attrs.get("class") and c.attrs.get("class") == top.attrs.get("class") else 0
            keep = id(c) in scored and scored[id(c)][1] + bonus >= enough
            if not keep and c.tag == "p":
                text, share = c.text(), link_share(c)
                keep = (len(text) > 80 and share < 0.25) or (0 < len(text) <= 80 and share == 0 and re.search(r"\.( |$)", text) is not None)
        if keep:
            c.parent = out
            out.children.append(c)
    return out


def cleaned(article: Element, flags: int) -> Element:
    """Without forms, asides and the like, and without lists, tables and divisions that look like furniture."""
    for e in reversed(list(article.walk())):
        if e.tag in DROPPED:
            e.detach()
        elif flags & CLEAN and e.tag in CLEANED and e.parent is not article and not inside(e, frozenset(("code", "figure"))):
            weight, text = class_weight(e, flags), e.text()
            if weight < 0:
                e.detach()
                continue
            if text.count(",") >= 10:
                continue
            tags = [x.tag for x in e.walk()]
            p, img, li, fields = tags.count("p"), tags.count("img"), tags.count("li") - 100, sum(t == "input" for t in tags)
            share, heads = link_share(e), sum(len(x.text()) for x in e.walk() if re.fullmatch("h[1-6]", x.tag)) / max(1, len(text))
            listed = e.tag == "ul" or sum(len(x.text()) for x in e.walk() if x.tag in ("ul", "ol")) / max(1, len(text)) > 0.9
            if (
                (img > 1 and p / img < 0.5)
                or (not listed and li > p)
                or fields > p // 3
                or (not listed and heads < 0.9 and len(text) < BLOCK_CHARS and (img == 0 or img > 2) and share > 0)
                or (not listed and weight < 25 and share > 0.2)
                or (weight >= 25 and share > 0.5)
            ):
                e.detach()
    return article


def readable(doc: Element) -> Element | None:
    """The main content as an element of its own; None where the page has no text. The document is left as it is."""
    body = doc.first("body") or doc
    attempts = []
    for flags in (STRIP | WEIGH | CLEAN, WEIGH | CLEAN, CLEAN, 0):
        page = copy(body, Element("html"))
        if flags & STRIP:
            strip_unlikely(page)
        top, scored = main_node(page, flags)
        article = cleaned(joined(top, scored), flags)
        attempts.append((len(article.text()), article))
        if attempts[-1][0] >= ENOUGH_CHARS:
            return article
    length, article = max(attempts, key=lambda a: a[0])
    return article if length else None
