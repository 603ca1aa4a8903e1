"""A tree over the standard library's tokenizer, with the usual implied end tags.

Unclosed inline formatting is closed at the end of its block; the adoption agency of browsers is not followed.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("title meta link base script style noscript template".split())
#: Opening one of these ends the open ones named first, up to the ones named second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "tbody"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
}
DEPTH = 400


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator[Element]:
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def texts(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Text):
                yield str(c)
            elif isinstance(c, Element):
                stack += reversed(c.children)

    def text(self, sep: str = "") -> str:
        return " ".join(sep.join(self.texts()).split())

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def ancestors(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def first(self, tag: str) -> Element | None:
        return next((e for e in self.walk() if e.tag == tag), None)


class Text(str):
    pass


class Comment(str):
    pass


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#document")
        self.html = Element("html", {}, self.root)
        self.head, self.body = Element("head", {}, self.html), Element("body", {}, self.html)
        self.root.children.append(self.html)
        self.html.children += [self.head, self.body]
        self.stack: list[Element] = []
        self.in_head = True

    def at(self) -> Element:
        return self.stack[-1] if self.stack else self.head if self.in_head else self.body

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head", "body"):
            known = {"html": self.html, "head": self.head, "body": self.body}[tag]
            known.attrs = attrs | known.attrs
            if tag == "body":
                self.in_head = False
                self.stack.clear()
            return
        if self.in_head and not self.stack and tag not in HEAD:
            self.in_head = False
        if tag in ENDS:
            ends, stop = ENDS[tag]
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag in stop:
                    break
                if self.stack[k].tag in ends:
                    del self.stack[k:]
        if tag in BLOCK:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag == "p":
                    del self.stack[k:]
                    break
                if self.stack[k].tag in BLOCK:
                    break
            if tag[0] == "h" and tag[1:].isdigit() and self.stack and self.stack[-1].tag[0] == "h" and self.stack[-1].tag[1:].isdigit():
                self.stack.pop()
        parent = self.at()
        e = Element(tag, attrs, parent)
        parent.children.append(e)
        if tag not in VOID and len(self.stack) < DEPTH:
            self.stack.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1].tag == tag and tag not in BLOCK and tag not in ("a", "b", "i", "em", "strong", "span"):
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag in ("head", "body", "html"):
            if tag == "head":
                self.in_head = False
                self.stack.clear()
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if tag not in BLOCK and self.stack[k].tag in BLOCK:
                return

    def handle_data(self, data):
        if self.cdata_elem in ("title", "textarea"):
            data = entities.unescape(data)
        if self.in_head and not self.stack:
            if not data.strip():
                return
            self.in_head = False
        self.at().children.append(Text(data))

    def handle_comment(self, data):
        self.at().children.append(Comment(data))


def parse(source: str) -> Element:
    b = _Builder()
    b.feed(source)
    b.close()
    return b.root


def serialise(node, out: list[str] | None = None) -> str:
    """Outer HTML; children of the node only for the document itself."""
    top = out is None
    out = [] if out is None else out
    if isinstance(node, Comment):
        out.append(f"<!--{node}-->")
    elif isinstance(node, Text):
        out.append(entities.escape(str(node), quote=False))
    elif node.tag == "#document":
        for c in node.children:
            serialise(c, out)
    else:
        out.append(f"<{node.tag}" + "".join(f' {k}="{entities.escape(v)}"' for k, v in node.attrs.items()) + ">")
        for c in node.children:
            if isinstance(c, Text) and node.tag in ("script", "style"):
                out.append(str(c))
            else:
                serialise(c, out)
        if node.tag not in VOID:
            out.append(f"</{node.tag}>")
    return "".join(out) if top else ""


def inner(node: Element) -> str:
    return "".join(serialise(c) for c in node.children)
