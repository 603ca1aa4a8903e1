"""Main-text extraction by union-free wrapper inference.

Pages of one host share templates. Each page becomes a nested stream of block tags and text; runs of
equal neighbours fold into repeated groups. A host's wrapper starts as its first page and is aligned with
one page after another: equal tags are matched level by level, what only one side has becomes an optional
group, what comes in runs a repeated group, and texts that differ become slots. Two wrappers align the same
way, so tasks infer wrappers from the pages at hand, at any split of a host, and the partial ones are merged.

The wrapper tells slots from template: a text that is the same on two pages or more, of a host whose pages differ
in their paragraphs (copies count as one page), is template, and has no weight. The group that holds most
of the other text is the main group; an article or main element goes before others. So two pages that differ are
the least that show a template; a page alone, or among copies, is read by its own structure. In the main group,
everything stays but: menus, footers, sidebars, forms, adverts, notices and comments, by their tags and by names that say nothing else; groups
whose name may mean such things as well as content, if the wrapper has them as template; and at its two ends, before
the first slot and after the last, template texts, in an article or main element links in plain containers alone. Without such an element, a list of links
goes if it is template too, or stands ahead of all text.
A page without the wrapper's main group is read by its own structure, less the weight of the host's template texts.

Defined results: null or empty html gives ""; pages without url, or without a host, share the wrapper of the
empty host; repeated rows give repeated results; texts of any length are read whole; nesting beyond ``DEPTH`` is
flattened, with its text kept; elements without an end tag that would hide the rest of the page are passed over,
but for script and style; of groups of equal weight, the first counts; an empty table gives an empty one; only page_id,
url and html are read. A wrapper that outgrows ``WRAPPER_NODES`` gives up the order of equal groups, and then its rarest
optional groups: that bounds memory, and can only make a page be read by its own structure.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import map_rows, table
from webloom.operators.storage import materialise

DEPTH = 250
#: Hosts, and nodes of their wrappers, that a task holds before it hands them on; and nodes of one wrapper.
HOSTS_AT_ONCE = 2_000
NODES_AT_ONCE = 200_000
WRAPPER_NODES = 8_000
#: Partial wrappers of a host that meet in one place.
FAN = 64
#: Steps of an alignment that are kept for the way back; others are repeated.
KEPT_BYTES = 16 << 20
#: Wrappers up to this size in total are broadcast; beyond it they are joined by host.
BROADCAST_BYTES = 32 << 20

BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption header footer nav aside form fieldset address details summary hr center menu dialog search hgroup".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is content wherever they stand in an article.
CONTENT = HEADINGS | frozenset("p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hgroup details summary".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no markup, or is not shown as text: it goes on to the end tag.
RAW = frozenset("script style noscript template svg iframe object textarea select canvas audio video button title".split())
NESTED = frozenset("svg template object".split())
ENDS = {t: re.compile(rf"<(/?){t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
HEAD = frozenset("title meta link style script base noscript template head".split())
CHROME = frozenset("nav header footer aside form fieldset menu dialog search address".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
#: Names of what is no part of an article; and names that may mean that.
CHROME_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|related|recommend\w*|share|sharing|social|follow|comment(?:s|list|section)?|disqus|replies|respond|"
    r"footer|masthead|topbar|toolbar|pager|pagination|login|signup|taglist)(?:$|[-_ ])",
    re.I,
)
WEAK_NAMES = re.compile(r"(?:^|[-_ ])(?:alert|side|widget|foot|header|skip|search|tags|copyright|legal|disclaimer)(?:$|[-_ ])", re.I)
#: Of the former, the ones that hold even where a name also has a word of MAIN_NAMES.
STRONG_NAMES = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|nav|navbar|menu|sidebar|comment(?:s|list|section)?|footer|cookies?|related|share|sharing|newsletter|breadcrumbs?)(?:$|[-_ ])", re.I)
#: A name that says nothing else: each of its words names chrome, or a mere part of the page.
WHOLE_NAMES = re.compile(
    r"(?:(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumbs?|sidebar|related|recommend\w*|"
    r"share|sharing|social|follow|comment(?:s|list|section)?|disqus|replies|respond|footer|masthead|topbar|toolbar|pager|pagination|login|signup|taglist|"
    r"area|bar|block|bottom|box|buttons?|container|header|icons?|inner|items?|left|links?|list|media|module|articles|outer|panel|posts|right|section|site|slot|stories|thread|title|top|unit|us|widget|wrap|wrapper)(?:$|[-_]+))+",
    re.I,
)
MAIN_NAMES = re.compile(r"(?:^|[-_ ])(?:article|content|main|post|entry|story|body|text)(?:$|[-_ ])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
DIGITS = re.compile(r"\d+")
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}


def signature(tag: str, attributes: str) -> str:
    """Tag with role, class and id; digits in names are dropped, as they number items."""
    if not attributes or "=" not in attributes:
        return tag
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    names = [re.sub(r"\d+", "", n) for n in (found.get("class", "") + " " + found.get("id", "")).split()]
    return tag + (f"@{found['role'].lower()}" if found.get("role") else "") + "".join(f".{n}" for n in sorted(set(names)))[:200]


def tag_of(sig: str) -> str:
    return sig.split("@")[0].split(".")[0]


def parse(source: str) -> list:
    """The page as nested lists: [signature, child, ...], a child being such a list or a text (text, link length)."""
    root: list = ["#root"]
    stack, names, words, in_link, linked, head = [root], ["#root"], [], False, 0, False
    endless: set[str] = set()  # elements that have no end tag from here on

    def flush():
        nonlocal words, linked
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                stack[-1].append((text, min(linked, len(text))))
        words, linked = [], 0

    def close_to(at: int):
        flush()
        del stack[at:], names[at:]

    def end_of(tag: str, at: int) -> int | None:
        """Where the element that was opened before at ends; of nested ones that are not all closed, the first end tag."""
        first, level = None, 1
        for m in ENDS[tag].finditer(source, at):
            if m[1]:
                level -= 1
                first = first or m.end()
                if not level or tag not in NESTED:
                    return m.end()
            elif not m[0].endswith("/>"):
                level += 1
        return first

    tokens = TOKEN.finditer(source)
    while m := next(tokens, None):
        tag = m[3]
        if tag is None:
            if not head:
                text = m[1] if m[1] is not None else m[0] if m[0][:2] not in ("<!", "<?") else ""
                if text:
                    words.append(text)
                    if in_link:
                        linked += len(text.strip())
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag in RAW:
            if not closing and not m[4].endswith("/") and tag not in endless:
                end = end_of(tag, m.end())
                if end:
                    tokens = TOKEN.finditer(source, end)
                elif tag in ("script", "style"):
                    break
                else:
                    endless.add(tag)
            continue
        if tag == "head":
            head = not closing
            continue
        if head:
            if tag in HEAD:
                continue
            head = False
        if tag == "br":
            words.append(" ")
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag not in BLOCKS:
            continue
        if closing:
            for at in range(len(names) - 1, 0, -1):
                if names[at] == tag:
                    close_to(at)
                    break
            else:
                flush()
            continue
        flush()
        if "p" in names[-4:]:
            close_to(len(names) - 1 - names[::-1].index("p"))
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            for at in range(len(names) - 1, 0, -1):
                if names[at] in stop:
                    break
                if names[at] in shut.split():
                    close_to(at)
                    break
        elif tag in HEADINGS and names[-1] in HEADINGS:
            close_to(len(stack) - 1)
        if tag in VOID:
            continue
        node = [signature(tag, m[4])]
        stack[-1].append(node)
        if len(stack) < DEPTH:
            stack.append(node)
            names.append(tag)
    flush()
    return root


# A wrapper node is [signature, optional, repeated, pages, slot text, link text, paragraphs, constant, children];
# the root also has the two least hashes of its pages' paragraphs.
SIG, OPT, REP, PAGES, SLOT, LINK, PARAS, CONST, KIDS, DIFFERING = range(10)


def fold(page: list) -> list:
    """A page as a wrapper."""
    out = fold_node(page)

    def once(node):
        node[PAGES] = 1
        for k in node[KIDS]:
            once(k)

    once(out)
    return [*out, [hash_text(paragraphs(page))]]


def paragraphs(page: list) -> str:
    """The page's longer texts outside chrome, without digits, or all its texts there if it has none; copies of a page
    share them, whatever their dates and counters."""
    found: list = []

    def look(node):
        for k in node[1:]:
            if isinstance(k, tuple):
                found.append(DIGITS.sub("", k[0]))
            elif not chrome(k[0], True):
                look(k)

    look(page)
    return "\n".join([t for t in found if len(t) >= 15] or found)


def fold_node(node: list) -> list:
    """A page's node as a wrapper node; neighbours of the same signature make one repeated group."""
    out = [node[0], 0, 0, 1, 0, 0, 0, None, []]
    for child in node[1:]:
        if isinstance(child, tuple):
            text, link = child
            kid = ["#", 0, 0, 1, len(text), link, int(len(text) - link >= 40), hash_text(text), []]
        else:
            kid = fold_node(child)
        if out[KIDS] and out[KIDS][-1][SIG] == kid[SIG]:
            last = out[KIDS][-1]
            merge_into(last, kid)
            last[REP] = 1
        else:
            out[KIDS].append(kid)
    return out


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def pairing(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Indexes of two child lists in order, matched by signature along a longest common subsequence.

    A row of the table of lengths is a whole number with a bit for each of b, which is 0 where the length grows; a
    step to the next row is an addition. Every so many rows one is kept, and those between are made again on
    the way back."""
    n, m = len(a), len(b)
    if [x[SIG] for x in a] == [x[SIG] for x in b]:
        return [(i, i) for i in range(n)]
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x[SIG]] = where.get(x[SIG], 0) | 1 << j
    full = (1 << m) - 1

    def step(row: int, i: int) -> int:
        u = row & where.get(a[i][SIG], 0)
        return ((row + u) | (row - u)) & full

    gap = max(1, -(-n * (m // 8 + 1) // KEPT_BYTES))
    row, kept = full, {}
    for i in range(n):
        if i % gap == 0:
            kept[i] = row
        row = step(row, i)
    out, i, j, rows, start = [], n, m, [], n
    while i and j:
        if i - 1 < start:  # rows[k] is the one after start + k of a
            start = (i - 1) // gap * gap
            rows, row = [], kept[start]
            for k in range(start, i):
                row = step(row, k)
                rows.append(row)
        if rows[i - 1 - start] >> (j - 1) & 1:
            j -= 1
            out.append((None, j))
            continue
        above = rows[i - 2 - start] if i - 1 > start else kept[start]
        i -= 1
        if i and not above >> (j - 1) & 1:
            out.append((i, None))
        else:
            j -= 1
            out.append((i, j))
    return [*((None, k) for k in range(j)), *((k, None) for k in range(i)), *reversed(out)]


def merge_into(a: list, b: list) -> None:
    """Align wrapper b with wrapper a, in place."""
    a[OPT] |= b[OPT]
    a[REP] |= b[REP]
    for k in (PAGES, SLOT, LINK, PARAS):
        a[k] += b[k]
    if a[CONST] != b[CONST]:
        a[CONST] = None
    if len(a) > DIFFERING:
        a[DIFFERING] = sorted({*a[DIFFERING], *b[DIFFERING]})[:2]
    kids = []
    for i, j in pairing(a[KIDS], b[KIDS]):
        if i is None:
            kids.append(b[KIDS][j])
            kids[-1][OPT] = 1
        else:
            kids.append(a[KIDS][i])
            if j is None:
                kids[-1][OPT] = 1
            else:
                merge_into(kids[-1], b[KIDS][j])
    a[KIDS] = kids


def count(w: list) -> int:
    return 1 + sum(map(count, w[KIDS]))


def prune(w: list, limit: int = WRAPPER_NODES) -> None:
    """Give up the order of equal groups in a wrapper that has outgrown the limit, and then the rarest optional ones."""
    if count(w) <= limit:
        return

    def together(node):
        kids: dict[str, list] = {}
        for k in node[KIDS]:
            if k[SIG] in kids:
                merge_into(kids[k[SIG]], k)
                kids[k[SIG]][REP] = 1
            else:
                kids[k[SIG]] = k
        node[KIDS] = list(kids.values())
        for k in node[KIDS]:
            together(k)

    together(w)
    least = 1
    while count(w) > limit and least <= w[PAGES]:
        def cut(node):
            node[KIDS] = [k for k in node[KIDS] if not (k[OPT] and k[PAGES] <= least)]
            for k in node[KIDS]:
                cut(k)

        cut(w)
        least *= 2


def regex(w: list) -> str:
    """The wrapper as a union-free regular expression over tags: ? optional, + repeated, # a text slot."""
    if w[SIG] == "#":
        body = "#" if w[CONST] is None else "text"
    else:
        body = f"<{w[SIG]}>" + "".join(map(regex, w[KIDS])) + f"</{w[SIG].split('@')[0].split('.')[0]}>"
    mark = ("+" if w[REP] else "") + ("?" if w[OPT] else "")
    return f"({body}){mark}" if mark else body


@lru_cache(1 << 14)
def chrome(sig: str, in_main: bool) -> int:
    """2 for groups that are no part of an article, 1 for those that may be none, by their names."""
    tag, _, rest = sig.partition(".")
    tag, _, role = tag.partition("@")
    if tag in CHROME and not (in_main and tag in ("header", "address")):
        return 2
    if role in CHROME_ROLES:
        return 2
    if not rest or tag in ("html", "body", "article", "main"):
        return 0
    names = rest.split(".")
    may = [n for n in names if CHROME_NAMES.search(n) and not MAIN_NAMES.search(n) or STRONG_NAMES.search(n)]
    if any(WHOLE_NAMES.fullmatch(n) for n in may):
        return 2
    return int(bool(may) or any(WEAK_NAMES.search(n) and not MAIN_NAMES.search(n) for n in names))


def is_template(w: list, text: list) -> bool:
    """Whether a text node of wrapper w is the same on two pages or more, of a host whose pages differ."""
    return text[CONST] is not None and text[PAGES] > 1 and len(w[DIFFERING]) > 1


def total(w: list, node: list, slots: bool = True) -> tuple[int, int, int]:
    """Text, link text and paragraphs of a group, outside what is chrome; of slots alone, unless asked otherwise."""
    if node[SIG] == "#":
        return (0, 0, 0) if slots and is_template(w, node) else (node[SLOT], node[LINK], node[PARAS])
    out = (0, 0, 0)
    for k in node[KIDS]:
        if k[SIG] == "#" or not chrome(k[SIG], True):
            out = tuple(x + y for x, y in zip(out, total(w, k, slots), strict=True))
    return out


def is_article(sig: str) -> bool:
    return tag_of(sig) in ("article", "main") or "@main" in sig


def main_path(w: list) -> list[str]:
    """Signatures from the root to the group that holds the main text: an article or main element if it has
    text, otherwise down the tree as long as one child holds most of the text in slots."""
    best: list = []

    def look(node, path, slots):
        for k in node[KIDS]:
            if k[SIG] == "#" or chrome(k[SIG], False):
                continue
            if is_article(k[SIG]):
                t = total(w, k, slots)
                best.append((t[0] - t[1], tag_of(k[SIG]) == "article", path + [k[SIG]]))
            look(k, path + [k[SIG]], slots)

    for slots in (True, False):
        best.clear()
        look(w, [], slots)
        most = max((b[0] for b in best), default=0)
        if most > 0:
            good = [b for b in best if b[0] >= 0.5 * most]
            return max(good, key=lambda b: (len(b[2]) if b[1] else 0, b[0]))[2]
    path, node = [], w
    while True:
        here = total(w, node)
        options = [(total(w, k), k) for k in node[KIDS] if k[SIG] != "#" and not chrome(k[SIG], False)]
        options = [((t[0] - t[1]) * (1.3 if MAIN_NAMES.search(k[SIG].replace(".", " ")) else 1), k) for t, k in options]
        if not options:
            return path
        score, k = max(options, key=lambda o: o[0])
        if tag_of(k[SIG]) in CONTENT or score <= 0 or score < 0.75 * max(1, here[0] - here[1]):
            return path
        path.append(k[SIG])
        node = k


class Reader:
    """What a host's wrapper says of its pages; without one, what a page says of itself."""

    def __init__(self, w: list):
        self.w, self.path = w, main_path(w)
        self.article = any(map(is_article, self.path))
        #: Template texts by place and hash, anywhere; and those at the ends of the main group, with their count a page.
        self.template: set[tuple[str, int]] = set()
        self.ends: dict[tuple[str, int], float] = {}
        #: Whether groups whose name may mean chrome have slots, by place; of groups on two differing pages or more.
        self.slots: dict[str, bool] = {}
        self._look_at_all(w, "")
        self._look_at_ends()

    def _look_at_all(self, node: list, where: str) -> None:
        for k in node[KIDS]:
            if k[SIG] == "#":
                if is_template(self.w, k):
                    self.template.add((where, k[CONST]))
                continue
            at = f"{where}>{k[SIG]}"
            if k[PAGES] > 1 and len(self.w[DIFFERING]) > 1 and chrome(k[SIG], True) == 1:
                self.slots[at] = self.slots.get(at, False) or self._has_slot(k)
            self._look_at_all(k, at)

    def _has_slot(self, node: list) -> bool:
        return any(not is_template(self.w, k) if k[SIG] == "#" else self._has_slot(k) for k in node[KIDS])

    def _look_at_ends(self) -> None:
        node, times = self.w, 1.0
        for sig in self.path:
            node = next(k for k in node[KIDS] if k[SIG] == sig)
            if node[OPT]:
                return
            times = math.inf if node[REP] else times
        texts: list = []  # (place and hash, or None for a slot; count a page; whether it may go)

        def look(x, where, times, always, content):
            for k in x[KIDS]:
                every = always and not k[OPT] and k[PAGES] == self.w[PAGES]
                if k[SIG] == "#":
                    if is_template(self.w, k):
                        # an article's own words may be the same on all its pages too: there, a notice is one that links elsewhere
                        notice = not self.article or 2 * k[LINK] >= k[SLOT] > 0
                        texts.append(((where, k[CONST]), times, every and not k[REP] and not content and notice))
                    else:
                        texts.append((None, 0, False))
                elif not self.drops(k[SIG], f"{where}>{k[SIG]}"):
                    tag = tag_of(k[SIG])
                    look(k, f"{where}>{k[SIG]}", math.inf if k[REP] else times, every, content or (tag in CONTENT if self.article else tag in HEADINGS))

        look(node, "".join(f">{sig}" for sig in self.path), times, True, False)
        slots = [i for i, t in enumerate(texts) if t[0] is None]
        for i, (key, n, may) in enumerate(texts):
            if may and slots and not slots[0] < i < slots[-1]:
                self.ends[key] = self.ends.get(key, 0) + n

    def drops(self, sig: str, where: str) -> bool:
        """Whether a group of the main group is left out."""
        level = chrome(sig, True)
        return level == 2 or level == 1 and not self.slots.get(where, self.article)

    def read(self, root: list) -> str | None:
        """The main text of a parsed page: the blocks under the main path; None if the page lacks it."""
        nodes = [root]
        for sig in self.path:
            nodes = [k for x in nodes for k in x[1:] if isinstance(k, list) and k[0] == sig]
        if not nodes:
            return None
        left, found, begun = dict(self.ends), [], False

        def look(node, where, found):
            nonlocal begun
            for k in node[1:]:
                if isinstance(k, tuple):
                    key = (where, hash_text(k[0]))
                    if left.get(key, 0) > 0:
                        left[key] -= 1
                    else:
                        found.append((*k, key in self.template))
                        begun = True
                elif not self.drops(k[0], f"{where}>{k[0]}"):
                    inner: list = []
                    before = begun
                    look(k, f"{where}>{k[0]}", inner)
                    if not self.article and tag_of(k[0]) in ("ul", "ol", "menu", "dl") and len(inner) > 1:
                        n, linked = sum(len(t[0]) for t in inner), sum(t[1] for t in inner)
                        # a menu, where no article element says otherwise: links that other pages have too, or ahead of all text
                        if linked > 0.7 * n and (all(t[2] for t in inner) or not before):
                            begun = before
                            continue
                    found += inner

        for x in nodes:
            look(x, "".join(f">{sig}" for sig in self.path), found)
        return "\n".join(t[0] for t in found)

    def main_text(self, root: list) -> str:
        """The main text of a page of the host."""
        if got := self.read(root):
            return got
        own = fold(root)

        def discount(node, where):
            for k in node[KIDS]:
                if k[SIG] != "#":
                    discount(k, f"{where}>{k[SIG]}")
                elif (where, k[CONST]) in self.template:
                    k[SLOT] = k[LINK] = k[PARAS] = 0

        if self.template:
            discount(own, "")
            if got := Reader(own).read(root):
                return got
        return Reader(fold(root)).read(root) or ""


HOST = r"^[^:/?#]*://([^/?#]*)"


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    nodes = 0

    def out():
        rows = [(h, json.dumps(w, separators=(",", ":"))) for h, w in held.items()]
        held.clear()
        return pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in rows], pa.string()), "wrapper": pa.array([w for _, w in rows], pa.string())})

    for b in batches:
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not html:  # has no text on any account, and says nothing of the others
                continue
            w = fold(parse(html))
            if host in held:
                merge_into(held[host], w)
                if held[host][PAGES] % 64 == 0:
                    prune(held[host])
            else:
                held[host] = w
                prune(w)
                nodes += count(w)
            if len(held) >= HOSTS_AT_ONCE or nodes >= NODES_AT_ONCE:
                yield out()
                nodes = 0
    if held:
        yield out()


def _merge(keys: tuple, t: pa.Table) -> pa.Table:
    got = None
    for x in sorted(t["wrapper"].to_pylist()):
        w = json.loads(x)
        if got is None:
            got = w
        else:
            merge_into(got, w)
            prune(got)
    prune(got)
    return pa.table({"host": pa.array([t["host"][0].as_py()]), "wrapper": pa.array([json.dumps(got, separators=(",", ":"))])})


def infer(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper) for every host of pages (page_id, url, html, host), from all of its pages. The partial wrappers
    of a host merge in a tree, about ``fan`` of them in one place."""
    form = "host string, wrapper string"
    part = materialise(pages.select("host", "html").mapInArrow(_infer, form), "wrappers")
    while (most := part.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > fan:
        salted = part.withColumn("salt", F.pmod(F.xxhash64("wrapper", F.rand(most)), F.lit(-(-most // fan))))
        part = materialise(salted.groupBy("host", "salt").applyInArrow(_merge, form), "wrappers")
    return materialise(part.groupBy("host").applyInArrow(_merge, form), "wrappers")


def _apply():
    known: dict[str, Reader] = {}

    def run(page_id, url, html, wrapper):
        text = []
        for source, w in zip(html, wrapper, strict=True):
            if not source:
                text.append("")
                continue
            if w not in known:
                if len(known) > 500:
                    known.clear()
                known[w] = Reader(json.loads(w))
            text.append(known[w].main_text(parse(source)))
        return {"page_id": page_id, "url": url, "text": text, "n_chars": [len(t) for t in text]}

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    named = with_host(pages)
    wrappers = infer(named)
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    side = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    return map_rows(named.join(side, "host", "left"), ["page_id", "url", "html", "wrapper"], "page_id long, url string, text string, n_chars long", _apply)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
