"""CSS selectors: types, ids, classes, attribute tests, structural pseudo-classes, :not, :is, :where and :has;
descendant, child and sibling combinators; lists."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

from webloom.html.tree import Element

IDENT = re.compile(r"-?(?:[^\W\d]|[-_])[\w-]*")
ATTRIBUTE = re.compile(r"""\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*([iIsS])?\s*)?\]""")
COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
STEP = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*", re.I)
#: name of the pseudo-class: (counted from the end, among equal tags only, the steps where they are fixed)
NTH = {
    "first-child": (False, False, (0, 1)), "last-child": (True, False, (0, 1)), "first-of-type": (False, True, (0, 1)), "last-of-type": (True, True, (0, 1)),
    "nth-child": (False, False, None), "nth-last-child": (True, False, None), "nth-of-type": (False, True, None), "nth-last-of-type": (True, True, None),
}

Places = dict[int, dict[int, tuple]]
Test = Callable[[Element, Places], bool]


class SelectorError(ValueError):
    pass


def _place(e: Element, places: Places) -> tuple[int, int, int, int, Element | None]:
    """(index, rest, index and rest among equal tags, element before) of an element among its siblings; a parent's
    children are counted once a search."""
    if e.parent is None:
        return 0, 0, 0, 0, None
    if id(e.parent) not in places:
        family = [c for c in e.parent.children if isinstance(c, Element)]
        tags: dict[str, int] = {}
        for c in family:
            tags[c.tag] = tags.get(c.tag, 0) + 1
        seen: dict[str, int] = {}
        of = places[id(e.parent)] = {}
        for i, c in enumerate(family):
            k = seen.get(c.tag, 0)
            seen[c.tag] = k + 1
            of[id(c)] = (i, len(family) - 1 - i, k, tags[c.tag] - 1 - k, family[i - 1] if i else None)
    return places[id(e.parent)][id(e)]


def _nth(last: bool, typed: bool, a: int, b: int) -> Test:
    def test(e: Element, places: Places) -> bool:
        n = _place(e, places)[2 * typed + last] + 1 - b
        return n == 0 if a == 0 else n % a == 0 and n // a >= 0

    return test


def _named(kind: str, name: str, holds: Callable[[Element, str], bool]) -> Test:
    """A test that an element's tag, id or classes answer alone; ``key`` says so."""

    def test(e: Element, places: Places) -> bool:
        return holds(e, name)

    test.key = (kind, name)
    return test


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    want = value.lower() if fold else value

    def test(e: Element, places: Places) -> bool:
        got = e.attrs.get(name)
        if got is None or op is None:
            return got is not None
        got = got.lower() if fold else got
        if op == "=":
            return got == want
        if op == "|=":
            return got == want or got.startswith(want + "-")
        if op == "~=":
            return want in got.split()
        return bool(want) and (got.startswith(want) if op == "^=" else got.endswith(want) if op == "$=" else want in got)

    return test


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self):
        raise SelectorError(f"bad selector {self.text!r}")

    def match(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def take(self, token: str) -> bool:
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def ident(self) -> str:
        return (self.match(IDENT) or self.fail())[0]

    def lists(self) -> list[list[tuple[str, tuple[Test, ...]]]]:
        """Chains up to the end, or up to a parenthesis that closes."""
        out = [self.chain()]
        while self.match(re.compile(r"\s*,\s*")):
            out.append(self.chain())
        self.match(re.compile(r"\s+"))
        return out

    def chain(self) -> list[tuple[str, tuple[Test, ...]]]:
        chain, sign = [], " "
        while True:
            chain.append((sign, self.compound()))
            back, m = self.at, self.match(COMBINATOR)
            if not m:
                return chain
            sign = m[1] or " "
            if not m[1] and (self.at == len(self.text) or self.text[self.at] in ",)"):
                self.at = back
                return chain

    def compound(self) -> tuple[Test, ...]:
        tests, begin = [], self.at
        if not self.take("*"):
            m = self.match(IDENT)
            if m:
                tests.append(_named("tag", m[0].lower(), lambda e, name: e.tag == name))
        while self.at < len(self.text) and self.text[self.at] in "#.[:":
            tests.append(self.simple())
        if self.at == begin:
            self.fail()
        return tuple(tests)

    def simple(self) -> Test:
        if self.take("#"):
            name = (self.match(re.compile(r"[\w-]+")) or self.fail())[0]
            return _named("id", name, lambda e, name: e.attrs.get("id") == name)
        if self.take("."):
            return _named("class", self.ident(), lambda e, name: name in e.classes())
        if self.text[self.at] == "[":
            m = self.match(ATTRIBUTE) or self.fail()
            return _attribute(m[1].lower(), m[2], m[3] or m[4] or m[5] or "", (m[6] or "").lower() == "i")
        self.take(":")
        return self.pseudo(self.ident().lower())

    def pseudo(self, name: str) -> Test:
        if name in NTH:
            last, typed, steps = NTH[name]
            return _nth(last, typed, *(steps or self.steps()))
        if name in ("only-child", "only-of-type"):
            k = 2 * (name == "only-of-type")
            return lambda e, places: _place(e, places)[k] == _place(e, places)[k + 1] == 0
        if name == "empty":
            return lambda e, places: not any(isinstance(c, Element) or c for c in e.children)
        if name == "root":
            return lambda e, places: e.parent is None or e.parent.tag == "#document"
        if name not in ("not", "is", "where", "has") or not self.take("("):
            self.fail()
        self.match(re.compile(r"\s+"))
        if name == "has":
            direct = bool(self.match(re.compile(r">\s*")))
        chains = self.lists()
        if not self.take(")"):
            self.fail()
        if name == "has":
            below = lambda e: (c for c in e.children if isinstance(c, Element)) if direct else e.walk()
            return lambda e, places: any(_fits(x, c, len(c) - 1, places) for x in below(e) for c in chains)
        want = name != "not"
        return lambda e, places: any(_fits(e, c, len(c) - 1, places) for c in chains) is want

    def steps(self) -> tuple[int, int]:
        if not self.take("("):
            self.fail()
        m = self.match(STEP)
        if not m or not self.take(")"):
            self.fail()
        if m[1]:
            return 2, int(m[1].lower() == "odd")
        if m[5]:
            return 0, int(m[5])
        return int(m[2] + "1" if m[2] in ("", "+", "-") else m[2]), int((m[3] or "") + (m[4] or "0"))


@lru_cache(maxsize=4096)
def compile_selector(text: str) -> list[list[tuple[str, tuple[Test, ...]]]]:
    """Alternatives, each a chain of (combinator, compound), innermost last."""
    r = _Reader(text.strip())
    if not r.text:
        raise SelectorError("empty selector")
    out = r.lists()
    if r.at != len(r.text):
        r.fail()
    return out


def _fits(e: Element, chain: list, k: int, places: Places) -> bool:
    if e.tag == "#document" or not all(test(e, places) for test in chain[k][1]):
        return False
    if k == 0:
        return True
    sign = chain[k][0]
    if sign == ">":
        return e.parent is not None and _fits(e.parent, chain, k - 1, places)
    if sign == " ":
        return any(_fits(a, chain, k - 1, places) for a in e.ancestors())
    before = _place(e, places)[4]
    while before is not None:
        if _fits(before, chain, k - 1, places):
            return True
        before = None if sign == "+" else _place(before, places)[4]
    return False


def matches(e: Element, selector: str) -> bool:
    places: Places = {}
    return any(_fits(e, c, len(c) - 1, places) for c in compile_selector(selector))


def select(scope: Element, selector: str, limit: int | None = None) -> list[Element]:
    """Matching elements below scope, in document order."""
    chains, out, places = compile_selector(selector), [], {}
    for e in scope.walk():
        if any(_fits(e, c, len(c) - 1, places) for c in chains):
            out.append(e)
            if limit is not None and len(out) >= limit:
                break
    return out


class Matches:
    """What some selectors match in a document: elements in its order, cut to a scope by their places."""

    def __init__(self, order: list[Element], ends: dict[int, tuple[int, int]], found: dict[str, list[int]]):
        self.order, self.ends, self.found = order, ends, found

    def of(self, selector: str, scope: Element, limit: int | None = None) -> list[Element]:
        """The same as ``select``."""
        places = self.found[selector]
        begin, end = self.ends[id(scope)]
        low, high = bisect_right(places, begin), bisect_right(places, end)
        return [self.order[i] for i in places[low : high if limit is None else min(high, low + limit)]]


class Matcher:
    """Many selectors as one automaton. A bit stands for each compound of each chain; an element's bits follow from those of its parent, its ancestors and its
    earlier siblings by one shift each, so a single traversal finds the matches of all selectors. Compounds are looked up by tag, id and class; other tests are only made
    where the rest of the chain already fits."""

    def __init__(self, selectors: list[str]):
        self.start = self.any = self.rest = 0
        self.by = {" ": 0, ">": 0, "+": 0, "~": 0}
        self.keys: dict[tuple[str, str], int] = {}
        self.tests: dict[int, tuple[Test, ...]] = {}
        self.final: dict[int, list[str]] = {}
        bit = 1
        for text in dict.fromkeys(selectors):
            for chain in compile_selector(text):
                for k, (sign, tests) in enumerate(chain):
                    if k:
                        self.by[sign] |= bit
                    else:
                        self.start |= bit
                    keyed = [t for t in tests if hasattr(t, "key")]
                    best = min(keyed, key=lambda t: ("id", "class", "tag").index(t.key[0]), default=None)
                    if best is None:
                        self.any |= bit
                    else:
                        self.keys[best.key] = self.keys.get(best.key, 0) | bit
                    if left := tuple(t for t in tests if t is not best):
                        self.rest |= bit
                        self.tests[bit] = left
                    last, bit = bit, bit << 1
                self.final.setdefault(last, []).append(text)
        self.ending = sum(self.final)
        self.texts = list(dict.fromkeys(selectors))

    def over(self, doc: Element) -> Matches:
        order: list[Element] = [doc]
        ends: dict[int, tuple[int, int]] = {}
        found: dict[str, list[int]] = {t: [] for t in self.texts}
        places: Places = {}
        keys, final = self.keys, self.final
        inside, child, after, later = self.by[" "], self.by[">"], self.by["+"], self.by["~"]
        # of each open element: its children that are left, its bits, those of it and its ancestors, of the sibling before, and of all earlier ones
        stack = [[iter(doc.children), 0, 0, 0, 0, doc, 0]]
        while stack:
            top = stack[-1]
            e = next((c for c in top[0] if isinstance(c, Element)), None)
            if e is None:
                ends[id(top[5])] = (top[6], len(order) - 1)
                stack.pop()
                continue
            at = len(order)
            order.append(e)
            bits = self.any | keys.get(("tag", e.tag), 0)
            if e.attrs:
                if name := e.attrs.get("id"):
                    bits |= keys.get(("id", name), 0)
                if "class" in e.attrs:
                    for name in e.classes():
                        bits |= keys.get(("class", name), 0)
            bits &= self.start | (top[2] << 1) & inside | (top[1] << 1) & child | (top[3] << 1) & after | (top[4] << 1) & later
            left = bits & self.rest
            while left:
                b = left & -left
                left ^= b
                if not all(t(e, places) for t in self.tests[b]):
                    bits ^= b
            done = bits & self.ending
            while done:
                b = done & -done
                done ^= b
                for text in final[b]:
                    if not found[text] or found[text][-1] != at:
                        found[text].append(at)
            top[3], top[4] = bits, top[4] | bits
            stack.append([iter(e.children), bits, top[2] | bits, 0, 0, e, at])
        return Matches(order, ends, found)
