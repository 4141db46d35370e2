"""A plain element tree for archived HTML, to hold the interval encoding against."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
    "wbr",
}
SIMPLE = re.compile(
    r"(?P<tag>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>[*$^]?=)(?P<quote>['\"])(?P<value>.*?)(?P=quote))?\]"
)
COMPILED: dict[str, list] = {}


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def elements(self):
        """Descendants in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def text(self, separator: str = "", strip: bool = True) -> str:
        parts, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                piece = node.strip() if strip else node
                if piece:
                    parts.append(piece)
            else:
                stack.extend(reversed(node.children))
        return separator.join(parts)

    def select(self, selector: str) -> list[Element]:
        """Descendants matching a selector made of tag, .class, [attr], [attr*='v'] and the
        descendant, next-sibling and comma combinators."""
        groups = _compiled(selector)
        return [e for e in self.elements() if any(_matches(e, steps) for steps in groups)]

    def first(self, *selectors: str) -> Element | None:
        return next((found[0] for s in selectors if (found := self.select(s))), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.node = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        child = Element(tag, {k: v or "" for k, v in attrs}, self.node)
        self.node.children.append(child)
        if tag not in VOID:
            self.node = child

    def handle_startendtag(self, tag, attrs):
        self.node.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.node))

    def handle_endtag(self, tag):
        node = self.node
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.node = node.parent

    def handle_data(self, data):
        if self.node.tag not in ("script", "style"):
            self.node.children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _compiled(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """The steps of each alternative, read once per selector."""
    if selector not in COMPILED:
        COMPILED[selector] = [_steps(group) for group in re.split(r",(?![^\[]*\])", selector)]
    return COMPILED[selector]


def _steps(selector: str) -> list[tuple[str, list[dict]]]:
    """(combinator before, simple tests) from left to right."""
    spaced = re.sub(r"\s*\+\s*(?![^\[]*\])", " + ", selector.strip())
    steps, combinator = [], " "
    for token in re.split(r"\s+(?![^\[]*\])", spaced):
        if token == "+":
            combinator = "+"
        else:
            steps.append((combinator, [m.groupdict() for m in SIMPLE.finditer(token)]))
            combinator = " "
    return steps


def _test(element: Element, test: dict) -> bool:
    if test["tag"]:
        return element.tag == test["tag"]
    if test["cls"]:
        return test["cls"] in element.attrs.get("class", "").split()
    actual = element.attrs.get(test["attr"])
    if actual is None or not test["op"]:
        return actual is not None
    wanted = test["value"]
    return {
        "=": actual == wanted,
        "*=": wanted in actual,
        "$=": actual.endswith(wanted),
        "^=": actual.startswith(wanted),
    }[test["op"]]


def _matches(element: Element, steps: list[tuple[str, list[dict]]]) -> bool:
    combinator, tests = steps[-1]
    if not all(_test(element, t) for t in tests):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    if combinator == "+":
        siblings = [c for c in element.parent.children if isinstance(c, Element)]
        i = siblings.index(element)
        return i > 0 and _matches(siblings[i - 1], rest)
    parent = element.parent
    while parent is not None:
        if _matches(parent, rest):
            return True
        parent = parent.parent
    return False
