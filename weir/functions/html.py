"""Elements of an HTML text by a locator: a tag, a CSS selector, a path, or text. The parser is the standard library's tolerant one.

A locator becomes steps once, on the driver; a step is (whether the parent itself is meant, tag or *, tests), and an
element fits if it fits the last step and its ancestors the steps before.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: int  # -1 at the top
    nth: int  # among its parent's elements of the tag, from 1
    spans: list[int]  # outer start, inner start, inner end, outer end
    said: list[int]  # first and last piece of text


class _Collector(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.found, self.open, self.pieces, self.nth = html, [], [], [], {}
        self.starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()
        for e in self.open:
            self._end(self.found[e], len(html), len(html))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _end(self, e: Element, inner: int, outer: int) -> None:
        e.spans[2:], e.said[1] = [inner, outer], len(self.pieces)

    def handle_starttag(self, tag, attrs):
        parent, at = self.open[-1] if self.open else -1, self._at()
        after, n = at + len(self.get_starttag_text() or ""), self.nth.get((parent, tag), 0) + 1
        self.nth[parent, tag] = n
        self.found.append(Element(tag, {k: v or "" for k, v in attrs}, parent, n, [at, after, after, after], [len(self.pieces)] * 2))
        if tag not in VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        at = self._at()
        for k in range(len(self.open) - 1, -1, -1):
            if self.found[self.open[k]].tag == tag:
                end = self.html.find(">", at) + 1 or len(self.html)
                for e in self.open[k + 1 :]:
                    self._end(self.found[e], at, at)
                self._end(self.found[self.open[k]], at, end)
                del self.open[k:]
                return

    def handle_data(self, data):
        self.pieces.append(data)

    def text(self, e: Element) -> str:
        return " ".join("".join(self.pieces[e.said[0] : e.said[1]]).split())


Test = Callable[[Element, str], bool]  # of an element and its text
Step = tuple[bool, str, list[Test]]

_VALUE = {
    "=": lambda a, v: a == v,
    "^=": lambda a, v: v != "" and a.startswith(v),
    "$=": lambda a, v: v != "" and a.endswith(v),
    "*=": lambda a, v: v != "" and v in a,
    "~=": lambda a, v: v in a.split(),
    "|=": lambda a, v: a == v or a.startswith(v + "-"),
}


def _attribute(name: str, op: str | None = None, value: str = "") -> Test:
    return lambda e, _: name in e.attrs and (op is None or _VALUE[op](e.attrs[name], value))


_CSS = re.compile(r"""\s*([>,])\s*|(\s+)|(\*|[A-Za-z][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]""")


def css(selector: str) -> list[list[Step]]:
    """Steps of each alternative: tags, #id, .class, [attribute tests], descendants and children."""
    ways: list[list[Step]] = [[(False, "*", [])]]
    at, selector = 0, selector.strip()
    while at < len(selector):
        m = _CSS.match(selector, at)
        if not m:
            raise ValueError(f"can't read the selector at {selector[at:]!r}")
        at = m.end()
        direct, tag, tests = ways[-1][-1]
        if m[1] == ",":
            ways.append([(False, "*", [])])
        elif m[1] or m[2]:
            ways[-1].append((m[1] == ">", "*", []))
        elif m[3]:
            ways[-1][-1] = (direct, m[3].lower(), tests)
        else:
            tests.append(_attribute("id", "=", m[4]) if m[4] else _attribute("class", "~=", m[5]) if m[5] else _attribute(m[6].lower(), m[7], (m[8] or "").strip("\"'")))
    return ways


_STEP, _PREDICATE = re.compile(r"(//?)(\*|[\w-]+)((?:\[[^\]]*\])*)"), re.compile(r"\[\s*([^\]]*?)\s*\]")
_PATH_TESTS = [
    (re.compile(r"(\d+)"), lambda m: lambda e, _: e.nth == int(m[1])),
    (re.compile(r"@([\w:-]+)"), lambda m: _attribute(m[1])),
    (re.compile(r"@([\w:-]+)\s*=\s*[\"'](.*)[\"']"), lambda m: _attribute(m[1], "=", m[2])),
    (re.compile(r"contains\(\s*@([\w:-]+)\s*,\s*[\"'](.*)[\"']\s*\)"), lambda m: _attribute(m[1], "*=", m[2])),
    (re.compile(r"starts-with\(\s*@([\w:-]+)\s*,\s*[\"'](.*)[\"']\s*\)"), lambda m: _attribute(m[1], "^=", m[2])),
    (re.compile(r"(?:text\(\)|\.)\s*=\s*[\"'](.*)[\"']"), lambda m: lambda _, said: said == m[1]),
    (re.compile(r"contains\(\s*(?:text\(\)|\.)\s*,\s*[\"'](.*)[\"']\s*\)"), lambda m: lambda _, said: m[1] in said),
]


def xpath(path: str) -> list[list[Step]]:
    """Steps of a path: /, //, tags, and predicates on the number, attributes and text."""
    steps: list[Step] = []
    if "".join(m[0] for m in _STEP.finditer(path)) != path or not path:
        raise ValueError(f"can't read the path {path!r}")
    for slash, tag, predicates in _STEP.findall(path):
        tests = []
        for p in _PREDICATE.findall(predicates):
            fits = [make(m) for pattern, make in _PATH_TESTS if (m := pattern.fullmatch(p))]
            if not fits:
                raise ValueError(f"can't read the predicate {p!r}")
            tests.append(fits[0])
        steps.append((slash == "/", tag.lower(), tests))
    return [steps]


def steps_of(locator: str) -> list[list[Step]]:
    """Steps of `css:…`, `xpath:…`, `text:…`, a path that begins with a slash, or else a CSS selector."""
    kind, _, rest = locator.partition(":")
    if kind == "text":
        return [[(False, "*", [lambda _, said: rest in said])]]
    if kind == "xpath" or locator.startswith("/"):
        return xpath(rest if kind == "xpath" else locator)
    return css(rest if kind == "css" else locator)


def _fits(page: _Collector, e: Element, steps: list[Step], rooted: bool) -> bool:
    direct, tag, tests = steps[-1]
    if tag not in ("*", e.tag) or tests and not all(t(e, page.text(e)) for t in tests):
        return False
    if len(steps) == 1:
        return not (rooted and direct) or e.parent < 0
    above = e.parent
    while above >= 0:
        if _fits(page, page.found[above], steps[:-1], rooted):
            return True
        above = -1 if direct else page.found[above].parent
    return False


def elements(html: str, ways: list[list[Step]]) -> list[tuple[str, dict[str, str], str, str, str]]:
    """(tag, attributes, text, inner HTML, outer HTML) of each element that fits, in document order; one that isn't closed
    reaches to the end of its parent."""
    page = _Collector(html)
    return [(e.tag, e.attrs, page.text(e), html[e.spans[1] : e.spans[2]], html[e.spans[0] : e.spans[3]]) for e in page.found if any(_fits(page, e, steps, True) for steps in ways)]
