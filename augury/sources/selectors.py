"""Selectors of elements, matched in one pass over a page's tags.

A selector is a chain of simple ones, each a descendant of the one before: a tag, .classes and
[attributes], with or without a value; commas separate alternatives. All selectors of a source
are one matcher: as tags open, each keeps how much of its chain the open elements have matched.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from augury.functions import text as X
from augury.sources.registry import SourceConfig

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style"))
_SIMPLE = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*)|\.(?P<of>[\w-]+)|\[(?P<name>[\w:-]+)(?:=(?P<q>["']?)(?P<value>[^\]"']*)(?P=q))?\]|(?P<any>\*)""")


@dataclass(frozen=True)
class Simple:
    tag: str | None
    classes: frozenset[str]
    attributes: tuple[tuple[str, str | None], ...]

    def matches(self, tag: str, classes: set[str], attributes: dict[str, str]) -> bool:
        if self.tag is not None and self.tag != tag or not self.classes <= classes:
            return False
        return all(name in attributes and (value is None or attributes[name] == value) for name, value in self.attributes)


def compiled(selector: str) -> list[tuple[Simple, ...]]:
    """The chains of a selector, one for each alternative."""
    chains = []
    for alternative in selector.split(","):
        chain = []
        for word in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", alternative):
            tag, classes, attributes, at = None, set(), [], 0
            for m in _SIMPLE.finditer(word):
                if m.start() != at:
                    break
                at = m.end()
                if m["tag"]:
                    tag = m["tag"].lower()
                elif m["of"]:
                    classes.add(m["of"])
                elif m["name"]:
                    attributes.append((m["name"].lower(), m["value"]))
            if at != len(word):
                raise ValueError(f"not a selector: {selector}")
            chain.append(Simple(tag, frozenset(classes), tuple(attributes)))
        if not chain:
            raise ValueError(f"not a selector: {selector}")
        chains.append(tuple(chain))
    return chains


@dataclass
class Element:
    """What was selected: the texts within it in order, an attribute content of its own, and the cells of a row."""

    content: str | None = None
    texts: list[str] = field(default_factory=list)
    cells: list[Element] = field(default_factory=list)

    def text(self) -> str:
        return (self.content or "".join(self.texts)).strip()

    def line(self) -> str:
        return " ".join(" ".join(self.texts).split())

    def lines(self) -> list[str]:
        return [line.strip() for part in self.texts for line in part.splitlines() if line.strip()]


class Matcher:
    """The selectors by name, each with all of its elements or the first one only; cells are looked for within rows."""

    def __init__(self, firsts: dict[str, tuple[str, ...]], every: dict[str, tuple[str, ...]], rows: tuple[str, ...] = (), cells: str = "th,td"):
        self.chains: list[tuple[tuple[Simple, ...], str, int, bool]] = []  # chain, name, place in the name's list, first only
        for names, first in ((firsts, True), (every | {"": rows}, False)):
            for name, selectors in names.items():
                self.chains += [(chain, name, k, first) for k, s in enumerate(selectors) for chain in compiled(s)]
        self.cells = compiled(cells)

    def read(self, html: str | None) -> dict[tuple[str, int], list[Element]]:
        """The elements of (name, place), in document order; rows have the name ''."""
        pass_ = _Pass(self)
        pass_.feed(html or "")
        pass_.close()
        return pass_.found


class _Pass(HTMLParser):
    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher
        self.found: dict[tuple[str, int], list[Element]] = {}
        # Of each open element: its tag, how much of each chain it and those around it match, and what it began.
        self._open: list[tuple[str, list[int], list[int], list[Element]]] = []
        self._into: list[Element] = []
        self._rows: list[Element] = []
        self._hidden = 0

    def handle_starttag(self, tag, attrs):
        attributes = {name: value or "" for name, value in attrs}
        classes = set(attributes.get("class", "").split())
        before = self._open[-1][1] if self._open else [0] * len(self.matcher.chains)
        before_cells = self._open[-1][2] if self._open else [0] * len(self.matcher.cells)
        begun: list[Element] = []
        after_cells, is_cell = list(before_cells), False
        for k, chain in enumerate(self.matcher.cells):
            at = before_cells[k]
            if chain[-1].matches(tag, classes, attributes) and at >= len(chain) - 1:
                is_cell = True
            if at < len(chain) - 1 and chain[at].matches(tag, classes, attributes):
                after_cells[k] = at + 1
        if is_cell:
            for row in self._rows:
                row.cells.append(cell := Element())
                begun.append(cell)
        after, rows = list(before), []
        for k, (chain, name, place, first) in enumerate(self.matcher.chains):
            at = before[k]
            if at == len(chain) - 1:
                if not chain[at].matches(tag, classes, attributes):
                    continue
                listed = self.found.setdefault((name, place), [])
                if first and listed:
                    continue
                element = Element(attributes.get("content") if tag == "meta" else None)
                listed.append(element)
                begun.append(element)
                if name == "":
                    rows.append(element)
            elif chain[at].matches(tag, classes, attributes):
                after[k] = at + 1
        if tag in VOID:
            return
        if tag in HIDDEN:
            self._hidden += 1
        self._rows += rows
        self._into += begun
        self._open.append((tag, after, after_cells, begun))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(o[0] == tag for o in self._open):
            return
        while self._open:
            name, _, _, begun = self._open.pop()
            if name in HIDDEN:
                self._hidden -= 1
            for element in begun:
                self._into = [x for x in self._into if x is not element]
                self._rows = [x for x in self._rows if x is not element]
            if name == tag:
                return

    def handle_data(self, data):
        if not self._hidden:
            for element in self._into:
                element.texts.append(data)


FIELDS = ("title", "author", "published", "updated")


@functools.lru_cache(maxsize=256)
def matcher_of(config: SourceConfig) -> Matcher:
    firsts = {"title": config.titles, "author": config.authors, "published": config.published, "updated": config.updated, "page": ("title",)}
    return Matcher(firsts, {"items": ("ol li", "ul li"), "body": config.bodies}, config.rows, config.cells)


def read_page(html: str | None, config: SourceConfig, least: int = 8, strict: bool = False) -> dict:
    """title, page_title, author, published and updated as they stand, and picks (pick, team, name, position, school), by a source's selectors.

    Of a field's selectors the first one counts that finds a text. Picks come from rows of cells, by
    the first selector of rows that gives any, else from list items, else from the lines of the first kind of body that
    there is; items and lines count if they are `least` or more.
    """
    found = matcher_of(config).read(html)
    out: dict = {}
    for name in (*FIELDS, "page"):
        places = sorted(k for n, k in found if n == name)
        out[name] = next((text for k in places if (text := found[name, k][0].text())), None)
    out["page_title"] = out.pop("page")
    out["picks"] = _from_rows(found, len(config.rows), strict) or _from_items(found, least, strict) or _from_bodies(found, len(config.bodies), least, strict)
    return out


def _from_rows(found: dict, n: int, strict: bool) -> list[tuple]:
    for k in range(n):
        picks = []
        for row in found.get(("", k), []):
            cells = [c.line() for c in row.cells]
            if len(cells) >= 3 and cells[0].isdigit():
                parts = [p.strip() for p in re.split(X.STRICT_CELL if strict else X.CELL, cells[2]) if p.strip()]
                parts = [*parts[:3], None, None][:3] if len(parts) > 1 else [cells[2], None, None]
                picks.append((int(cells[0]), cells[1], *parts))
        if picks:
            return picks
    return []


def _lines(lines: list[str], strict: bool) -> list[tuple]:
    return [parts for line in lines if (parts := X.line_parts(line, strict))]


def _from_items(found: dict, least: int, strict: bool) -> list[tuple]:
    picks: list[tuple] = []
    for k in (0, 1):
        picks += _lines([item.line() for item in found.get(("items", k), [])], strict)
        if len(picks) >= least:
            return picks
    return []


def _from_bodies(found: dict, n: int, least: int, strict: bool) -> list[tuple]:
    bodies = next((b for k in range(n) if (b := found.get(("body", k)))), [])
    picks: list[tuple] = []
    for body in bodies:
        picks += _lines(body.lines(), strict)
        if len(picks) >= least:
            return picks
    return []
