"""What a source is, which parser reads it, and the registry of sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

KINDS = ("html_static", "html_dynamic", "rss", "manual_upload")
#: Kinds that no parser of ours reads by itself: their jobs are skipped.
NOT_AUTOMATED = ("rss", "manual_upload")


@dataclass(frozen=True)
class SourceConfig:
    """A source's weight, e-folding days, page of links and selectors, each tried in order."""

    slug: str
    weight: float = 1.0
    tau_days: float = 10.0
    kind: str = "expert"
    parser: str = "html_static"
    active: bool = True
    automated: bool = True
    discovery: str | None = None
    # The selectors of a source without its own.
    keyword: str = "mock-draft"
    titles: tuple[str, ...] = ("h1",)
    authors: tuple[str, ...] = ("meta[name='author']", ".author", "[rel='author']")
    published: tuple[str, ...] = ("meta[property='article:published_time']", "meta[name='pubdate']", "time[datetime]")
    updated: tuple[str, ...] = ("meta[property='article:modified_time']", "meta[name='lastmod']", "time[datetime]")
    rows: tuple[str, ...] = ("table tr",)
    cells: str = "th,td"
    bodies: tuple[str, ...] = ("article", "main", "body")


# Fixed values of the sources: slug, weight, e-folding days, kind, page of links, keyword of links, titles and authors
# behind h1 and the author's meta tag, rows behind those of tables, bodies.
_BY_REL, _ITEMS = ("[rel='author']",), ("ol li", "article p")
_SOURCES = (
    ("nfl-com", 1.15, 10, "expert", "https://www.nfl.com/news/", "mock-draft", (".nfl-c-article__title",), (".nfl-c-author__name",), (".nfl-c-listicle__item",), ("article", ".nfl-c-article__body", "main")),
    ("espn", 1.10, 10, "expert", "https://www.espn.com/nfl/draft/", "mock", (".headline",), (".author-name",), _ITEMS, ("article", ".article-body", "main")),
    ("cbssports", 1.08, 10, "expert", "https://www.cbssports.com/nfl/draft/news/", "mock", (".Article-headline", "[data-testid='headline']"), (".Author-name", *_BY_REL), _ITEMS, ("article", "main", ".Article-body")),
    ("yahoo", 1.00, 10, "expert", "https://sports.yahoo.com/nfl/draft/", "mock", ("[data-test-locator='headline']",), _BY_REL, _ITEMS, ("article", "main", "[role='article']")),
    ("pfn", 1.05, 10, "expert", "https://www.profootballnetwork.com/nfl/draft/", "mock", (".entry-title", "article header h1"), (".author-name", *_BY_REL), _ITEMS, ("article", "main", ".entry-content")),
    ("si-com", 1.02, 10, "expert", "https://www.si.com/nfl/draft", "mock", (".headline", "[data-module='ArticleHeader'] h1"), (".author-name", *_BY_REL), _ITEMS, ("article", "main", ".article-body")),
    ("fantasypros", 0.98, 7, "aggregator", "https://www.fantasypros.com/nfl/", "mock-draft", (".article-title",), (".author", *_BY_REL), _ITEMS, ("article", "main", ".article-content")),
    ("sporting-news", 1.00, 10, "expert", "https://www.sportingnews.com/us/nfl", "mock", (".headline",), (".author", *_BY_REL), _ITEMS, ("article", "main")),
)


def _source(slug: str, weight: float, tau: float, kind: str, discovery: str, keyword: str, titles: tuple, authors: tuple, rows: tuple, bodies: tuple) -> SourceConfig:
    return SourceConfig(
        slug, weight, float(tau), kind, discovery=discovery, keyword=keyword, titles=("h1", *titles), authors=("meta[name='author']", *authors),
        published=("meta[property='article:published_time']", "time[datetime]"), updated=("meta[property='article:modified_time']", "time[datetime]"), rows=("table tr", *rows), bodies=bodies,
    )


SOURCES = (*(_source(*values) for values in _SOURCES), SourceConfig("manual", 1.0, 14.0, "manual", "manual_upload", automated=False))


class Parser(Protocol):
    """What reads a source's pages, one at a time; articles.parsed does so for all pages of all sources."""

    config: SourceConfig

    def picks(self, html: str) -> list[tuple]: ...

    def validate(self, picks: list[tuple]) -> None: ...


# What is wrong with an article's picks.
NO_PICKS, BAD_NUMBER = "no picks were found", "a pick's number is below 1"


@dataclass
class StaticParser:
    """Picks by the chain rows of cells, list items, text, with the source's selectors."""

    config: SourceConfig

    def picks(self, html: str) -> list[tuple]:
        from augury.sources.selectors import read_page

        return read_page(html, self.config)["picks"]

    def validate(self, picks: list[tuple]) -> None:
        """At least one pick, and no number below 1."""
        if not picks:
            raise ValueError(NO_PICKS)
        if any(p[0] <= 0 for p in picks):
            raise ValueError(BAD_NUMBER)


class DynamicParser(StaticParser):
    """Pages that a browser must build first: without one there are no picks."""

    def picks(self, html: str) -> list[tuple]:
        return []


PARSERS: dict[str, Callable[[SourceConfig], Parser]] = {"html_static": StaticParser, "html_dynamic": DynamicParser}


def build_parser(slug: str, kind: str, configs: Iterable[SourceConfig] = SOURCES) -> Parser:
    """The parser of a source; one that is not configured has the default selectors."""
    if kind not in PARSERS:
        raise ValueError(f"no parser for sources of kind {kind}")
    return PARSERS[kind](next((c for c in configs if c.slug == slug), SourceConfig(slug)))


@dataclass
class Registry:
    """Sources by slug, in order of registration."""

    sources: dict[str, SourceConfig] = field(default_factory=dict)

    def register(self, source: SourceConfig) -> None:
        self.sources[source.slug] = source

    def active(self) -> list[SourceConfig]:
        return [s for s in self.sources.values() if s.active]

    def automated(self) -> list[SourceConfig]:
        return [s for s in self.active() if s.automated]
