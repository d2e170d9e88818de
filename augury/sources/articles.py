"""From a source's pages to articles: links found, metadata and picks read, articles checked, for all pages of all sources at once."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions import text as X
from augury.sources import html, registry
from augury.sources.registry import SourceConfig
from augury.sources.selectors import FIELDS, read_page

#: A run reads so many pages of a source.
MAX_URLS = 10
_PICK = "array<struct<overall_pick:int,round_number:int,original_team:string,current_team:string,traded:boolean,player_name:string,position:string,school:string>>"
_READ = f"struct<{','.join(f'{f}:string' for f in (*FIELDS, 'page_title'))},picks:{_PICK}>"


def discovered(listings: DataFrame, configs: Iterable[SourceConfig] = registry.SOURCES) -> DataFrame:
    """source_slug, place (from 0), link: a source's page of links (source_slug, url, html), by its keyword. Sources that nothing reads by itself have none."""
    by_keyword: dict[str, list[str]] = {}
    for c in configs:
        if c.active and c.automated:
            by_keyword.setdefault(c.keyword, []).append(c.slug)
    found = [html.links(listings.filter(F.col("source_slug").isin(slugs)), "source_slug", "url", "html", keyword) for keyword, slugs in by_keyword.items()]
    if not found:
        return listings.select("source_slug", F.lit(0).alias("place"), F.col("url").alias("link")).limit(0)
    return reduce(DataFrame.unionByName, found).select("source_slug", (F.col("rank") - 1).alias("place"), "link")


def read(slug: Column, page: Column, configs: Iterable[SourceConfig] = registry.SOURCES) -> Column:
    """What a source's selectors find on a page: title, author, published, updated, page_title, picks. One pass over its tags."""
    known = {c.slug: c for c in configs}
    row = lambda p: {"overall_pick": p[0], "round_number": 1, "original_team": p[1], "current_team": p[1], "traded": False, "player_name": p[2], "position": p[3], "school": p[4]}

    def one(slug: str, page: str | None) -> dict:
        config = known.get(slug) or SourceConfig(slug or "")
        out = read_page(page, config)
        if config.parser == "html_dynamic":  # a browser must build such pages first
            out["picks"] = []
        return out | {"picks": [row(p) for p in out["picks"]]}

    def run(slugs: pd.Series, pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(s, p) for s, p in zip(slugs, pages, strict=True)], columns=[*FIELDS, "page_title", "picks"])

    return F.pandas_udf(_READ)(run)(slug, page)


def fault(picks: Column) -> Column:
    """What keeps an article out, null if nothing does."""
    return F.when(F.size(picks) == 0, registry.NO_PICKS).when(F.exists(picks, lambda p: p["overall_pick"] <= 0), registry.BAD_NUMBER)


def parsed(pages: DataFrame, year: Column, configs: Iterable[SourceConfig] = registry.SOURCES, draft_year: int | None = None) -> DataFrame:
    """source_slug, article_url, title, author, published, updated, draft_year, picks, reason of pages (source_slug, url, html), a row for each.

    The title falls back to the page's title tag, then to its address. The year is the given one, else that of
    the title, else `year`. reason is null for an article that can be taken in.
    """
    configs = list(configs)
    x = F.col("x")
    rows = pages.select("source_slug", "url", read(F.col("source_slug"), F.col("html"), configs).alias("x"))
    rows = rows.withColumn("title", F.coalesce(x["title"], x["page_title"], F.col("url")))
    own_year = F.lit(draft_year).cast("int") if draft_year else F.coalesce(X.any_year(F.col("title")), year)
    return rows.select(
        "source_slug", F.col("url").alias("article_url"), "title", x["author"].alias("author"), X.any_date(x["published"]).alias("published"), X.any_date(x["updated"]).alias("updated"),
        own_year.alias("draft_year"), x["picks"].alias("picks"), fault(x["picks"]).alias("reason"),
    )


def due(pages: DataFrame, configs: Iterable[SourceConfig] = registry.SOURCES, slugs: list[str] | None = None) -> DataFrame:
    """The pages (source_slug, url, place, html) that a run reads: the first MAX_URLS of every active source that is read by itself."""
    wanted = [c.slug for c in configs if c.active and c.automated and c.parser in registry.PARSERS and (slugs is None or c.slug in slugs)]
    return pages.filter(F.col("source_slug").isin(wanted) & (F.col("place") < MAX_URLS))
