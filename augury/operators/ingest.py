"""Articles into stored tables: team labels to keys, idempotent by content, jobs with an audit row.

Parsed articles: source_slug, article_url, title, draft_year, published, picks, an array of
(overall_pick, round_number, original_team, current_team, traded, player_name, position, school).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions import text as X
from augury.functions.teams import team_aliases
from augury.operators.consensus import held
from augury.sources.articles import MAX_URLS

#: No alias has more words.
ALIAS_WORDS = max(len(a.split(" ")) for a in team_aliases())


def aliases(rows: DataFrame) -> DataFrame:
    """alias, code, place: the fixed list of labels, as a table of about a hundred rows."""
    return rows.sparkSession.createDataFrame([(a, c, k) for k, (a, c) in enumerate(team_aliases().items())], "alias string, code string, place int")


def longest_alias(labels: DataFrame, key: str) -> DataFrame:
    """key and the code of the longest alias that stands in it as whole words.

    A run of words is looked up by equality, so this is a hash join with the list of aliases, not a
    comparison of every label with every alias. Of two aliases of one length the first in the list counts.
    """
    words = F.split(F.col(key), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(ALIAS_WORDS)), lambda n: F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, n), " "))))
    found = labels.select(key, F.explode(F.array_distinct(runs)).alias("alias")).join(F.broadcast(aliases(labels)), "alias")
    return found.groupBy(key).agg(F.min_by("code", F.struct(-F.length("alias"), F.col("place"))).alias("code"))


#: So many distinct labels are looked up without shuffling the rows.
FEW_LABELS = 200_000


def resolve_teams(rows: DataFrame, labels: str | dict[str, str], teams: DataFrame, out: str = "team_id") -> DataFrame:
    """rows with the keys of the teams that their labels name, null where none does. labels: a column, or columns and the names of their keys.

    Steps, the first that hits counts: the label's code, its slug, the longest alias in it, a
    team's full name, a city of one team. Each distinct label is resolved once, whatever column it is in. The
    resolved labels are rows of the plan if they are very few, so that what gave them is computed once, and broadcast if counting
    shows that they are few; else rows without a label go past the join, and no shuffle gathers them. teams (team_id, code, name, city) is a dimension of a few dozen rows.
    """
    named = {labels: out} if isinstance(labels, str) else labels
    every = rows.select(F.explode(F.array_distinct(F.array(*[F.col(c) for c in named]))).alias("label"))
    found = held(_resolved(every.filter(F.trim(F.coalesce("label", F.lit(""))) != "").distinct(), teams))
    few = found.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    for label, key in named.items():
        of = found.select(F.col("label").alias("__label"), F.col("team").alias(key))
        on = F.col(label) == F.col("__label")
        if few:
            rows = rows.join(F.broadcast(of), on, "left").drop("__label")
        else:
            blank = F.trim(F.coalesce(F.col(label), F.lit(""))) == ""
            team = next(f for f in of.schema if f.name == key).dataType
            rows = rows.filter(~blank).join(of, on, "left").drop("__label").unionByName(rows.filter(blank).withColumn(key, F.lit(None).cast(team)))
    return rows


def _resolved(labels: DataFrame, teams: DataFrame) -> DataFrame:
    """label, team of distinct labels."""
    code = X.team_code(F.col("label"), team_aliases())
    labels = labels.select("label", X.code8(code).alias("code"), X.code8(X.slug(code)).alias("slug"), X.normalize(F.col("label")).alias("key"))
    cities = teams.groupBy(F.lower("city").alias("city")).agg(F.min("team_id").alias("by_city"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    dim = lambda name, value: F.broadcast(teams.select(value.alias(name), F.col("team_id").alias(f"by_{name}")).groupBy(name).agg(F.min(f"by_{name}").alias(f"by_{name}")))
    alias = longest_alias(labels.select("key").distinct(), "key").withColumnRenamed("code", "alias")
    found = labels.join(alias, "key", "left")
    for name, value in (("code", F.col("code")), ("slug", F.col("code")), ("alias", F.col("code")), ("key", F.lower("name"))):
        found = found.join(dim(name, value), name, "left")
    found = found.join(F.broadcast(cities), found["key"] == cities["city"], "left")
    return found.select("label", F.coalesce("by_code", "by_slug", "by_alias", "by_key", "by_city").alias("team"))


def with_key(articles: DataFrame) -> DataFrame:
    """Articles with content_hash, of the address, the title and the number of picks."""
    return articles.withColumn("content_hash", X.content_hash(F.col("article_url"), F.coalesce("title", F.lit("")), F.size("picks").cast("string")))


KEY = ["source_slug", "article_url", "content_hash"]


def picks_of(articles: DataFrame, teams: DataFrame, *more: str) -> DataFrame:
    """One row per pick of the articles, with both teams' keys and normalised labels, and with more of the articles' columns."""
    rows = articles.select(*KEY, *more, "draft_year", F.posexplode("picks").alias("place", "p")).select(*KEY, *more, "draft_year", "place", "p.*")
    rows = resolve_teams(rows, {"original_team": "original_team_id", "current_team": "current_team_id"}, teams)
    return rows.select(
        *KEY, *more, "draft_year", "place", "overall_pick", "round_number", "original_team_id", "current_team_id", "traded",
        F.col("player_name").alias("raw_player_name"), X.normalize(F.col("player_name")).alias("player"),
        X.position(F.col("position")).alias("position"), X.school(F.col("school")).alias("school"),
    )


def sorted_out(parsed: DataFrame, stored_articles: DataFrame, sources: DataFrame, cycles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles that are not stored yet, those that are, rejected ones with their reason), each key once.

    An article with an unknown source or year is rejected. Of articles of one key in one batch the
    latest published counts, of those the one whose picks, title and year come last in their order.
    """
    keyed = with_key(parsed).join(F.broadcast(sources.select(F.col("slug").alias("source_slug"), F.lit(True).alias("__source"))), "source_slug", "left")
    keyed = keyed.join(F.broadcast(cycles.select(F.col("year").alias("draft_year"), F.lit(True).alias("__cycle"))), "draft_year", "left")
    known = F.col("__source").isNotNull() & F.col("__cycle").isNotNull()
    rejected = keyed.filter(~known).select("source_slug", "article_url", "draft_year", F.when(F.col("__source").isNull(), "unknown source").otherwise("unknown year").alias("reason"))
    whole = keyed.filter(known).drop("__source", "__cycle")
    order, columns = ["published", "picks", "title", "draft_year"], [c for c in whole.columns if c not in KEY]
    # The order comes first in what is kept, so that picks are shuffled once for each article, not as a value and as an order.
    last = F.max(F.struct(*order, *[c for c in columns if c not in order]))
    taken = whole.groupBy(*KEY).agg(last.alias("__a")).select(*KEY, *[F.col(f"__a.{c}") for c in columns])
    stored = stored_articles.select(*KEY)
    return taken.join(stored, KEY, "left_anti"), taken.join(stored, KEY, "left_semi"), rejected


def with_teams_of(stored_picks: DataFrame, again: DataFrame, teams: DataFrame) -> DataFrame:
    """The stored picks, with the teams of those of known articles resolved anew, by slot, the first pick of a slot counting."""
    return _with_teams(stored_picks, picks_of(again, teams))


def _with_teams(stored_picks: DataFrame, again: DataFrame) -> DataFrame:
    fresh = again.groupBy(*KEY, "overall_pick").agg(F.min_by(F.struct("original_team_id", "current_team_id"), "place").alias("x"))
    kept = stored_picks.join(fresh, [*KEY, "overall_pick"], "left")
    now = lambda c: F.when(F.col("x").isNull(), F.col(c)).otherwise(F.col("x")[c]).alias(c)
    return kept.select(*[now(c) if c in ("original_team_id", "current_team_id") else F.col(c) for c in stored_picks.columns])


def ingest(parsed: DataFrame, stored_articles: DataFrame, stored_picks: DataFrame, sources: DataFrame, cycles: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, picks, rejected) after the parsed articles were taken in; running it again changes nothing.

    A known article (same source, address and content) is not stored twice; the teams of its
    stored picks are resolved anew from the parsed ones. See sorted_out for what is rejected.
    """
    new, again, rejected = sorted_out(parsed, stored_articles, sources, cycles)
    articles = stored_articles.unionByName(new.select(*stored_articles.columns))
    # Labels of new and of known articles are resolved together, so that the articles are gone through once for them.
    both = new.withColumn("__new", F.lit(True)).unionByName(again.withColumn("__new", F.lit(False)))
    fresh = picks_of(both, teams, "__new")
    picks = _with_teams(stored_picks, fresh.filter("NOT __new")).unionByName(fresh.filter("__new").select(*stored_picks.columns))
    return articles, picks, rejected


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a table as they are."""
    df.write.mode("append").parquet(path)


def once_per_player(rows: DataFrame, key: list[str], version: Column) -> DataFrame:
    """Of rows taken in more than once the latest, so that a second import does not double any sum."""
    w = Window.partitionBy(*key).orderBy(version.desc())
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def job_audit(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: discovered, fetched, parsed, errors, status.

    pages: source_slug, place (from 0, in order of discovery), fault (null if the page was read and its
    article taken in), and whether it was read, by default if it is one of the first MAX_URLS. A page that was not
    read is neither parsed nor an error. Sources that nothing reads by itself are skipped.
    """
    read = F.coalesce(F.col("read"), F.lit(False)) if "read" in pages.columns else F.col("place") < MAX_URLS
    n = pages.groupBy("source_slug").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(read & F.col("fault").isNull()).alias("parsed"),
        F.count_if(read & F.col("fault").isNotNull()).alias("errors"),
    )
    rows = sources.select(F.col("slug").alias("source_slug"), "parser").join(n, "source_slug", "left").fillna(0, ["discovered", "parsed", "errors"])
    skipped = F.col("parser").isin("rss", "manual_upload")
    status = F.when(skipped, "skipped").when(F.col("errors") == 0, "success").when(F.col("parsed") > 0, "partial").otherwise("failed")
    count = lambda c: F.when(skipped, 0).otherwise(F.col(c))
    return rows.select("source_slug", count("discovered").alias("discovered"), count("parsed").alias("fetched"), count("parsed").alias("parsed"), count("errors").alias("errors"), status.alias("status"))
