"""Articles from a stream of pages, each batch taken in exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from augury.operators import ingest
from augury.operators.stored import Store
from augury.sources import articles

PAGES = "source_slug string, url string, place int, html string"
#: The tables of the store: articles, picks, pages that were not taken in, and an audit row for each source and batch.
ARTICLES = "source_slug string, article_url string, content_hash string, title string, author string, published timestamp, updated timestamp, draft_year int"
PICKS = (
    "source_slug string, article_url string, content_hash string, draft_year int, place int, overall_pick int, round_number int, original_team_id bigint, current_team_id bigint, "
    "traded boolean, raw_player_name string, player string, position string, school string"
)
BATCHES = "pages"


def keep_articles(stream: DataFrame, path: str, checkpoint: str, sources: DataFrame, cycles: DataFrame, teams: DataFrame, year: Column, grace_s: float = 86_400) -> StreamingQuery:
    """Reads a stream of pages and takes their articles into a store.

    A batch is one version: its articles, picks, rejected pages and audit rows appear together, and a batch
    that died or is run again leaves the same tables. The pages of a batch are parsed once, into a
    folder that no version names. While a batch holds no article that is stored already, rows are only added.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, path)
        base = store.manifest()
        if n <= base["batches"].get(BATCHES, -1):
            return
        due = articles.due(batch)
        parsed = store.staged(articles.parsed(due.select("source_slug", "url", "html"), year))
        stored = {t: store.read(t, schema=s, manifest=base) for t, s in (("articles", ARTICLES), ("picks", PICKS))}
        new, again, rejected = ingest.sorted_out(parsed.filter("reason IS NULL").drop("reason"), stored["articles"], sources, cycles)
        known = teams.withColumn("team_id", F.col("team_id").cast("bigint"))
        fresh = {"articles": new.select(*stored["articles"].columns), "picks": ingest.picks_of(new, known).select(*stored["picks"].columns)}
        faults = parsed.filter("reason IS NOT NULL").select("source_slug", "article_url", "draft_year", "reason").unionByName(rejected)
        by_page = faults.groupBy("source_slug", F.col("article_url").alias("url")).agg(F.min("reason").alias("fault"))
        seen = batch.select("source_slug", "url", "place").join(due.select("source_slug", "url", "place", F.lit(True).alias("read")), ["source_slug", "url", "place"], "left")
        number = F.lit(n).cast("long").alias("batch")
        more = {"rejected": faults.select("*", number), "audit": ingest.job_audit(seen.join(by_page, ["source_slug", "url"], "left"), sources).select("*", number)}
        if again.isEmpty():
            store.commit(append=fresh | more, batch=(BATCHES, n), base=base)
        else:
            whole = {"picks": ingest.with_teams_of(stored["picks"], again, known).unionByName(fresh["picks"])}
            store.commit(replace=whole, append={"articles": fresh["articles"]} | more, batch=(BATCHES, n), base=base)
            store.vacuum(grace_s)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
