"""A stream of pages against the same pages taken in at once, with batches that die and are run again."""

import pytest
from pyspark.sql import functions as F

from augury.functions.teams import teams
from augury.operators import ingest
from augury.operators.stored import Files, Store
from augury.sources import articles, records
from augury.streaming import intake, outcomes


def page(slug, url, title, team="Jets", n=8, place=0):
    items = "".join(f"<li>{k}. {team} - Al Poe-{chr(96 + k)}, QB</li>" for k in range(1, n + 1))
    return (slug, url, place, f"<h1>{title}</h1><ol>{items}</ol>")


BATCHES = [
    [page("espn", "u1", "Mock 2026"), page("yahoo", "u1", "Mock 2026", "49ers"), ("espn", "u2", 1, "<p>nothing</p>"), page("manual", "u3", "Mock 2026")],
    [page("espn", "u4", "Mock 2099", place=2), page("espn", "u5", "Mock 2025", "Nobody", place=3), page("espn", "far", "Mock 2025", place=10)],
    [page("espn", "u1", "Mock 2026", "Bears"), page("espn", "u5", "Mock 2025", "Rams"), page("pfn", "u6", "Mock 2026")],  # known ones, with other teams
    [page("nobody", "u7", "Mock 2026")],
]


def rows(df, *drop):
    return sorted((tuple(r) for r in df.drop(*drop).collect()), key=str)


def test_a_stream_of_pages_equals_one_run(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    sources, cycles, dim = records.sources(spark), records.calendar(spark), teams(spark)
    year = F.lit(2026)

    def start():
        stream = outcomes.read_files(spark, source, intake.PAGES, 100)
        return intake.keep_articles(stream, path, str(tmp_path / "cp"), sources, cycles, dim, year, grace_s=0)

    stored = [spark.createDataFrame([], intake.ARTICLES), spark.createDataFrame([], intake.PICKS)]
    for n, batch in enumerate(BATCHES):
        pages = spark.createDataFrame(batch, intake.PAGES)
        pages.coalesce(1).write.mode("append").parquet(source)
        with monkeypatch.context() as m:  # each batch dies once: while it writes, or before its manifest
            if n % 2:
                m.setattr(Files, "appear", lambda *a: 1 / 0)
            else:
                write, calls = Store.write, []

                def dies(self, df, by=None):
                    calls.append(1)
                    return 1 / 0 if len(calls) > 2 else write(self, df, by)

                m.setattr(Store, "write", dies)
            with pytest.raises(Exception, match="division"):
                start().awaitTermination()
        assert Store(spark, path).versions()[-1:] == ([n] if n else [])
        start().awaitTermination()
        start().awaitTermination()
        parsed = articles.parsed(articles.due(pages).select("source_slug", "url", "html"), year).filter("reason IS NULL").drop("reason")
        a, p, _ = ingest.ingest(parsed, *stored, sources, cycles, dim)
        stored = [spark.createDataFrame(a.collect(), a.schema), spark.createDataFrame(p.collect(), p.schema)]
        store = Store(spark, path)
        assert rows(store.read("articles")) == rows(stored[0].select(store.read("articles").columns))
        assert rows(store.read("picks")) == rows(stored[1].select(store.read("picks").columns))
    assert {r.article_url for r in store.read("articles").collect()} == {"u1", "u5", "u6"} and store.read("picks").count() == 8 * 4
    rejected = {(r.article_url, r.reason, r.batch) for r in store.read("rejected").collect()}
    assert rejected == {("u2", "no picks were found", 0), ("u4", "unknown year", 1)}
    audit = {(r.batch, r.source_slug): (r.discovered, r.parsed, r.errors, r.status) for r in store.read("audit").collect()}
    assert audit[0, "espn"] == (2, 1, 1, "partial") and audit[1, "espn"] == (3, 1, 1, "partial") and audit[0, "manual"][3] == "skipped"
    assert audit[2, "pfn"] == (1, 1, 0, "success") and audit[3, "espn"] == (0, 0, 0, "success") and (3, "nobody") not in audit


def test_pages_that_are_not_read_count_as_nothing(spark):
    seen = spark.createDataFrame([("espn", 0, None, True), ("espn", 1, "no picks", True), ("espn", 2, None, None), ("yahoo", 0, None, None)], "source_slug string, place int, fault string, read boolean")
    sources = spark.createDataFrame([("espn", "html_static"), ("yahoo", "html_static")], "slug string, parser string")
    got = {r.source_slug: (r.discovered, r.fetched, r.parsed, r.errors, r.status) for r in ingest.job_audit(seen, sources).collect()}
    assert got == {"espn": (3, 1, 1, 1, "partial"), "yahoo": (1, 0, 0, 0, "success")}


def test_which_of_equal_articles_counts(spark):
    picks = lambda name: [(1, 1, "Jets", "Jets", False, name, "QB", None)]
    made = [("espn", "u", "T", 2026, None, picks("Early")), ("espn", "u", "T", 2026, "2026-01-02", picks("Ann")), ("espn", "u", "T", 2026, "2026-01-02", picks("Bob"))]
    schema = f"source_slug string, article_url string, title string, draft_year int, published string, picks {articles._PICK}"
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        parsed = spark.createDataFrame([made[k] for k in order], schema).withColumn("published", F.col("published").cast("timestamp"))
        stored = spark.createDataFrame([], "source_slug string, article_url string, content_hash string")
        new, again, _ = ingest.sorted_out(parsed, stored, records.sources(spark), records.calendar(spark))
        assert [r.picks[0].player_name for r in new.collect()] == ["Bob"] and again.isEmpty()


def test_labels_beyond_the_few_are_joined_without_the_blank_ones(spark, monkeypatch):
    labels = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate([("Jets", None), (None, "49ers"), ("", "  "), ("Nobody", "Jets"), ("49ers", "49ers")])], "id int, a string, b string")
    named = {"a": "x", "b": "y"}
    few = rows(ingest.resolve_teams(labels, named, teams(spark)))
    monkeypatch.setattr(ingest, "FEW_LABELS", 1)
    many = ingest.resolve_teams(labels, named, teams(spark))
    assert rows(many.select("id", "a", "b", "x", "y")) == few and [r[3:] for r in few][0][0] is not None
