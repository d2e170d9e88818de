"""Record files: schemas, typed reading with rejects, nested articles, generated dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.functions import text as X
from augury.sources.registry import SOURCES

OUTCOMES = "draft_year int, round_number int, overall_pick int, team_abbrev string, player_name string"
ROSTER = (
    "draft_year int, team_abbrev string, player_name string, position string, age double, experience_years double, games_played int, "
    "games_started int, snaps int, under_contract boolean, starter_flag boolean, injury_flag boolean"
)
MOCKS = (
    "source_slug string, article_url string, title string, draft_year int, published_at_iso timestamp, overall_pick int, round_number int, "
    "team_abbrev string, player_name string, position string, school string"
)
MANUAL = "round_number int, overall_pick int, original_team string, current_team string, traded boolean, player_name string, position string, school string"
ORDER = "overall_pick int, round_number int, team_abbreviation string"
UPSTREAM = "season int, team string, round int, pick int, pfr_name string"


def typed(raw: DataFrame, schema: str) -> DataFrame:
    """All-string columns cast to the schema; blank is null, and a boolean has three states."""
    fields = T._parse_datatype_string(schema).fields
    cast = lambda f: X.flag(F.col(f.name)) if isinstance(f.dataType, T.BooleanType) else F.nullif(F.trim(F.col(f.name)), F.lit("")).try_cast(f.dataType)
    return raw.select(*[cast(f).alias(f.name) for f in fields])


def header_of(raw: DataFrame, required: list[str]) -> DataFrame:
    """raw, after a check that it has all required columns."""
    if missing := sorted(set(required) - set(raw.columns)):
        raise ValueError(f"the file has no column {', '.join(missing)}")
    return raw


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every value as text; a byte order mark is dropped."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file read as text in the schema's columns, then cast; missing columns are null."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    raw = read_text(spark, path)
    missing = [F.lit(None).cast("string").alias(n) for n in names if n not in raw.columns]
    return typed(raw.select("*", *missing), schema)


def manual_picks(raw: DataFrame) -> DataFrame:
    """Picks of a manual mock, all text: blank teams, positions and schools are null, traded is whether it reads true."""
    spoken = F.coalesce(F.lower("traded") == "true", F.lit(False)) if "traded" in raw.columns else F.lit(False)
    return typed(raw.withColumn("traded", spoken.cast("string")), MANUAL)


def past_outcomes(raw: DataFrame, min_year: int | None = None, max_year: int | None = None) -> DataFrame:
    """Outcomes of past seasons in the columns of OUTCOMES: rows that can't be read are left out, codes are today's."""
    rows = typed(header_of(raw, ["season", "team", "round", "pick", "pfr_name"]), UPSTREAM).dropna(subset=["season", "team", "round", "pick", "pfr_name"])
    rows = rows.filter(F.col("season").between(min_year if min_year is not None else -(1 << 31), max_year if max_year is not None else (1 << 31) - 1))
    return rows.select(
        F.col("season").alias("draft_year"), F.col("round").alias("round_number"), F.col("pick").alias("overall_pick"),
        X.current_code(F.col("team"), F.col("season")).alias("team_abbrev"), F.col("pfr_name").alias("player_name"),
    )


def draft_order(raw: DataFrame, teams: DataFrame) -> DataFrame:
    """slot, round (1 if it has none), team_id of an order's rows; unknown teams are left out, of several rows with a slot the last counts."""
    rows = typed(header_of(raw, ["overall_pick", "team_abbreviation"]).withColumn("round_number", F.col("round_number") if "round_number" in raw.columns else F.lit(None).cast("string")), ORDER)
    rows = rows.withColumn("at", F.monotonically_increasing_id()).join(teams.select(F.col("code"), "team_id"), F.upper("team_abbreviation") == F.col("code"))
    last = rows.groupBy(F.col("overall_pick").alias("slot")).agg(F.max_by(F.struct(F.coalesce(F.nullif("round_number", F.lit(0)), F.lit(1)).alias("round"), "team_id"), "at").alias("x"))
    return last.filter("slot IS NOT NULL").select("slot", "x.round", "x.team_id")


def split_rejects(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all required values, the others)"""
    bad = F.greatest(*[F.col(c).isNull() for c in required]) if len(required) > 1 else F.col(required[0]).isNull()
    return rows.filter(~bad), rows.filter(bad)


def audit(good: DataFrame, bad: DataFrame, year: str) -> DataFrame:
    """One row about a batch: years, inserted, failed, status."""
    g = good.agg(F.min(year).alias("min_year"), F.max(year).alias("max_year"), F.count(F.lit(1)).alias("inserted"))
    out = g.join(F.broadcast(bad.agg(F.count(F.lit(1)).alias("failed"))), how="cross")  # one row each
    return out.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("inserted") > 0, "partial").otherwise("failed"))


def nest_articles(rows: DataFrame, key: list[str], pick: list[str]) -> DataFrame:
    """One row per article with its picks in order."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*pick))).alias("picks"))


def checked_articles(nested: DataFrame, slugs: DataFrame, years: DataFrame) -> DataFrame:
    """A dry run: each nested article (source_slug, draft_year, picks) with what would keep it out, null if nothing would."""
    known = nested.join(slugs.select("source_slug", F.lit(True).alias("__s")), "source_slug", "left").join(years.select("draft_year", F.lit(True).alias("__y")), "draft_year", "left")
    low = F.exists("picks", lambda p: F.coalesce(p["overall_pick"], F.lit(0)) <= 0)
    fault = F.when(F.col("__s").isNull(), "unknown source").when(F.col("__y").isNull(), "unknown year").when(F.size("picks") == 0, "no picks").when(low, "invalid pick")
    return known.withColumn("fault", fault).drop("__s", "__y")


def calendar(spark: SparkSession, first: int = 1980, last: int = 2030) -> DataFrame:
    year = F.col("id").cast("int")
    return spark.range(first, last + 1).select(year.alias("year"), F.make_date(year - 1, F.lit(8), F.lit(1)).alias("start_date"), F.make_date(year, F.lit(4), F.lit(25)).alias("draft_date"))


def seeded_score(name: Column, low: float, high: float) -> Column:
    """low to high by the sum of the name's character codes, modulo 100."""
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    seed = F.aggregate(letters, F.lit(0), lambda a, c: a + F.ascii(c))
    return low + (seed % 100) / 100.0 * (high - low)


def baseline_need(team_seed: Column, index: Column, first_slot: Column) -> Column:
    """A need from a seed and the position's place in its list, raised for a team with an early slot; none without one."""
    base = F.greatest(F.lit(0.2), F.least(F.lit(0.95), 0.2 + F.pmod(team_seed + 11 * index, F.lit(100)) / 100.0 * 0.75))
    boost = F.coalesce(F.greatest(F.lit(0), 16 - F.least(F.lit(16), first_slot)) / 40.0, F.lit(0.0))
    return F.greatest(F.lit(0.2), F.least(F.lit(0.98), base + boost))


def board_need(index: Column, matched: Column) -> dict[str, Column]:
    """Needs by the position's place in its list; the position that the board gives the team is wanted most."""
    base = F.when(matched, 0.95).otherwise(0.35 + 0.07 * (index % 5))
    return {"short_term": F.round(base, 4), "long_term": F.round(F.greatest(F.lit(0.2), base - 0.1), 4), "overall": F.round(base, 4)}


def sources(spark: SparkSession) -> DataFrame:
    """The source dimension."""
    rows = [(s.slug, s.weight, s.tau_days, s.kind, s.parser, s.active, s.automated) for s in SOURCES]
    return spark.createDataFrame(rows, "slug string, weight double, tau_days double, kind string, parser string, active boolean, automated boolean")
