"""The engine's front door: every answer as a DataFrame over stored tables, arguments checked first.

A Board reads named tables (a folder of Parquet, or any DataFrames): votes, outcomes, order, roster,
needs, candidates, org. Each method answers for all slots, teams or candidates at once unless it
is given one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions import scores as S
from augury.functions import text as X
from augury.functions.teams import team_aliases
from augury.operators import backtest, candidates, consensus, ingest, models, needs, org, probs, upserts
from augury.operators.stored import Store
from augury.sources import articles, registry


#: A team's view lists so many candidates.
PROFILE_CANDIDATES = 12


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")
    return value


class Board:
    """tables by name; registry, if given, is where trained models and their runs are kept.

    Methods that take something in replace the board's table and return it; the caller stores it.
    """

    def __init__(self, tables: dict[str, DataFrame], as_of: Column, registry: models.Registry | None = None):
        self._tables, self.as_of, self.registry = dict(tables), as_of, registry

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise KeyError(f"this board has no table {name}")
        return self._tables[name]

    def _put(self, name: str, table: DataFrame) -> DataFrame:
        self._tables[name] = table
        return table

    def pick_consensus(self, slot: int | None = None, top_n: int = 5, board_aware: bool = False) -> DataFrame:
        """With board_aware also whether anybody was taken before the slot, and how many votes that leaves out."""
        votes = self["votes"] if slot is None else self["votes"].filter(F.col("slot") == _within("slot", slot, 1, 400))
        every = votes
        if board_aware:
            votes = consensus.open_votes(votes, self["outcomes"])
        out = consensus.consensus(votes, self.as_of, _within("top_n", top_n, 1, 50)).join(consensus.confidence(votes), "slot")
        if board_aware:
            return out.join(consensus.excluded(every, self["outcomes"]), "slot")
        return out.withColumns({"board_aware": F.lit(False), "excluded": F.lit(None).cast("long")})

    def ingest(self, parsed: DataFrame) -> DataFrame:
        """Takes parsed articles in (see operators.ingest); the rejected ones with their reasons."""
        articles, picks, rejected = ingest.ingest(parsed, self["articles"], self["picks"], self["sources"], self["cycles"], self["teams"])
        self._put("articles", articles)
        self._put("picks", picks)
        return rejected

    def ingest_pages(self, pages: DataFrame, slug: str, draft_year: int | None = None) -> DataFrame:
        """Reads pages (url, html) of a source and takes their articles in; pages with a fault and the rejected ones with their reasons."""
        config = next((c for c in registry.SOURCES if c.slug == slug), registry.SourceConfig(slug))
        registry.build_parser(slug, config.parser)
        return self._take(pages.select(F.lit(slug).alias("source_slug"), "url", "html"), draft_year)

    def _take(self, pages: DataFrame, draft_year: int | None = None) -> DataFrame:
        """Takes pages (source_slug, url, html) of any sources in at once: source_slug, article_url, draft_year, reason of those that were not."""
        rows = articles.parsed(pages, F.year(self.as_of.cast("timestamp")), draft_year=draft_year)
        rejected = self.ingest(rows.filter("reason IS NULL").drop("reason"))
        return rows.filter("reason IS NOT NULL").select("source_slug", "article_url", "draft_year", "reason").unionByName(rejected)

    def run_ingestion(self, pages: DataFrame, slugs: list[str] | None = None) -> DataFrame:
        """Takes in the first pages (source_slug, url, place, html) of every automated source, all sources at once; one audit row per source.

        Pages of other sources, and those beyond the first, are discovered but not read.
        """
        due = articles.due(pages, slugs=slugs)
        faults = self._take(due.select("source_slug", "url", "html")).groupBy("source_slug", F.col("article_url").alias("url")).agg(F.min("reason").alias("fault"))
        known = self["sources"] if slugs is None else self["sources"].filter(F.col("slug").isin(slugs))
        seen = pages.select("source_slug", "url", "place").join(due.select("source_slug", "url", "place", F.lit(True).alias("read")), ["source_slug", "url", "place"], "left")
        return ingest.job_audit(seen.join(faults, ["source_slug", "url"], "left"), known)

    def add_outcome(self, slot: int, name: str, round_number: int = 1, team: str | None = None) -> DataFrame:
        """Adds an outcome as it is; a later one for the slot does not remove it, the latest counts where one is needed."""
        old = self["outcomes"]
        at = old.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        row = old.sparkSession.range(1).select(
            F.lit(_within("slot", slot, 1, 400)).alias("slot"), X.normalize(F.lit(name)).alias("cand"), F.lit(team).cast("string").alias("team"),
            F.lit(round_number).alias("round"), F.lit(at).alias("id"),
        )
        return self._put("outcomes", old.unionByName(row))

    def put_order(self, picks: DataFrame) -> DataFrame:
        """Puts slots (slot, round, team) into the order, by slot; refuses teams that the board does not know.

        Of several rows for a slot the last one counts, by the column `at` if there is one, else by their order in the input.
        """
        known = self["teams"].select(F.col("code").alias("team"))
        at = F.col("at") if "at" in picks.columns else F.monotonically_increasing_id()
        new = picks.select("slot", "round", F.upper("team").alias("team"), at.alias("__at"))
        if unknown := [r.team for r in new.select("team").distinct().join(known, "team", "left_anti").orderBy("team").limit(10).collect()]:
            raise ValueError(f"unknown teams: {', '.join(unknown)}")
        columns = self["order"].columns
        last = upserts.keep_latest(new, ["slot"], [F.desc("__at")]).select(*columns)
        return self._put("order", self["order"].join(last.select("slot"), "slot", "left_anti").unionByName(last))

    def model_metadata(self) -> DataFrame:
        """The newest run of each family of models."""
        if self.registry is None:
            raise KeyError("this board has no registry")
        return self.registry.metadata()

    def landing_spots(self, name: str | None = None, top_n: int = 5, context_slot: int | None = None) -> DataFrame:
        votes = self["votes"]
        if name is not None:
            votes = votes.filter(F.col("cand") == F.coalesce(F.nullif(X.normalize(F.lit(name)), F.lit("")), F.lower(F.trim(F.lit(name)))))
        if context_slot is not None:
            votes = consensus.context_rows(votes, _within("context_slot", context_slot, 1, 400))
        return consensus.landing(votes, _within("top_n", top_n, 1, 50))

    def live_board(self, max_slot: int = 257) -> DataFrame:
        return consensus.live_board(self["votes"], self["outcomes"], self["order"], self.as_of, _within("max_slot", max_slot, 1, 400))

    def source_backtest(self) -> DataFrame:
        return backtest.source_backtest(self["votes"], self["outcomes"]).orderBy(F.desc("weighted_accuracy_score"), "source")

    def next_slots(self, last: int = 32) -> DataFrame:
        """Each team's first open slot up to `last`, else its first one."""
        order = self["order"]
        free = order.filter(F.col("slot") <= last).join(self["outcomes"].select("slot"), "slot", "left_anti").groupBy("team").agg(F.min("slot").alias("open"))
        first = order.groupBy("team").agg(F.min("slot").alias("first"))
        return first.join(free, "team", "left").select("team", F.coalesce("open", "first").alias("next_slot"), F.col("open").isNotNull().alias("is_open"))

    def team_needs(self, n: int = 5) -> DataFrame:
        return needs.top_needs(needs.adjusted(self["needs"], self["roster"]), n=_within("n", n, 1, 50))

    def _model(self, family: str):
        return self.registry.model(family) if self.registry is not None else None

    def position_vectors(self, slot: int = 1) -> DataFrame:
        """Per team a vector over positions, guarded: the trained model's, or the default one around the top need without a model."""
        top = needs.top_position(needs.adjusted(self["needs"], self["roster"])).withColumnsRenamed({"top_position": "top"})
        if trained := self._model("position_model"):
            context = top.select(
                "team", F.col("top").alias("top_need_position"), F.col("top_need").alias("need_score"), F.lit(0.0).alias("board_scarcity_score"),
                F.lit(0.0).alias("best_available_player_score"), F.lit(_within("slot", slot, 1, 400)).alias("overall_pick"), F.lit(1).alias("round_number"),
            )
            vectors = models.position_vectors(trained[0], context, ["team"])
        else:
            vectors = probs.default_vector(top, ["team"], "top")
        return probs.guard(vectors, top, ["team"])

    def _prospects(self) -> DataFrame:
        """The table of prospects, or the candidates as such: they have no other ranks."""
        if "prospects" in self._tables:
            return self["prospects"]
        more = {"big_board_rank": "long", "positional_rank": "int", "market": "double"}
        rows = self["candidates"].withColumnRenamed("prospect", "production")
        return rows.withColumns({n: F.lit(None).cast(t) for n, t in more.items() if n not in rows.columns})

    def _taken(self, board_aware: bool) -> DataFrame:
        return self["outcomes"].filter(F.lit(board_aware)).select("slot", F.col("cand").alias("name"))

    def candidate_lists(self, slot: int | None = None, board_aware: bool = False, given: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """The candidates of a slot, or of all slots of the order; see candidates.board_lists."""
        order = self["order"].select("slot")
        slots = order if slot is None else order.sparkSession.range(1).select(F.lit(_within("slot", slot, 1, 400)).alias("slot"))
        return candidates.board_lists(self._prospects(), self._taken(board_aware), slots, given, limit)

    def player_probabilities(self, slot: int = 1, board_aware: bool = False, given: DataFrame | None = None) -> DataFrame:
        """A slot's candidates per team, by the trained model or by the heuristic without one.

        They are the first by rank, as many as the slot's rule allows, or those given (name, position,
        prospect, star, consensus_rank). With board_aware nobody is among them who was taken before
        the slot; if that leaves nobody, they are those of an empty board.
        """
        return self._scored(self.candidate_lists(slot, board_aware, given))

    def _scored(self, lists: DataFrame) -> DataFrame:
        adjusted = needs.adjusted(self["needs"], self["roster"]).select("team", "position", F.col("adjusted").alias("need"))
        rows = candidates.score(candidates.features_by_slot(lists, adjusted), F.lit(0.0))
        if trained := self._model("player_model"):
            named = rows.withColumnsRenamed({"team_need": "team_need_score", "prospect": "prospect_score", "star": "superstar_potential_score", "gap_best": "rank_gap_from_best_available", "gap_position": "rank_gap_within_position", "need_vs_bpa": "need_vs_bpa_gap"})
            asked = named.drop("probability").withColumns({"positional_scarcity_score": F.lit(0.0), "consensus_rank": F.col("consensus_rank").cast("int")})
            key = ["slot", "team", "best_available_rank"]
            scored = models.player_probability(trained[0], asked).select(*key, F.col("probability_selected").alias("__p"))
            rows = rows.join(scored, key).withColumn("probability", F.col("__p")).drop("__p")
            rows = rows.withColumn("override", S.override(F.col("team_need"), F.col("talent"), F.col("probability")))
        return consensus.ranked(rows, ["slot", "team"], [F.round("probability", 9).desc(), F.col("best_available_rank")])

    def keep_features(self, store: Store, year: int, slot: int | None = None, board_aware: bool = False) -> DataFrame:
        """Scores the candidates of a slot, or of all slots of the order, and keeps what they were scored by; the year's rows of the store."""
        candidates.keep_features(store, self._scored(self.candidate_lists(slot, board_aware)), year)
        return store.read(candidates.FEATURES).filter(F.col("year") == year)

    def pick_contexts(self, board_aware: bool = False) -> DataFrame:
        """The context of every pick of the order; see candidates.pick_context."""
        need = needs.adjusted(self["needs"], self["roster"]).select("team", "position", F.col("adjusted").alias("need"))
        return candidates.pick_context(self["order"], need, self.candidate_lists(board_aware=board_aware))

    def compare_with_consensus(self, slot: int, board_aware: bool = False, given: DataFrame | None = None) -> DataFrame:
        """Per team the model's and the consensus' first five names of a slot, how far they disagree, and what stands behind the model's first.

        Both lists are normalised. The grouped components are those of the explanation, which knows
        neither a need nor a best score: they are 0, as is the scarcity of a board without context.
        """
        ranked = self.player_probabilities(slot, board_aware, given)
        model = ranked.filter("rank <= 5").withColumn("key", X.normalize(F.col("name")))
        a = candidates.name_list(model, "team", "key", "rank", "model")
        votes = self.pick_consensus(slot, board_aware=board_aware).withColumn("key", X.normalize(F.col("cand")))
        b = F.broadcast(candidates.name_list(votes, "slot", "key", "rank", "consensus").groupBy().agg(F.first("consensus").alias("consensus")))  # one row, also of no votes
        first = ranked.filter("rank = 1").select("team", F.col("name").alias("top_player"), F.col("override").alias("top_override"))
        both = a.join(b, how="cross").withColumn("consensus", F.coalesce("consensus", F.array().cast("array<string>"))).join(first, "team")
        out = {n: c for n, c in candidates.compare(F.col("model"), F.col("consensus")).items()} | S.grouped_explanation(F.lit(0.0), F.lit(0.0), F.lit(0.0))
        return both.select("team", "model", "consensus", F.size(out["common"]).alias("agreement"), *[c.alias(n) for n, c in out.items()], "top_player", "top_override")

    def org_profile(self) -> DataFrame:
        org = self["org"]
        return org.select("team", *[c.alias(n) for n, c in S.priors({c: F.col(c) for c in org.columns if c != "team"}).items()])

    def org_position_vectors(self) -> DataFrame:
        base = self.position_vectors().select("team", "label", "prob")
        both = probs.zip_vectors(base, probs.org_adjusted(base, self.org_profile(), ["team"]), ["team"])
        return both.select("team", "label", F.col("a").alias("base"), F.col("b").alias("adjusted"), (F.col("b") - F.col("a")).alias("delta"))

    def _profile_lists(self, slot: int, board_aware: bool, given: DataFrame | None) -> DataFrame:
        """The short list of a team's view: those given, else the first of the board as it stands, else the first prospects by rank."""
        if given is None and board_aware:
            return self.candidate_lists(slot, True, limit=PROFILE_CANDIDATES)
        return self.candidate_lists(slot, board_aware, candidates.profile_candidates(self._prospects(), PROFILE_CANDIDATES) if given is None else given)

    def org_player_vectors(self, slot: int = 1, board_aware: bool = False, given: DataFrame | None = None) -> DataFrame:
        """Per team its candidates re-weighted by the organisation's priors, with rank and component."""
        rows = self._scored(self._profile_lists(slot, board_aware, given))
        return org.player_vectors(rows.select("team", "candidate_id", "name", "position", "probability", "team_need", "talent", "context", "best_available_rank"), self.org_profile())

    def backtest_demo(self) -> DataFrame:
        """The evaluation of three fixed vectors by three models: how the figures of a real one look."""
        spark = self["order"].sparkSession
        return probs.evaluate({name: spark.createDataFrame(rows, "row_id int, label string, prob double") for name, rows in demo_vectors().items()}, spark.createDataFrame(list(enumerate(DEMO_TRUTH)), "row_id int, label string"), "row_id")

    def draft_context(self) -> DataFrame:
        """Per team its next slot and round without an outcome, and the latest completed round (1 if there is none)."""
        order, done = self["order"], self["outcomes"]
        seen = done.groupBy("round").agg(F.count(F.lit(1)).alias("seen"))
        rounds = order.groupBy("round").agg(F.count(F.lit(1)).alias("slots")).join(seen, "round", "left")
        latest = rounds.filter("coalesce(seen, 0) >= slots").agg(F.coalesce(F.max("round"), F.lit(1)).alias("latest_completed_round"))
        free = order.join(done.select("slot"), "slot", "left_anti").groupBy("team").agg(F.min_by(F.struct("slot", "round"), "slot").alias("x"))
        teams = order.select("team").distinct().join(free, "team", "left").join(F.broadcast(latest), how="cross")  # one row
        return teams.select("team", "latest_completed_round", F.col("x.slot").alias("next_slot"), F.col("x.round").alias("next_round"))

    def team_history(self, lookback: int = 5) -> DataFrame:
        """Candidates by team in the last years of the votes; place is 1 for the newest year and the latest slot."""
        years = F.add_months(self.as_of, -12 * _within("lookback", lookback, 1, 12))
        rows = self["votes"].filter((F.col("published") < self.as_of) & (F.col("published") >= years) & F.col("team").isNotNull())
        out = rows.groupBy("team", F.year("published").alias("year"), "slot", "cand").agg(F.count(F.lit(1)).alias("n"))
        return consensus.ranked(out, ["team"], [F.desc("year"), F.desc("slot"), F.col("cand")], name="place")

    def team_summary(self, slot: int = 1, board_aware: bool = False, given: DataFrame | None = None) -> DataFrame:
        """One row per team: profile, first label after adjustment, next slot, the first five players of the organisation, of the model and of the consensus, an explanation, early history."""
        vectors = self.org_position_vectors().select("team", "label", F.col("adjusted").alias("prob"))
        first = consensus.ranked(vectors, ["team"], [F.round("prob", 9).desc(), F.col("label")], 1).select("team", "label", "prob")
        players = self.org_player_vectors(slot, board_aware, given).filter("rank <= 5")
        five = players.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "position", "adjusted", "component"))).alias("players"))
        scored = self._scored(self._profile_lists(slot, board_aware, given)).filter("rank <= 5")
        model = scored.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "position", "probability"))).alias("model_players"))
        seen = self.pick_consensus(slot, board_aware=board_aware).agg(F.array_sort(F.collect_list(F.struct("rank", "cand", "probability", "weighted_probability"))).alias("consensus_players"))
        early = self.team_history().filter("slot <= 2").groupBy("team", "cand").agg(F.sum("n").alias("n"))
        history = early.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("cand", "n"))).alias("history"))
        out = self.org_profile().join(first, "team", "left").join(self.next_slots(), "team", "left").join(F.broadcast(seen), how="cross")  # one row
        return out.join(five, "team", "left").join(model, "team", "left").join(org.explained(players), "team", "left").join(history, "team", "left")

    def health(self) -> dict[str, str]:
        return {"status": "ok"}


def team_of(label: Column) -> Column:
    """The code that a label names by itself, without a table of teams."""
    return X.team_code(label, team_aliases())


# The demonstration's truths, and each model's vectors over OT, QB, CB.
DEMO_TRUTH = ("OT", "QB", "CB")
DEMO = {
    "base": ((0.4, 0.3, 0.3), (0.25, 0.5, 0.25), (0.3, 0.25, 0.45)),
    "adjusted": ((0.5, 0.25, 0.25), (0.2, 0.55, 0.25), (0.25, 0.25, 0.5)),
    "consensus": ((0.35, 0.35, 0.3), (0.22, 0.52, 0.26), (0.35, 0.25, 0.4)),
}


def demo_vectors() -> dict[str, list[tuple[int, str, float]]]:
    """(row, label, probability) by model; the ensemble blends the consensus with the adjusted vectors."""
    mixed = {"base": DEMO["base"], "adjusted": DEMO["adjusted"]}
    mixed["ensemble"] = tuple(tuple(0.45 * c + 0.55 * a for c, a in zip(x, y, strict=True)) for x, y in zip(DEMO["consensus"], DEMO["adjusted"], strict=True))
    return {name: [(k, label, p) for k, row in enumerate(rows) for label, p in zip(DEMO_TRUTH, row, strict=True)] for name, rows in mixed.items()}
