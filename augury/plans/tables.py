"""How the supplied star schema plays the roles of the domain, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2000-01-01"
WEIGHTS = {"AUTOMOBILE": (1.15, 200.0), "BUILDING": (1.1, 400.0)}
OTHER = (1.0, 300.0)


class Tables:
    """Lazy readers of one folder; every role selects the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp_ntz")

    def _picks(self, orders: DataFrame | None = None) -> DataFrame:
        """Lines with their order, part, supplier and nation. What orders are joined with beforehand is shuffled by orders, not by lines."""
        rows = self.lineitem.join(self.orders if orders is None else orders, F.col("l_orderkey") == F.col("o_orderkey"))
        rows = rows.join(self.part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        rows = rows.join(self.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.join(self.nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))

    def votes(self) -> DataFrame:
        """Votes before AS_OF; suppliers with a key divisible by 5 stand for unknown teams."""
        rows = self._picks(self.orders.filter(F.col("o_orderdate") < self.as_of).join(self.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")))
        pick = lambda k: F.when(F.col("c_mktsegment") == "AUTOMOBILE", WEIGHTS["AUTOMOBILE"][k]).when(F.col("c_mktsegment") == "BUILDING", WEIGHTS["BUILDING"][k]).otherwise(OTHER[k])
        return rows.select(
            F.col("l_linenumber").alias("slot"), F.col("p_brand").alias("cand"), F.col("o_orderkey").alias("article"), F.col("c_mktsegment").alias("source"),
            pick(0).alias("weight"), pick(1).alias("tau"), F.col("o_orderdate").alias("published"),
            F.when(F.col("s_suppkey") % 5 != 0, F.col("n_name")).alias("team"),
        )

    def outcomes(self) -> DataFrame:
        """Per slot the brand with the largest revenue from AS_OF on, and the brand's first nation."""
        rows = self._picks().filter(F.col("o_orderdate") >= self.as_of)
        sums = rows.groupBy("l_linenumber", "p_brand").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"), F.min("n_name").alias("team"))
        best = sums.groupBy("l_linenumber").agg(F.min_by(F.struct("p_brand", "team"), F.struct(-F.col("v"), F.col("p_brand"))).alias("x"))
        return best.select(F.col("l_linenumber").alias("slot"), F.col("x.p_brand").alias("cand"), F.when(F.col("l_linenumber") % 2 == 1, F.col("x.team")).alias("team"), F.lit(1).alias("round"), F.col("l_linenumber").alias("id"))

    def order(self) -> DataFrame:
        """Slots 1 to 40: the nation of the slot's number modulo 25."""
        slots = self.spark.range(1, 41).select(F.col("id").cast("int").alias("slot"))
        return slots.join(self.nation, F.col("slot") % 25 == F.col("n_nationkey")).select("slot", F.col("n_name").alias("team"), F.ceil(F.col("slot") / 8).cast("int").alias("round"))

    def roster(self) -> DataFrame:
        """Lines as members of a nation's rooms, whose snaps and starts are shares of all lines, so that they mean the same at any size.

        Each 25th part is a room of its own, with a member or two.
        """
        lines = self.lineitem.agg(F.count(F.lit(1)).cast("double").alias("__lines"))
        rows = self._picks().join(F.broadcast(lines), how="cross")  # one row
        return rows.select(
            F.col("n_name").alias("team"), F.when(F.col("p_partkey") % 25 == 0, F.concat(F.lit("K"), F.col("p_partkey"))).otherwise(F.col("p_type")).alias("position"),
            (F.col("l_quantity") * 6000.0 / F.col("__lines")).alias("snaps"), F.when(F.col("l_returnflag") == "R", 30000.0 / F.col("__lines")).otherwise(0.0).alias("starts"),
            F.nullif((F.col("l_discount") * 100).cast("long") * 2 + 19, F.lit(19)).cast("double").alias("age"), (F.col("l_tax") * 100).cast("long").cast("double").alias("experience"),
            F.when(F.col("l_linenumber") != 3, F.col("l_linestatus") == "F").alias("starter"), F.when(F.col("l_linenumber") != 4, F.col("l_returnflag") == "A").alias("injured"),
        )

    def needs(self) -> DataFrame:
        """A fixed base need per nation and part type; a nation needs nothing of some types, and some need what no part is."""
        types = self.part.agg(F.collect_set("p_type").alias("types"))  # a handful of types, in one row
        rows = self.nation.join(F.broadcast(types), how="cross").withColumn("p_type", F.explode("types"))
        mix = F.col("n_nationkey") * 7 + F.length("p_type") * 13
        named = rows.filter(mix % 11 != 0).select(F.col("n_name").alias("team"), F.col("p_type").alias("position"), (0.2 + (mix % 80) / 100.0).alias("overall"))
        return named.unionByName(self.nation.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("team"), F.lit("KICKER").alias("position"), F.lit(0.97).alias("overall")))

    def candidates(self) -> DataFrame:
        prospect = F.round((F.col("p_retailprice") - 900) / 100, 6)
        return self.part.select(
            F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("name"), F.col("p_type").alias("position"), prospect.alias("prospect"),
            F.round(0.95 * prospect, 6).alias("star"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") + 1).cast("long").alias("consensus_rank"),
        )

    def prospects(self) -> DataFrame:
        """Candidates with the other ranks and scores that a scouting table has; stars and ranks are missing here and there."""
        more = self.part.select(
            F.col("p_partkey").alias("candidate_id"), (F.col("p_size") / 50).alias("market"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") + 5).otherwise(0).alias("big_board_rank"), (F.col("p_size") % 5).alias("positional_rank"),
        )
        known = self.candidates().withColumn("star", F.when(F.col("candidate_id") % 4 != 0, F.col("star")))
        return known.withColumnRenamed("prospect", "production").join(more, "candidate_id")

    def board_prospects(self) -> DataFrame:
        """Prospects under names of their own."""
        return self.prospects().withColumn("name", F.concat_ws(" ", "name", "candidate_id"))

    def drafted(self) -> DataFrame:
        """slot, name: the slots, up to 97, at which the prospects are taken."""
        slot = (F.col("p_partkey") * 7 + F.col("p_size") * 3) % 97 + 1
        return self.part.select(slot.cast("int").alias("slot"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"))

    def org(self) -> DataFrame:
        """Features of a nation from its members; the coach has none for keys divisible by 4."""
        k = F.col("n_nationkey")
        part = lambda a, b: ((k * a + b) % 100) / 100.0
        named = {"gm_offense": part(17, 3), "org_offense": part(29, 11), "gm_trenches": part(31, 5), "org_trenches": part(37, 9), "gm_need": part(41, 2), "org_need": part(43, 8), "gm_bpa": part(47, 6), "org_bpa": part(53, 4), "stability": part(59, 1)}
        coach = {"coach_offense": F.when(k % 4 != 0, part(61, 7)), "coach_trenches": F.when(k % 4 != 0, part(67, 10))}
        return self.nation.select(F.col("n_name").alias("team"), *[v.alias(n) for n, v in (named | coach).items()])


_PICKS = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
CTES = {
    "votes": f"""SELECT l_linenumber AS slot, p_brand AS cand, o_orderkey AS article, c_mktsegment AS source,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1.15::DOUBLE WHEN 'BUILDING' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 200.0::DOUBLE WHEN 'BUILDING' THEN 400.0::DOUBLE ELSE 300.0::DOUBLE END AS tau,
        o_orderdate AS published, CASE WHEN s_suppkey % 5 <> 0 THEN n_name END AS team
        FROM {_PICKS} JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '{AS_OF}'""",
    "outcomes": f"""SELECT slot, cand, CASE WHEN slot % 2 = 1 THEN team END AS team, 1 AS round, slot AS id FROM (
        SELECT l_linenumber AS slot, p_brand AS cand, min(n_name) AS team,
               row_number() OVER (PARTITION BY l_linenumber ORDER BY sum(l_extendedprice::DECIMAL(18,2)) DESC, p_brand) AS rn
        FROM {_PICKS} WHERE o_orderdate >= TIMESTAMP '{AS_OF}' GROUP BY 1, 2) WHERE rn = 1""",
    "draft_order": "SELECT s::INT AS slot, n_name AS team, ceil(s / 8)::INT AS round FROM range(1, 41) t(s) JOIN nation ON s % 25 = n_nationkey",
    "roster": f"""SELECT n_name AS team, CASE WHEN p_partkey % 25 = 0 THEN 'K' || p_partkey ELSE p_type END AS position, l_quantity::DOUBLE * 6000.0::DOUBLE / (SELECT count(*)::DOUBLE FROM lineitem) AS snaps,
        CASE WHEN l_returnflag = 'R' THEN 30000.0::DOUBLE / (SELECT count(*)::DOUBLE FROM lineitem) ELSE 0.0::DOUBLE END AS starts,
        nullif(trunc(l_discount * 100)::BIGINT * 2 + 19, 19)::DOUBLE AS age, trunc(l_tax * 100)::BIGINT::DOUBLE AS experience,
        CASE WHEN l_linenumber <> 3 THEN l_linestatus = 'F' END AS starter, CASE WHEN l_linenumber <> 4 THEN l_returnflag = 'A' END AS injured FROM {_PICKS}""",
    "needs": """SELECT n_name AS team, p_type AS position, 0.2::DOUBLE + ((n_nationkey * 7 + length(p_type) * 13) % 80) / 100.0::DOUBLE AS overall
        FROM nation, (SELECT DISTINCT p_type FROM part) WHERE (n_nationkey * 7 + length(p_type) * 13) % 11 <> 0 UNION ALL SELECT n_name, 'KICKER', 0.97::DOUBLE FROM nation WHERE n_nationkey % 5 = 0""",
    "candidates": """SELECT p_partkey AS candidate_id, p_name AS name, p_type AS position, round((p_retailprice - 900) / 100, 6) AS prospect,
        round(0.95::DOUBLE * round((p_retailprice - 900) / 100, 6), 6) AS star, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey + 1 END AS consensus_rank FROM part""",
    "org": "SELECT n_name AS team, " + ", ".join(
        f"((n_nationkey * {a} + {b}) % 100) / 100.0::DOUBLE AS {n}"
        for n, a, b in (("gm_offense", 17, 3), ("org_offense", 29, 11), ("gm_trenches", 31, 5), ("org_trenches", 37, 9), ("gm_need", 41, 2), ("org_need", 43, 8), ("gm_bpa", 47, 6), ("org_bpa", 53, 4), ("stability", 59, 1))
    ) + ", " + ", ".join(f"CASE WHEN n_nationkey % 4 <> 0 THEN ((n_nationkey * {a} + {b}) % 100) / 100.0::DOUBLE END AS {n}" for n, a, b in (("coach_offense", 61, 7), ("coach_trenches", 67, 10))) + " FROM nation",
    "open_votes": "SELECT * FROM votes v WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.cand = v.cand AND o.slot < v.slot)",
}


def consensus_ctes(source: str, name: str) -> dict[str, str]:
    """CTEs of the smoothed consensus over the CTE `source`; the last, `name`, has all candidates with their rank."""
    return {
        f"{name}_t": f"""SELECT slot, cand, count(*)::DOUBLE AS n,
            sum(weight * exp(-greatest(0, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(published)) / 86400)) / greatest(1.0, tau))) AS w FROM {source} GROUP BY 1, 2""",
        f"{name}_k": f"SELECT slot, count(*) AS m, sum(n) AS tn, sum(w) AS tw, greatest(count(*) + 1, least(28, greatest(6, 3 + slot // 2))) AS k FROM {name}_t GROUP BY slot",
        f"{name}_p": f"""SELECT slot, cand, (n + 0.5) / (tn + 0.5 * k) AS probability, (w + 0.5) / (tw + 0.5 * k) AS weighted_probability,
            0.5 * (k - m) / (tn + 0.5 * k) AS other_probability, k AS category_count FROM {name}_t JOIN {name}_k USING (slot)""",
        name: f"SELECT *, row_number() OVER (PARTITION BY slot ORDER BY round(weighted_probability, 9) DESC, round(probability, 9) DESC, cand) AS rank FROM {name}_p",
    }


def sql(body: str, *names: str, **more: str) -> str:
    """body with the named shared CTEs, then the given ones, in front."""
    parts = {n: CTES[n] for n in names} | more
    return ("WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts.items()) + "\n" if parts else "") + body
