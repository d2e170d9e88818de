"""Importance resampling towards a target distribution, with hashed word n-grams as features.

Each document becomes an array of buckets, made by higher-order functions. Counts per bucket of
the corpus and of the target are the only totals that are shuffled; they give each bucket a gain,
the logarithm of how much likelier the target has it. A document's weight is the mean of its
buckets' gains, looked up in one literal array, and Gumbel noise keyed by its id turns the largest
scores into a sample without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import fold_ascii, scratch_table, text_or_empty

BUCKETS, ORDER, SEED, PERCENT, MIN_WORDS, UNIT = 10_000, 1, 2024, 10, 20, 1000
#: Between words: ASCII other than digits and letters; texts are lower-cased before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Scores are counted in bins of so many units; the bins' number is bounded by the range of scores.
BIN = 64


def folded_words(text: str) -> Column:
    return F.array_remove(F.split(fold_ascii(text_or_empty(text)), BETWEEN), "")


def features(words: Column, order: int = ORDER) -> Column:
    """All runs of 1 to `order` consecutive words, joined by one blank, repeats included."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        joined = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *map(runs, range(2, order + 1)))


def bucket_arrays(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, buckets. A null text has no words."""
    words = docs.select(F.col(id_col).alias("doc_id"), folded_words(text_col).alias("words"))
    hashed = F.transform(features(F.col("words"), order), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), hashed.alias("buckets"))


def bucket_counts(arrays: DataFrame) -> DataFrame:
    """bucket, n: occurrences, summed per task before they are shuffled."""
    return arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, unit: int = UNIT) -> list[int]:
    """floor(unit * ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket, in order; `buckets` numbers."""
    spark = corpus.sparkSession
    counts = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for name, side in (("s", corpus), ("t", target)):
        counts = counts.join(bucket_counts(side).withColumnRenamed("n", name), "bucket", "left").fillna(0, [name])
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    found = counts.join(F.broadcast(totals), how="cross").select("bucket", F.floor(unit * F.log(ratio)).alias("gain")).collect()
    out = [0] * buckets
    for r in found:
        out[r.bucket] = r.gain
    return out


def weights(arrays: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of a document's buckets, 0 without any."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")  # folded into one literal
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    n = F.size("buckets").cast("long")
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return arrays.select("doc_id", "n_words", n.alias("n_features"), total.alias("total")).select("doc_id", "n_words", "n_features", mean.alias("weight"))


def noise(id_col: str, seed: int = SEED, unit: int = UNIT) -> Column:
    """floor(-unit * ln(-ln(u))), u in (0, 1) from the first 32 bits of sha256('seed:id'); a null id counts as ''."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-unit) * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored with rank: 1, 2, 3... for the floor(percent * N / 100) highest scores of the N rows with enough words, else null.

    Ties go to the smaller id, then to the larger n_features. Counts by bins of scores tell which rows
    can be drawn; only those are sorted, by ranges, and numbered with the counts of the ranges before.
    """
    spark, width = scored.sparkSession, F.lit(BIN)
    able = F.col("n_words") >= min_words
    held = F.floor(F.col("score") / width)
    bins = scored.filter(able).groupBy(held.alias("bin")).count().collect()  # bounded by the range of scores / BIN
    quota = sum(r["count"] for r in bins) * percent // 100
    least, above = None, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if above >= quota:
            break
        least, above = r["bin"], above + r["count"]
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    may = able & (held >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scored.filter(may).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = scratch_table(ranged.withColumn("place", F.monotonically_increasing_id()), "drawn")
    part, within = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row for each range
        offsets.append((r["part"], before))
        before += r["count"]
    offset = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + within + 1
    top = placed.withColumn("part", part.cast("long")).join(offset, "part").withColumn("rank", F.when(rank <= quota, rank))
    rest = scored.filter(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return top.select(rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, unit: int = UNIT) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    A null or empty text has no features and a weight of 0; it is never drawn if min_words is 1 or
    more. An empty target has equal counts everywhere, so that rare features of the corpus gain.
    Repeated rows each get a row, null ids share one noise, other columns are not read. An empty
    table gives no rows.
    """
    arrays = scratch_table(bucket_arrays(docs, id_col, text_col, buckets, order), "buckets")
    aimed = bucket_arrays(target.withColumn("__none", F.lit(None).cast("long")), "__none", target_text_col, buckets, order)
    weighed = weights(arrays, gains(arrays, aimed, buckets, unit))
    scored = scratch_table(weighed.withColumn("score", F.col("weight") + noise("doc_id", seed, unit)), "scored")
    return drawn(scored, percent, min_words)
