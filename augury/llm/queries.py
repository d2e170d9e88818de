"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from augury.llm import exact_dedup, importance, langid, mixing, packing, pii, quality, repair, sharding, simhash, token_counts, toxicity, veccodes
from augury.llm.common import LOWER, UPPER, scratch_table

FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir).select("doc_id")).select("doc_id", "shard")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count the base spans; n_added counts those that the transducers add."""
    found = pii.spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: ~s["added"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter(base, lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.quality_stats(documents(spark, sf_dir))
    return stats.select("doc_id", *quality.STATS, "base_failed", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = [F.expr(e).alias(n) for n, e in corpus_pipeline.LEVELS.items()]
    sized = scratch_table(token_counts.measured(documents(spark, sf_dir).select("doc_id", *levels, "text"), "text", "tokens"), "measured")
    return mixing.mix(sized, {n: n for n in corpus_pipeline.LEVELS}, corpus_pipeline.WEIGHTS, share=0.6, max_epochs=2, tokens=F.col("tokens"))


def op8_repair_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = repair.read_shards(repair.write_shards(documents(spark, sf_dir)))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = veccodes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.lit(books.sha256() if books else None).cast("string")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance.resample(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations under all three limits; only what the assistant says bears loss."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    loss = F.when(F.col("role") != "assistant", 0)
    examples = turns.select(F.concat_ws(":", "conv_id", "turn").alias("example"), "text", loss.alias("loss"))
    pieces = packing.pack(examples, "example", max_tokens=1024, max_segments=16, max_loss=384, loss_col="loss")
    return pieces.select(F.col("doc_id").alias("example"), "start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset")


OP1_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256({FOLDED}) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_sql() -> str:
    """The slot table is a fixed value here; the hash, the slot and the look-up are SQL's own."""
    table = ",".join(map(str, sharding.slot_table()))
    slot = f"CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {sharding.SLOTS}"
    return f"""
    WITH t AS (SELECT string_split('{table}', ',') AS owners)
    SELECT doc_id, 'shard-' || lpad(owners[{slot} + 1], 3, '0') AS shard FROM documents, t
    """


OP5_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
win AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
hit AS (SELECT r, i FROM win JOIN (SELECT r, win FROM win GROUP BY ALL HAVING count(*) > 1) USING (r, win)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY r),
line AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(line.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN line USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words) AS kept
FROM s
"""


def op11_sql(parts: int = veccodes.PARTS, entries: int = veccodes.ENTRIES, rounds: int = veccodes.ROUNDS, scale: int = veccodes.SCALE) -> str:
    """Each round is a CTE of assignments and one of codebooks; vectors have one length, a multiple of parts."""
    floored = "CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
    distance = "CAST(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    ctes = [
        f"""q AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM q, range({parts}) t(part))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM q ORDER BY vec_id LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT part, e, x AS c FROM p JOIN s USING (vec_id))",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"""a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min(m).d AS d, min(m).e AS e FROM (
                SELECT p.vec_id, p.part, p.x, {{'d': {distance}, 'e': b.e}} AS m FROM p JOIN b{k} b ON p.part = b.part) GROUP BY vec_id, part)"""
        )
        if k < rounds:
            ctes.append(
                f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (
                    SELECT part, e, list(m ORDER BY i) AS c FROM (
                      SELECT part, e, i, {floored} AS m FROM (SELECT part, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}) GROUP BY part, e, i)
                    GROUP BY part, e) n ON n.part = b.part AND n.e = b.e)"""
            )
    return f"""WITH {", ".join(ctes)},
    f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM b{rounds}) AS codebooks_sha256
    FROM f JOIN q USING (vec_id)"""


def op12_sql(buckets: int = importance.BUCKETS, seed: int = importance.SEED, percent: int = importance.PERCENT, least: int = importance.MIN_WORDS, unit: int = importance.UNIT) -> str:
    """crc32 comes from its bitwise rule, on distinct words."""
    words = lambda side: rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM {side}"
    return f"""
    WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
    d AS MATERIALIZED (SELECT doc_id, {words("documents")}), a AS MATERIALIZED (SELECT {words("benchmark")}),
    dw AS MATERIALIZED (SELECT doc_id, unnest(words) AS w FROM d), aw AS (SELECT unnest(words) AS w FROM a),
    k AS MATERIALIZED (SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {buckets} AS b
        FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM aw)), crc),
    s AS (SELECT b, count(*) AS s FROM dw JOIN k USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM aw JOIN k USING (w) GROUP BY b),
    g AS MATERIALIZED (SELECT r.b, CAST(floor({unit} * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM dw)::DOUBLE + {buckets}) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM aw)::DOUBLE + {buckets})))) AS BIGINT) AS gain
        FROM range({buckets}) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
    w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN k USING (w) JOIN g USING (b) GROUP BY doc_id),
    f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n, coalesce(total, 0) AS total FROM d LEFT JOIN w USING (doc_id)),
    m AS (SELECT doc_id, n AS n_features, CASE WHEN n = 0 THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight FROM f),
    c AS (SELECT *, weight + CAST(floor(-{unit} * ln(-ln((CAST('0x' || sha256('{seed}:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM m),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= {least})
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * {percent} // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_sharding": op2_sharding,
        "op3_language_id": op3_language_id,
        "op4_pii": op4_pii,
        "op5_quality_rules": op5_quality_rules,
        "op6_token_counts": op6_token_counts,
        "op7_mixing": op7_mixing,
        "op8_repair_output": op8_repair_output,
        "op9_simhash": op9_simhash,
        "op10_packing": op10_packing,
        "op11_vector_codes": op11_vector_codes,
        "op12_importance": op12_importance,
        "op13_toxicity": op13_toxicity,
        "instruction_packing": instruction_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_sharding": op2_sql(), "op5_quality_rules": OP5_SQL, "op11_vector_codes": op11_sql(), "op12_importance": op12_sql()}
