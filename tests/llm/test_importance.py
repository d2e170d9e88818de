"""Importance resampling against brute force, longer runs, edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from augury.llm import importance

SCHEMA = "doc_id long, text string, score string, rank string, n_words string, weight string, buckets string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, "", "", "b") for i, t in rows], SCHEMA)


def brute(docs, target, order=1, percent=10, least=20):
    def hashed(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        runs = [" ".join(words[k : k + n]) for n in range(1, order + 1) for k in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]

    sides = [hashed(t) for _, t in docs]
    s, t = Counter(b for _, bs in sides for b in bs), Counter(b for x in target for b in hashed(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + 10_000.0)) / ((s[b] + 1.0) * (all_t + 10_000.0))))
    out = []
    for (i, _), (n_words, bs) in zip(docs, sides, strict=True):
        weight = sum(map(gain, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


TEXT = "The cat, the DOG and 3 Ärzte; it's naïve\x00\n日本 word{x}y  a-b "


@pytest.mark.parametrize("order", [1, 3])
def test_resample_equals_brute_force(spark, sf_dir, order):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(5000 + k, TEXT * (k % 4)) for k in range(40)] + [(6000, None), (6001, ""), (6002, "!? "), (6003, "word " * 60_000), (None, TEXT * 3), (7, "of " * 30)]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [None, ""]
    aims = spark.createDataFrame([(t, 1, "x") for t in target], "text string, doc_id int, buckets string")
    got = importance.resample(frame(spark, docs).repartition(6), aims, order=order, percent=35)
    found = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)
    assert found == brute(docs, target, order, 35)


def test_edge_rows(spark):
    none = frame(spark, [])
    assert importance.resample(none, none).collect() == []
    got = importance.resample(frame(spark, [(1, None), (2, "a b"), (2, "a b"), (None, "")]), none, percent=100, min_words=1).collect()
    assert sorted((r.doc_id or 0, r.n_features, r["rank"] or 0) for r in got) == [(0, 0, 0), (1, 0, 0), (2, 2, 1), (2, 2, 2)]


def test_nothing_is_drawn_from_too_few(spark):
    rows = [(k, "w " * 25) for k in range(9)]
    assert {r["rank"] for r in importance.resample(frame(spark, rows), frame(spark, rows)).collect()} == {None}
    equal = importance.resample(frame(spark, [(None, "w " * 25)] * 40), frame(spark, rows)).collect()  # all scores tie
    assert sorted(r["rank"] for r in equal if r["rank"]) == [1, 2, 3, 4]


def test_scoring_has_no_explode_and_only_counts_shuffle(spark):
    arrays = importance.bucket_arrays(frame(spark, [(1, "a b c")]), "doc_id", "text")
    plan = importance.weights(arrays, [0] * 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
