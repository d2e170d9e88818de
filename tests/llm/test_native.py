"""Exact dedup, quality rules and sharding: brute force, edge rows, queries."""

import hashlib
import re
from collections import Counter

import pytest

from augury.llm import exact_dedup, quality, sharding

SCHEMA = "doc_id long, text string, text_sha256 string, row long, group_size string, shard string, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None, None, "") for i, t in rows], SCHEMA)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("support", [0.001, 0.02, 0.3])
def test_exact_duplicates(spark, sf_dir, support):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(1000 + k, "Hot Text ÄÖ" if k % 2 else "hot text ÄÖ") for k in range(200)] + [(2000, "hot text äö"), (2001, None), (2002, ""), (2003, None)]
    got = exact_dedup.exact_duplicates(frame(spark, rows), support=support).collect()
    best, size = {}, Counter(fold(t) for _, t in rows)
    for i, t in sorted(rows):
        best[fold(t)] = i
    want = [(i, best[fold(t)], size[fold(t)], i == best[fold(t)], hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, got)) == sorted(want)
    kept = exact_dedup.drop_exact_duplicates(frame(spark, rows), support=support)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(best.values()) and kept.columns == frame(spark, []).columns


def test_exact_duplicates_edge_rows(spark):
    empty = frame(spark, [])
    assert exact_dedup.exact_duplicates(empty).collect() == [] and exact_dedup.drop_exact_duplicates(empty).collect() == []
    rows = [(3, "a"), (3, "A"), (None, "a"), (None, "b"), (None, "b"), (1, "x" * 300_000), (2, "X" * 300_000)]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert sum(r.kept for r in got) == 3 and {r.keep_id for r in got} == {3, None, 2}
    assert sorted(str(r.doc_id) for r in exact_dedup.drop_exact_duplicates(frame(spark, rows)).collect()) == ["2", "3", "None"]


def brute_stats(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = Counter(windows)
    repeated = {p for k, w in enumerate(windows) if many[w] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_stats(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "a b c"), (904, "a b c a b c"), (905, "\x0ba\xa0b \x1c c\n\nd\nd\n d"), (906, "x y z w " * 20_000), (906, "# | é"), (None, "a a a a"), (907, " ".join(f"w{k}" for k in range(60)))]
    got = quality.quality_stats(frame(spark, rows)).collect()
    want = [(i, *(s := brute_stats(t)), s[0] < 50 or 100 * s[4] > 50 * s[0]) for i, t in rows]
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    kept = quality.keep_good(frame(spark, rows))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert all(r.kept == (r.failed_rule is None) and (r.kept <= (not r.base_failed)) for r in got)
    assert quality.quality_stats(frame(spark, [])).collect() == []


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    stats = quality.quality_stats(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    lost = stats.join(labels, "doc_id").filter("quality = 1 AND NOT kept AND NOT base_failed")
    assert lost.count() == 0


def test_rule_order_prefers_cheap_rejections(spark):
    rows = [(k, "word " * 10 if k % 2 else " ".join(f"w{j}" for j in range(200))) for k in range(300)]
    order = [r.name for r in quality.order_rules(frame(spark, rows))]
    assert sorted(order) == sorted(r.name for r in quality.RULES) and order.index("too_short") < order.index("long_words")


def test_sharding(spark):
    shards, slots = tuple(f"s{k}" for k in range(7)), 1009
    table = sharding.slot_table(shards, slots)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1 and set(table) == set(range(7))
    fewer = sharding.slot_table(shards[:-1], slots)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.2 * slots
    rows = [(k, "") for k in range(500)] + [(None, None), (7, "again")]
    placed = sharding.assign_shards(frame(spark, rows), shards=shards, slots=slots)
    assert placed.columns == frame(spark, []).columns
    for r in placed.collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == shards[table[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % slots]]
    assert placed.count() == len(rows)
    assert sharding.assign_shards(frame(spark, [])).collect() == []
    for bad in (((), 7), (("a", "a"), 7), (("a",), 8)):
        with pytest.raises(ValueError):
            sharding.slot_table(*bad)


def test_written_shards(spark, tmp_path):
    sharding.write_shards(frame(spark, [(k, "t") for k in range(200)]), str(tmp_path / "out"), shards=("a", "b", "c"), slots=101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == {"a", "b", "c"}
