"""The pipeline's near-dedup on planted copies, against exact similarities of 5-word shingles."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from augury.llm import neardup, simhash
from augury.llm.common import scratch_table


def shingles(text):
    """The set of 5-word shingles, by the words themselves; of a text of fewer words the text."""
    words = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute_components(texts, similarity=0.8):
    """texts: {id: text}. The smallest id that links at that similarity reach, by comparing all pairs."""
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    return {i: ids[find(x)] for x, i in enumerate(ids)}


def test_documents_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_components({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize(("cell_bytes", "cell_rows"), [(1 << 20, 2048), (4000, 2048), (1 << 20, 10)])
def test_cells_of_several_groups(spark, cell_bytes, cell_rows):
    """Texts around 0.8 of one another, which the smallest of their cells does not join: none is lost, whatever the split of cells."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    texts = {}
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([2, 3, 4])):
            words[at] = f"x{k}-{at}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    made = scratch_table(neardup.sketches(docs), "sketches")
    edges = scratch_table(neardup.links(made, cell_bytes=cell_bytes, cell_rows=cell_rows), "links")
    got = {r.doc_id: r.component_id for r in simhash.by_component(made.select("doc_id", "fp"), edges).collect()}
    want = brute_components(texts)
    assert got == want and 1 < len(set(want.values())) < 150
    by_print = {r.fp: r.doc_id for r in made.collect()}
    for a, b in edges.distinct().collect():
        x, y = shingles(texts[by_print[a]]), shingles(texts[by_print[b]])
        assert len(x & y) >= 0.8 * len(x | y)


def test_forest_against_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
        wide = [np.unique(np.concatenate((rng.choice(base, 50, replace=False), rng.integers(0, 1 << 62, int(rng.integers(0, 9)), dtype=np.uint64)))) for _ in range(40)]
        sets = [np.unique(w.astype(np.uint32)) for w in wide]
        bits = np.array([simhash.majority(w) for w in wide], np.uint64)
        left, right = neardup._forest(list(range(40)), bits, list(range(40)), sets, 0.8, 64)
        want, got = list(range(40)), list(range(40))
        pairs = [(x, y) for x in range(40) for y in range(x) if len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))]
        for root, links in ((want, pairs), (got, list(zip(left, right, strict=True)))):
            for _ in range(40):
                for x, y in links:
                    root[x] = root[y] = min(root[x], root[y])
        assert got == want and len(left) == 40 - len(set(want))


def test_edge_texts(spark):
    schema = "doc_id long, text string, component_id string, fp string, cells string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, "", "", ""), (2, "", "", "", ""), (3, " \n", "", "", ""), (4, "a b", "", "", ""), (5, "A  b", "", "", ""), (None, "a b c", "", "", ""), (6, "w " * 50_000, "", "", ""), (7, "w " * 49_000 + "W", "", "", ""), (8, "x " * 300, "", "", ""), (8, "x " * 300, "", "", "")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None), (6, 6), (7, 6), (8, 8)}
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, schema))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "8", "None"] and kept.columns == [c.split()[0] for c in schema.split(", ")]


def test_a_text_of_very_many_cells_is_salted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_PAIRS", 20)
    base = [f"b{k}" for k in range(200)]
    texts = {k: " ".join([*base[: k % 60], f"n{k}", *base[k % 60 + 1 :]]) for k in range(120)}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(docs).collect()} == {0}


def test_planted_copies(spark, sf_dir):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for changed in [1, 2, 3, 4, 5, 6, 7, 9, 12, 20] * 6:
        words = [word() for _ in range(300)]
        copy = list(words)
        for at in rng.sample(range(300), changed):
            copy[at] = word()
        texts += [" ".join(words), " ".join(copy)]
    hub = [word() for _ in range(300)]
    for k in range(60):  # a group larger than the window of a cell
        texts.append(" ".join([*hub[:290], *[word() for _ in range(10)]]))
    least = brute_components(dict(enumerate(texts)))
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()}
    assert kept == set(least.values())
    assert len(kept) < len(texts) - 80
