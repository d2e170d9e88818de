import re

import numpy as np
import pytest
import xxhash

from augury.llm import simhash


def brute_print(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=2):
    """prints: {doc_id: fingerprint}"""
    ids = sorted(prints)
    fps = np.array([prints[i] for i in ids], np.uint64)
    least = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for k, i in enumerate(ids):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= radius)
            m = min(least[ids[j]] for j in near)
            for j in [k, *near]:
                if least[ids[j]] > m:
                    least[ids[j]], changed = m, True
    return least


def check(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs, **more).collect()}
    prints = {i: brute_print(t) for i, t, _ in rows}
    least = brute_components(prints)
    assert got == {i: (prints[i], least[i]) for i in prints}
    return got


def test_edge_texts(spark):
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", None), (4, "One", "c"), (5, "one", "d"), (6, "é É ß", "e"), (7, long, "f"), (8, long + " END", "g"), (9, "a b", "h")]
    got = check(spark, rows)
    assert got[1] == got[2] == got[3] == (0, 1) and got[4] == got[5] and got[7][1] == got[8][1]


def test_documents_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, [(r.doc_id, r.text, "") for r in docs.collect()])


@pytest.mark.parametrize(("cell_rows", "segment_bits"), [(20_000, 1), (10, 1), (20_000, 4)])
def test_links_find_every_component(spark, cell_rows, segment_bits):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        x = int(b)
        for _ in range(30):  # chains of steps of one or two bits
            x ^= int(1 << int(rng.integers(64))) | int(1 << int(rng.integers(64)))
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    edges = simhash.links(df, segment_bits=segment_bits, cell_rows=cell_rows)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in edges.collect())
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    want = brute_components(dict(zip(signed, [np.uint64(x) for x in fps], strict=True)))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {s: got.get(s, s) for s in signed} == want


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string, component_id string"
    empty = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.drop_near_duplicates(empty).collect() == []
    rows = [(1, "x y z", "p"), (1, "x y z", "p"), (2, "X y z", "q"), (None, "x y z", "r"), (None, "lone text here", "s"), (3, "q w e r t", "t")]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, schema))
    assert sorted(out.collect(), key=str) == sorted(spark.createDataFrame([rows[0], *rows[3:]], schema).collect(), key=str)
