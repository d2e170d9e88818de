"""Vector codes against brute force in plain Python, the search against all distances, edge rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from augury.llm import queries, veccodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, dims string, v string, error long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "", None, 1) for i, v, k in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6):
    """(code, error) by row number, and the codebooks; rows: (id, vector, label)."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            best = [min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, best in zip(cut, found, strict=True) if best[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)) for best in assign()], books


def random_rows(n, dims, seed, grid=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(grid)) if grid else (lambda: rng.gauss(0, 0.3))
    return [(i, [draw() for _ in range(dims)], rng.choice([None, 1, 2])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("case", ["gauss", "ties", "few"])
def test_encode_equals_brute_force(spark, case):
    rows = random_rows(9 if case == "few" else 150, 16, 3, [0.0, 0.25, -0.25] if case == "ties" else None)
    broken = [(9001, None, 1), (9002, [], 1), (9003, [float("nan")] * 16, 1), (9004, [None] * 16, None), (9005, [float("inf")] + [0.0] * 15, 2), (-5, [1.0, 2.0], 1)]
    got, books = veccodes.encode(frame(spark, rows + broken).repartition(5))
    want, want_books = brute(rows)
    assert [b.tolist() for b in books.books] == want_books
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in want_books for e in p for x in e).encode()).hexdigest()
    by_label = {k: sum(w[1] for w, r in zip(want, rows, strict=True) if r[2] == k) for k in (None, 1, 2)}
    expected = sorted((r[0], w[0], w[1], by_label[r[2]]) for w, r in zip(want, rows, strict=True))
    assert sorted((r.vec_id, r.code.hex(), r.error, r.label_error) for r in got.collect()) == expected


def test_search_equals_all_distances():
    rng = np.random.default_rng(5)
    for k in range(60):
        n, m, dims = int(rng.integers(0, 40)), int(rng.integers(1, 17)), int(rng.integers(1, 9))
        wide = 3 if k % 2 else 10_000
        x, book = rng.integers(-wide, wide, (n, dims)), rng.integers(-wide, wide, (m, dims))
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        code, error = veccodes.nearest(x, book)
        assert code.tolist() == every.argmin(axis=1).tolist() and error.tolist() == every.min(axis=1).tolist()


def test_decoded_gives_the_stated_error(spark):
    rows = random_rows(60, 18, 8)  # 18 is no multiple of 8
    got, books = veccodes.encode(frame(spark, rows))
    vectors = {i: np.floor(4096 * np.array(v, np.float32).astype(float)) for i, v, _ in rows}
    for r in got.collect():
        assert int(((vectors[r.vec_id] - veccodes.decoded(r.code, books)) ** 2).sum()) == r.error
    assert [b.shape[1] for b in books.books] == [3, 3, 2, 2, 2, 2, 2, 2]


def test_edge_rows(spark, monkeypatch):
    out, books = veccodes.encode(frame(spark, []))
    assert books is None and out.collect() == [] and out.columns == ["vec_id", "label", "code", "error", "label_error"]
    same = [(1, [1.0] * 8, None)] * 3 + [(None, [1e30] * 8, 4), (None, [-1e30] * 8, 4)]
    got = veccodes.encode(frame(spark, same))[0].collect()
    assert len(got) == 5 and sum(r.vec_id is None for r in got) == 2 and {r.error for r in got} == {0}
    with pytest.raises(ValueError, match="entries"):
        veccodes.encode(frame(spark, same), entries=300)
    monkeypatch.setattr(veccodes, "small", lambda df: False)  # sums that are not few
    monkeypatch.setattr(veccodes, "HOT_LABELS", 3)
    rows = random_rows(80, 8, 2) + [(5000 + k, [0.1 * k] * 8, 100 + k) for k in range(20)]
    got = veccodes.encode(frame(spark, rows), rounds=1)[0].collect()
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert len(got) == 100 and all(r.label_error == sums[r.label] for r in got)


def test_query_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op11_vector_codes(spark, str(tmp_path)).collect() == []
