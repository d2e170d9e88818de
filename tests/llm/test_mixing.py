import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from augury.llm import mixing, queries

SCHEMA = "doc_id long, text string, a string, b string, n long, __level0 string"
LEVELS = {"a": "a", "b": "b"}


def test_shortages_go_to_siblings_before_ancestors():
    tokens = {("w", "x"): 10, ("w", "y"): 100, ("c", "x"): 100}
    assert mixing.budgets(tokens, {}, 100) == {("w", "x"): 10, ("w", "y"): 40, ("c", "x"): 50}
    assert mixing.budgets(tokens, {("w",): 9.0}, 200) == {("w", "x"): 10, ("w", "y"): 100, ("c", "x"): 90}
    assert mixing.budgets(tokens, {("w", "y"): 0.0}, 100) == {("w", "x"): 10, ("w", "y"): 0, ("c", "x"): 90}
    assert mixing.budgets(tokens, {}, 10_000, 3) == {k: 3 * v for k, v in tokens.items()}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.tuples(st.sampled_from([0.0, 0.5, 1.0, 3.0]), st.integers(0, 10**5)), min_size=1, max_size=12))
def test_water_fill(amount, parts):
    weights, room = [w for w, _ in parts], [r for _, r in parts]
    out = mixing.water_fill(amount, weights, room)
    assert all(0 <= o <= r for o, r in zip(out, room, strict=True))
    assert sum(out) == min(amount, sum(r for w, r in parts if w))
    open_ = [(o / w) for o, w, r in zip(out, weights, room, strict=True) if w and o < r]
    for o, w, r in zip(out, weights, room, strict=True):  # nobody full has more per weight than those with room left
        if w and o == r and open_:
            assert o / w <= max(open_) + 3 / min(x for x in weights if x)


def brute(rows, weights, total, epochs, seed):
    """(id, leaf, epoch) counts, by sorting each leaf."""
    leaves = defaultdict(list)
    for i, a, b, n in rows:
        leaves[(a or "", b or "")].append((i, max(0, n or 0)))
    plan = mixing.budgets({k: sum(n for _, n in v) for k, v in leaves.items()}, weights, total, epochs)
    return plan, {k: sum(n for _, n in v) for k, v in leaves.items()}


@pytest.mark.parametrize("most", [200_000, 0])
@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (0.9, 3), (2.0, 3)])
def test_prefixes_by_brute_force(spark, monkeypatch, share, epochs, most):
    """With budgets made on the driver, and in a task per node."""
    monkeypatch.setattr(mixing, "MAX_LEAVES", most)
    rows = [(k, f"t{k}", "wc"[k % 3 == 0], "xyz"[k % 7 % 3] if k % 11 else None, k * 37 % 101, "") for k in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = {("w",): 2.0, ("c",): 1.0, ("w", "x"): 4.0}
    from pyspark.sql import functions as F

    total = int(share * sum(r[4] for r in rows))
    got = mixing.mix(docs, LEVELS, weights, total=total, max_epochs=epochs, tokens=F.col("n")).collect()
    plan, held = brute([(r[0], r[2], r[3], r[4]) for r in rows], weights, total, epochs, mixing.SEED)
    order = {(r.doc_id, r.e): r.h & (2**64 - 1) for e in range(epochs + 1) for r in docs.select("doc_id", F.lit(e).alias("e"), F.xxhash64(F.lit(mixing.SEED), F.lit(e).cast("long"), "doc_id").alias("h")).collect()}
    want = set()
    for leaf, budget in plan.items():
        own = [(r[0], r[4]) for r in rows if (r[2], r[3] or "") == leaf]
        if not held[leaf] or not budget:
            continue
        whole, rest = divmod(budget, held[leaf])
        want |= {(i, e) for i, _ in own for e in range(whole)}
        at = 0
        for i, n in sorted(own, key=lambda d: (order[d[0], whole], d[0])):
            at += n
            if not rest or at > rest:
                break
            want.add((i, whole))
    assert {(r.doc_id, r.epoch) for r in got} == want and len(got) == len(want)
    assert got[0].asDict().keys() == {"doc_id", "text", "a", "b", "n", "__level0", "epoch"}


def test_edge_rows(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), LEVELS, {}, share=0.5).collect() == []
    rows = [(1, None, "p", "q", None, ""), (2, "", "p", "r", None, ""), (3, "one two", None, None, None, ""), (3, "one two", None, None, None, ""), (None, "a b c", "p", "q", None, ""), (4, "w " * 9000, "p", "z", None, "")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), LEVELS, {}, share=1.0).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "3", "4", "None"]
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([], SCHEMA), LEVELS, {})


def test_names_of_ours(spark):
    """Columns named as the operator's own keep their values, and the epoch gets another name."""
    names = ["doc_id", "text", "a", "b", "epoch", "__tokens", "__epochs", "__order", "c0", "__taken"]
    rows = [(k, "some words here", "p", "q" if k % 3 else None, 90 + k, "t", "e", k, "c", None) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, epoch long, __tokens string, __epochs string, __order long, c0 string, __taken boolean")
    out = mixing.mix(docs, LEVELS, {}, share=1.5, max_epochs=2)
    assert out.columns == [*names, "epoch_"] and out.count() == 60 and out.select(*names).exceptAll(docs.unionAll(docs)).isEmpty()
    assert {(r.doc_id, r.epoch) for r in out.collect()} <= {(k, 90 + k) for k in range(40)} and {r.epoch_ for r in out.collect()} == {0, 1}
    assert mixing.mix(docs, LEVELS, {}, share=1.0, epoch_col=None).columns == names


def by_hand(docs, levels, weights, share, epochs, seed, order):
    """What the query must take, without any of the module: budgets level by level, prefixes by sorting."""
    held, rows = defaultdict(int), defaultdict(list)
    for i, leaf, n in docs:
        held[leaf] += n
        rows[leaf].append((i, n))

    def room(path):
        return sum(n * epochs for leaf, n in held.items() if leaf[: len(path)] == path)

    def pour(amount, kids):
        """Shares by weight; whoever is full leaves, and the others share anew."""
        out, open_ = dict.fromkeys(kids, Fraction(0)), [k for k in kids if room(k)]
        left = min(Fraction(amount), Fraction(sum(map(room, open_))))
        while open_ and left > 0:
            total = sum(Fraction(weights.get(k, 1)) for k in open_)
            full = [k for k in open_ if room(k) - out[k] <= left * Fraction(weights.get(k, 1)) / total]
            if not full:
                for k in open_:
                    out[k] += left * Fraction(weights.get(k, 1)) / total
                break
            for k in full:
                left -= room(k) - out[k]
                out[k] = Fraction(room(k))
            open_ = [k for k in open_ if k not in full]
        return out

    given = {(): Fraction(int(share * sum(held.values())))}
    for depth in range(levels):
        for node in [p for p in given if len(p) == depth]:
            given.update(pour(given[node], sorted({leaf[: depth + 1] for leaf in held if leaf[:depth] == node})))
    sure, unsure = Counter(), set()
    for leaf in held:
        whole, rest = divmod(given[leaf], held[leaf]) if held[leaf] else (0, 0)
        for i, _ in rows[leaf]:
            sure[i] += int(whole)
        at = 0
        for i, n in sorted(rows[leaf], key=lambda d: (order(seed, int(whole), d[0]), d[0])):
            at += n
            if abs(at - rest) <= levels + 1:  # shares are whole numbers there and fractions here
                unsure.add(i)
            if at > rest:
                break
            sure[i] += 1
    return sure, unsure


def test_query(spark, sf_dir):
    from tokenizers import Tokenizer

    from augury.llm.tokens import default_tokenizer

    out = queries.op7_mixing(spark, sf_dir)
    assert out.columns == ["doc_id", "domain", "lang", "source", "tokens", "epoch"]
    rows = out.collect()
    library = Tokenizer.from_file(default_tokenizer())
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {k: len(library.encode(r.text or "", add_special_tokens=False).ids) for k, r in docs.items()}
    assert all(r.tokens == ids[r.doc_id] and r.source == docs[r.doc_id].source and r.lang == docs[r.doc_id].lang for r in rows)
    domain = {k: "curated" if int("".join(c for c in r.source if c.isdigit()) or 0) >= 10 else "web" for k, r in docs.items()}
    hashes = {(r.e, r.doc_id): r.h % 2**64 for e in range(3) for r in spark.createDataFrame([(k,) for k in docs], "doc_id long").selectExpr(f"{e} AS e", "doc_id", f"xxhash64({mixing.SEED}, CAST({e} AS LONG), doc_id) AS h").collect()}
    leaves = [(k, (domain[k], r.lang or "", r.source or ""), ids[k]) for k, r in docs.items()]
    sure, unsure = by_hand(leaves, 3, {("web", "en"): 3, ("curated", "en"): 3}, 0.6, 2, mixing.SEED, lambda seed, e, i: hashes[e, i])
    got = Counter(r.doc_id for r in rows)
    assert {k for k in docs if got[k] != sure[k]} <= unsure and len(unsure) < 0.1 * len(docs)
    assert 0.3 < sum(r.tokens for r in rows) / sum(ids.values()) <= 0.6


def slow_fill(amount, weights, room):
    """water_fill round by round."""
    out, active = [0] * len(weights), [k for k, w in enumerate(weights) if w > 0 and room[k] > 0]
    left = min(amount, sum(room[k] for k in active))
    while active:
        total = sum(weights[k] for k in active)
        full = [k for k in active if room[k] * total <= left * weights[k]]
        if not full:
            exact = {k: left * weights[k] / total for k in active}
            for k in active:
                out[k] = int(exact[k])
            for k in sorted(active, key=lambda k: (int(exact[k]) - exact[k], k))[: left - sum(out[k] for k in active)]:
                out[k] += 1
            break
        for k in full:
            out[k] = room[k]
            left -= room[k]
        active = [k for k in active if k not in full]
    return out


def test_water_fill_equals_rounds_and_is_fast():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(0, 9)
        weights = [rng.choice([0.0, 0.5, 1.0, 3.0]) for _ in range(n)]
        room = [rng.choice([0, 1, 7, rng.randint(0, 1000)]) for _ in range(n)]
        amount = rng.randint(0, 1500)
        got = mixing.water_fill(amount, weights, room)
        assert got == slow_fill(amount, weights, room)
        assert sum(got) == min(amount, sum(r for r, w in zip(room, weights, strict=True) if w > 0))
    began = time.perf_counter()
    many = mixing.water_fill(10**9, [1.0 + k % 7 for k in range(200_000)], [k % 20_000 for k in range(200_000)])
    assert time.perf_counter() - began < 2 and sum(many) == 10**9


def test_a_node_with_many_children_by_windows(spark):
    rng = random.Random(9)
    tokens = {("web", f"s{k:05d}"): rng.randint(0, 500) for k in range(3000)} | {("book", "x"): 900_000}
    leaves = spark.createDataFrame([(*p, n) for p, n in tokens.items()], "a string, b string, n long")
    weights = {("book",): 2.0, ("web", "s00007"): 4.0, ("web", "s00010"): 0.0}
    for total in (10_000, 700_000, 5_000_000):
        want = mixing.budgets(tokens, weights, total)
        got = {(r.a, r.b): r.given for r in mixing.budget_table(leaves, ["a", "b"], weights, total).collect()}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
