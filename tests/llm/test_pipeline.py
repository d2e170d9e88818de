"""The pipeline against a brute-force version of each stage, on the stage's own input."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from augury.llm import mixing, quality
from augury.llm.common import scratch_table
from augury.llm.token_counts import measured
from tests.llm.test_neardup import brute_components
from tests.llm.test_tokens_files import check_packing


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch_table(stage(spark, out[-1], sf_dir), name))
    return out


def test_stages(spark, sf_dir, stages):
    from tokenizers import Tokenizer

    from augury.llm.tokens import default_tokenizer

    assert all(s.columns == stages[0].columns for s in stages[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in stages[:-1]]
    assert all(len(a) <= len(b) and a.items() <= b.items() for a, b in zip(rows[1:], rows, strict=False))
    good = quality.quality_stats(stages[0]).filter("kept").collect()
    assert {r.doc_id for r in good} == set(rows[1])
    last = {}
    for i in sorted(rows[1]):
        last[rows[1][i].text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))] = i
    assert set(last.values()) == set(rows[2])
    least = brute_components({i: r.text for i, r in rows[2].items()})
    assert set(least.values()) == set(rows[3])
    sized = measured(stages[3].select("doc_id", *[F.expr(e).alias(n) for n, e in corpus_pipeline.LEVELS.items()], "text"), "text", "n").collect()
    held = defaultdict(int)
    for r in sized:
        held[(r.domain, r.lang, r.source)] += r.n
    plan = mixing.budgets(held, corpus_pipeline.WEIGHTS, int(corpus_pipeline.SHARE * sum(held.values())))
    got = defaultdict(int)
    most = defaultdict(int)
    for r in sized:
        most[(r.domain, r.lang, r.source)] = max(most[(r.domain, r.lang, r.source)], r.n)
        got[(r.domain, r.lang, r.source)] += r.n * (r.doc_id in rows[4])
    assert all(got[k] <= plan[k] for k in plan)
    assert all(plan[k] - got[k] < most[k] for k in plan)
    check_packing(Tokenizer.from_file(default_tokenizer()), [(i, r.text) for i, r in rows[4].items()], stages[-1].collect(), 0, (1024, 64, 1024))


def test_run_and_empty(spark, sf_dir, stages, tmp_path):
    run = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "start", "length", "ids"]
    assert run.select(key).exceptAll(stages[-1].select(key)).isEmpty() and run.count() == stages[-1].count()
    stages[0].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_nulls_repeats_and_clashing_names(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, row long, fp long, component_id long, epoch long, keep_id long, words string"
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(i, t, lang, src, *[None] * 7, "own") for i, t, lang, src in [(1, text, "en", "src1"), (1, text, "en", "src1"), (2, text.upper(), None, None), (None, text + " more", "en", "x"), (3, None, "en", "src2"), (4, "", None, "src3")]]
    rows += [(10 + k, " ".join(f"v{k}-{j}" for j in range(90)), "de" if k % 2 else None, f"src{k % 3 * 9}", *[None] * 5, 7, 8, "own") for k in range(30)]
    docs = spark.createDataFrame(rows, schema)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
        assert docs.columns == before.columns, name
        assert docs.exceptAll(before).isEmpty(), name  # the user's values, also in columns named as the operators' own
    assert {r.doc_id for r in docs.collect() if r.doc_id and r.doc_id < 10} <= {1, 2} and 20 < docs.count() < 32
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
