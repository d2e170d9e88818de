import math
import zlib
from collections import Counter

import numpy as np
import pytest

from augury.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string, held_out string, score string"


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_language_id(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    hits = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out and r.lang_pred != "und":
            hits.append(r.lang_pred == docs[r.doc_id].lang)
    assert len(hits) > 200 and np.mean(hits) > 0.97


def gram_counts(text):
    """Buckets of all 1- to 3-grams of a text between blanks, with plain integers: nothing here is the module's."""
    points, out = [ord(c) for c in f" {text} ".lower()], Counter()
    for n in (1, 2, 3):
        for k in range(len(points) - n + 1):
            h = n
            for point, factor in zip(points[k : k + n], (2654435761, 2246822519, 3266489917), strict=False):
                h = (h ^ point) * factor % 2**32
                h ^= h >> 15
            out[h % 32768] += 1
    return out


def brute_train(rows):
    """rows of (text, language): {language: (log prior, log-probability of a bucket)}"""
    out = {}
    for lang in {r[1] for r in rows}:
        own = [t for t, x in rows if x == lang]
        counts = sum((gram_counts(t or "") for t in own), Counter())
        total = sum(counts.values()) + 0.5 * 32768
        out[lang] = (math.log(len(own) / len(rows)), lambda b, counts=counts, total=total: math.log((counts[b] + 0.5) / total))
    return out


def brute_scores(model, text):
    grams = gram_counts(text)
    return {lang: prior + sum(n * log_p(b) for b, n in grams.items()) for lang, (prior, log_p) in model.items()}


@pytest.mark.parametrize("block", [1 << 20, 64, 7])
def test_training_and_scores_by_brute_force(spark, monkeypatch, block):
    """Also with texts cut into blocks: every n-gram counts once, wherever a border lies."""
    monkeypatch.setattr(langid, "BLOCK_CHARS", block)
    rng = np.random.default_rng(4)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 9)))
    kinds = {"x": "abcdeéß", "y": "efghij", "z": "日本語abc"}
    rows = [(" ".join(word(kinds[lang]) for _ in range(rng.integers(0, 60))), lang) for lang in rng.choice(list(kinds), 60, p=[0.6, 0.3, 0.1])] + [("X" * 500, "x"), (None, "y")]
    want = brute_train(rows)
    # The training side runs in workers, which don't see the patched size, so its pieces are called here.
    counts, texts = np.zeros((3, langid.BUCKETS)), np.zeros(3)
    for k, lang in enumerate("xyz"):
        texts[k] = sum(r[1] == lang for r in rows)
        for part in langid._blocks([t or "" for t, x in rows if x == lang]):
            for buckets, _ in langid._grams(*part):
                counts[k] += np.bincount(buckets, minlength=langid.BUCKETS)
    model = langid.Model(list("xyz"), counts, texts)
    trained = langid.train(spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string"))
    assert trained.languages == model.languages and np.allclose(trained.log_probs, model.log_probs) and np.allclose(trained.log_priors, model.log_priors)
    asked = [t for t, _ in rows if t] + ["Some text", "é", "x" * 500 + "yz", "ab " * 100, "日本"]
    got = model.score(asked)
    for row, text in zip(got, asked, strict=True):
        scores = brute_scores(want, text)
        assert np.allclose(row, [scores[lang] for lang in "xyz"], rtol=1e-4, atol=1e-3)
    langs, shares = model.predict(asked)
    for text, lang, share in zip(asked, langs, shares, strict=True):
        scores = brute_scores(want, text)
        best = max(scores.values())
        assert scores[lang] > best - 0.05 * abs(best) / 100 - 1e-2
        assert abs(share - 1 / sum(math.exp(min(50.0, v - scores[lang])) for v in scores.values())) < 0.05


def test_ties_repeated_and_null_ids(spark):
    rows = [(None, "aa bb", "x"), (None, "aa bb", "y"), (None, "aa bb", "y"), (None, "aa bb", "x"), (7, "aa", None), (7, "aa", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 6 and {r.lang_pred for r in got} == {"x"}  # equal priors and counts: the first in order
    many = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('word ', id) AS text", "'x' AS lang")
    used = langid.train(many, train_rows=200)
    assert used.languages == ["x"]


def test_an_unclean_label_column_is_refused_first(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 10)
    monkeypatch.setattr(langid, "_train_side", lambda *a: 1 / 0)
    with pytest.raises(ValueError, match="more than 10"):
        langid.train(spark.range(50).selectExpr("id AS doc_id", "'text' AS text", "CAST(id AS STRING) AS lang"))


def test_edge_rows(spark):
    rows = [(1, None, None, "", ""), (2, "", "en", "", ""), (3, "123 !? ½", "en", "", ""), (4, "the cat and the dog", "en", "", ""), (5, "der hund und die katze", "de", "", ""), (5, "der hund und die katze", "de", "", ""), (None, "der die das und", None, "", ""), (9, "the and of " * 5000, None, "", ""), (10, "der und die", "de", "", ""), (11, "the of and", "en", "", "")]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got == [] or Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1] == by[2] == by[3] == "und" and by[9] == "en" and by[None] == "de"
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    unlabelled = langid.identify(spark.createDataFrame([(1, "some words", None, "", "")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_training_bound(spark):
    rows = [(k, "aaa bbb" if k % 2 else "ccc ddd", "x" if k % 2 else "y", "", "") for k in range(2000)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA), train_rows=200)
    assert model.languages == ["x", "y"] and model.predict(["aa bb", "cc dd"])[0] == ["x", "y"]
