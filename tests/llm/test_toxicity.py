"""The grammar on clauses, its composition against the parts, matching, learning and held-out quality, edge rows."""

import itertools
import random
import re

import pytest

from augury.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string, score string, held_out string, toxic string"
LEXICON = T.Lexicon(stems={"vequ": 3.0}, words={"idiot": 5.0, "scum": 4.0})


def told(text):
    return dict(zip(T.FEATURES, T.features(text, LEXICON), strict=True))


@pytest.mark.parametrize(
    ("text", "context"),
    [
        ("the idiot sat there", "plain"), ("you are an idiot", "targeted"), ("such an idiot, and you know", "plain"), ("idiot you", "targeted"),
        ("he is not an idiot", "negated"), ("not at all far away the idiot", "plain"), ("she said the idiot left", "reported"), ('they wrote "idiot" there', "reported"),
        ("she said it. the idiot left", "plain"), ("vequétion tu", "targeted"), ("er sagte scum", "reported"), ("kein idiot", "negated"), ("no es idiot", "negated"),
    ],
)
def test_contexts(text, context):
    got = told(text)
    assert got[context] > 0 and all(got[c] == 0 for c in T.CONTEXTS if c != context), got


def test_threats_need_somebody_and_are_not_denied():
    assert told("i will kill you")["threats"] > 0 and told("du wirst sterben, ich werde dich töten")["threats"] > 0
    assert told("to kill time")["threats"] == told("he said he will kill")["threats"] == told("will never hurt")["threats"] == 0


def test_matches_are_anchored_to_words():
    spans = lambda t: [t[a:b] for a, b, _ in LEXICON.matches(t)]
    assert spans("idiot idiots an_idiot xidiot idiot! l'idiot") == ["idiot", "idiot", "idiot"]
    assert spans("vequ vequé avequ -vequxyz") == ["vequ", "vequ", "vequ"]
    assert T.Lexicon().matches("anything") == []


def test_composition_says_what_its_parts_say():
    rng = random.Random(1)
    parts = [T.automaton(2, {(0, 1): 1, (1, 2): 0}, {(1, 3): "a"}, {1: "f"}), T.automaton(3, {(0, 1): 2}, {(2, 3): "b", (1, 1): "c"}, {0: "g"}, {2: 1, 1: 0})]
    both = T.compose(parts)
    for _ in range(300):
        states, state = [0, 0], 0
        for s in (rng.randrange(8) for _ in range(12)):
            want = frozenset().union(*(p.output[q][s] for p, q in zip(parts, states, strict=True)))
            assert both.output[state][s] == want
            states, state = [p.next_state[q][s] for p, q in zip(parts, states, strict=True)], both.next_state[state][s]
        assert both.final[state] == frozenset().union(*(p.final[q] for p, q in zip(parts, states, strict=True)))


def test_clauses_are_disjoint_and_hold_each_match_once():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["idiot", "scum", "a", " ", ", ", ".", "word" * 30, "x" * 250]) for _ in range(40))
        matches = LEXICON.matches(text)
        found = list(T.clauses(text, matches))
        assert list(itertools.chain(*(c[2] for c in found))) == matches
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(found))
        assert all(lo <= m[0] and m[1] <= hi and not re.search("[.;!?]", text[lo : m[0]]) for lo, hi, ms in found for m in ms[:1])


def corpus(n, seed=3):
    """English insults, and stems of an invented language; one text in five is toxic."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abdeorstu") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(30, 200))]
        if toxic := k % 5 == 0:
            for _ in range(rng.randint(3, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["jerk", "fool"]) if k % 2 else "zwog" + rng.choice("abdeorstu") * rng.randint(1, 3))
        rows.append((k, " ".join(words), "xx", "", "", ""))
        labels.append((k, int(toxic)))
    return rows, labels


def test_learns_words_and_stems_and_holds_out(spark):
    rows, labels = corpus(900)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(docs, marks)
    assert {"jerk", "fool"} <= set(model.lexicon.words) and "zwog" in model.lexicon.stems
    got = {r.doc_id: r for r in T.predict(docs, model).collect()}
    held = [k for k, r in got.items() if r.held_out]
    right = sum(got[k].predicted == labels[k][1] for k in held)
    assert 200 < len(held) < 400 and right >= 0.98 * len(held) and all(r.predicted == (r.score >= 0.7) for r in got.values())
    # Labels of held-out rows don't matter.
    flipped = spark.createDataFrame([(k, 1 - x if got[k].held_out else x) for k, x in labels], "doc_id long, toxic int")
    other = T.train(docs, flipped)
    assert other.lexicon == model.lexicon and (abs(other.coefficients - model.coefficients) < 1e-9).all()


def test_corpus_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = T.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_edge_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.classify(none, no_labels).collect() == []
    rows = [(1, None, "", "", "", "9"), (2, "", "", "", "", ""), (3, "you idiot, you moron " * 20_000, "", "", "", ""), (4, "a calm text", "", "", "", ""), (4, "a calm text", "", "", "", ""), (None, "you stupid loser, you scum", "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for labels in (no_labels, spark.createDataFrame([(1, 0), (4, 0), (4, 0), (2, None), (99, 1), (None, 1), (4, 7)], "doc_id long, toxic int")):
        got = T.classify(docs, labels).collect()
        by = {r.doc_id: r.score for r in got}
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and by[1] == by[2]
        assert by[3] > by[4] and by[None] > by[4]


def test_training_bound(spark):
    rows, labels = corpus(600)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    n = T.labelled_texts(docs, marks, "doc_id", "text", "toxic", 100).count()
    assert 60 < n < 150
