"""Toxicity by a weighted finite-state grammar of clauses.

Small automata read a clause word by word: one for insults, one for threats, one for whom the
clause addresses, one for negation and one for reported speech. Their composition is one
automaton, which says of each insult or threat in which context it stands. Insults are stems and
words with weights, learned as log-odds from labelled documents, so that they follow the corpus and
its languages; the other automata read function words of four languages. A document's features are
the weights of its matched clauses by context. A logistic regression, fitted on features that come
from the other half's lexicon, turns them into a score.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import batched_texts, release_memory, scratch_table, text_or_empty

#: About so many labelled rows are learned from, taken by a hash of the id; equal texts count once.
TRAIN_ROWS = 20_000
#: A lexicon has at most so many entries; stems have so many letters.
LEXICON, STEM = 512, (3, 10)
#: What is learned from is bounded by train_rows, and written as so few files.
FILES = 16
#: Words of so many letters tell near copies.
LONG = 8
#: An entry needs so many labelled documents, log-odds and a likelihood ratio (G squared) of at least this.
LEAST_DOCS, LEAST_ODDS, LEAST_G = 3, 1.5, 24.0
THRESHOLD = 0.7
#: A clause reaches so many characters from a match at most, a negation so many words.
REACH, SCOPE = 200, 3

# Function words of English, German, French and Spanish: fixed values.
NEGATIONS = "not no never isn't aren't nicht kein keine nie pas jamais ne nunca ni sin".split()
TARGETS = "you your you're they them those he she du dich dir ihr euch tu toi te vous ils elles tú usted ustedes ellos ellas".split()
REPORTS = "said says wrote writes called calls quoted quotes claimed sagte schrieb nannte dit écrit dijo escribió llamó".split()
MODALS = "will gonna shall must should werde wirst wird vais va vas voy debes".split()
THREATS = "kill hurt beat burn shoot destroy die töten umbringen verbrennen tuer frapper mourir matar golpear morir".split()
#: Known before any label, with the weight of each.
INSULTS = "idiot moron stupid scum loser".split()
SEED_WEIGHT = 4.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, MODAL = range(8)
SYMBOLS = range(8)
_WORDS = {w: s for s, words in ((NEGATION, NEGATIONS), (TARGET, TARGETS), (REPORT, REPORTS), (MODAL, MODALS), (THREAT, THREATS)) for w in words}
_WORD = re.compile(r"\w+(?:['’]\w+)?")
_PIECE = re.compile(r"\w+(?:['’]\w+)?|[\"“”„«»]")
_END = re.compile(r"[.!?;:,\n]")


@dataclass
class Automaton:
    """next_state[state][symbol], output[state][symbol], final[state]; outputs are frozen sets of marks."""

    next_state: list[list[int]]
    output: list[list[frozenset]]
    final: list[frozenset]


def automaton(states: int, moves: dict[tuple[int, int], int], marks: dict[tuple[int, int], str], final: dict[int, str], otherwise: dict[int, int] | None = None) -> Automaton:
    """States stay where no move is given, but for those with another successor in `otherwise`."""
    otherwise = otherwise or {}
    step = [[moves.get((q, s), otherwise.get(q, q)) for s in SYMBOLS] for q in range(states)]
    out = [[frozenset([marks[q, s]]) if (q, s) in marks else frozenset() for s in SYMBOLS] for q in range(states)]
    return Automaton(step, out, [frozenset([final[q]]) if q in final else frozenset() for q in range(states)])


def compose(parts: list[Automaton]) -> Automaton:
    """All parts read the same symbols; the composition's marks are the unions of theirs. Only states that can be reached are made."""
    number: dict[tuple[int, ...], int] = {}
    todo = [tuple(0 for _ in parts)]
    number[todo[0]] = 0
    step, out, final = [], [], []
    for state in todo:
        row = []
        for s in SYMBOLS:
            after = tuple(p.next_state[q][s] for p, q in zip(parts, state, strict=True))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        step.append(row)
        out.append([frozenset().union(*(p.output[q][s] for p, q in zip(parts, state, strict=True))) for s in SYMBOLS])
        final.append(frozenset().union(*(p.final[q] for p, q in zip(parts, state, strict=True))))
    return Automaton(step, out, final)


def grammar(scope: int = SCOPE) -> Automaton:
    insult = automaton(1, {}, {(0, INSULT): "insult"}, {})
    # A threat is a verb of harm after a modal or somebody addressed.
    threat = automaton(2, {(0, MODAL): 1, (0, TARGET): 1}, {(1, THREAT): "threat"}, {})
    target = automaton(2, {(0, TARGET): 1}, {}, {1: "targeted"})
    # State k: the negation reaches k more words.
    negation = automaton(
        scope + 1, {(k, NEGATION): scope for k in range(scope + 1)} | {(k, QUOTE): k for k in range(scope + 1)},
        {(k, s): "negated" for k in range(1, scope + 1) for s in (INSULT, THREAT)}, {}, {k: k - 1 for k in range(1, scope + 1)},
    )
    # 1: after a verb of saying, up to the clause's end; 2: within a quotation.
    report = automaton(
        3, {(0, REPORT): 1, (0, QUOTE): 2, (1, QUOTE): 2, (2, QUOTE): 0}, {(k, s): "reported" for k in (1, 2) for s in (INSULT, THREAT)}, {}
    )
    return compose([insult, threat, target, negation, report])


GRAMMAR = grammar()
CONTEXTS = ("plain", "targeted", "negated", "reported")
FEATURES = (*CONTEXTS, "threats", "rate", "length")
#: Of the features and the constant, before anything is learned.
PRIOR = np.array([1.5, 2.0, 0.5, 0.5, 1.0, 0.5, 0.0, -3.0])


@dataclass
class Lexicon:
    """Weights of stems, which any letters may follow, and of whole words."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {"stems": self.stems, "words": self.words}

    def matches(self, lowered: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each word's heaviest entry, in order."""
        if "_found" not in self.__dict__:
            found = ahocorasick.Automaton()
            for whole, entries in ((False, self.stems), (True, self.words)):
                for word, weight in entries.items():
                    known = found.get(word, ())
                    found.add_word(word, (*known, (len(word), whole, weight)))
            if len(found):
                found.make_automaton()
            self._found = found
        best: dict[int, tuple[int, float]] = {}
        if len(self._found):
            for last, entries in self._found.iter(lowered):
                for size, whole, weight in entries:
                    start, end = last + 1 - size, last + 1
                    if start and (lowered[start - 1].isalnum() or lowered[start - 1] == "_"):
                        continue
                    if whole and end < len(lowered) and (lowered[end].isalnum() or lowered[end] == "_"):
                        continue
                    if start not in best or weight > best[start][1]:
                        best[start] = end, weight
        return [(start, *best[start]) for start in sorted(best)]


def clauses(lowered: str, matches: list[tuple[int, int, float]]) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(start, end, matches) of each clause with a match; clauses do not overlap."""
    k, free = 0, 0
    while k < len(matches):
        start, end, _ = matches[k]
        low = max(free, start - REACH)
        begin = max((m.end() for m in _END.finditer(lowered, low, start)), default=low)
        stop = _END.search(lowered, end, end + REACH)
        stop = stop.start() if stop else min(len(lowered), end + REACH)
        inside = [matches[k]]
        while k + len(inside) < len(matches) and matches[k + len(inside)][1] <= stop:
            inside.append(matches[k + len(inside)])
        yield begin, stop, inside
        k, free = k + len(inside), stop


def read_clause(clause: str, weights: dict[int, float], machine: Automaton = GRAMMAR) -> tuple[dict[str, float], int]:
    """(weight by context, threats) of a clause; weights: of the insults by their start."""
    state, told, threats = 0, [], 0
    for m in _PIECE.finditer(clause):
        weight = weights.get(m.start())
        symbol = INSULT if weight is not None else QUOTE if m[0] in "\"“”„«»" else _WORDS.get(m[0].replace("’", "'"), OTHER)
        marks = machine.output[state][symbol]
        if "insult" in marks:
            told.append((weight, marks))
        threats += "threat" in marks and not marks & {"negated", "reported"}
        state = machine.next_state[state][symbol]
    sums: dict[str, float] = {}
    for weight, marks in told:
        context = "reported" if "reported" in marks else "negated" if "negated" in marks else "targeted" if "targeted" in machine.final[state] else "plain"
        sums[context] = sums.get(context, 0.0) + weight
    return sums, threats


_THREAT = re.compile(r"\b(?:" + "|".join(THREATS) + r")\b")


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """FEATURES of one text; a null text is empty."""
    lowered = (text or "").lower()
    sums, threats = dict.fromkeys(CONTEXTS, 0.0), 0
    matches = lexicon.matches(lowered)
    marked = {start for start, _, _ in matches}
    # Clauses are also read where only a verb of harm stands.
    harm = [(m.start(), m.end(), 0.0) for m in _THREAT.finditer(lowered) if m.start() not in marked]
    for begin, end, inside in clauses(lowered, sorted(matches + harm)):
        found, more = read_clause(lowered[begin:end], {a - begin: w for a, _, w in inside if a in marked})
        threats += more
        for context, weight in found.items():
            sums[context] += weight
    words = lowered.count(" ") + lowered.count("\n") + 1
    total = sum(sums.values())
    return [*(math.log1p(sums[c]) for c in CONTEXTS), math.log1p(threats), math.log1p(100 * total / words), math.log(words) / 10]


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray

    def score(self, texts: list[str | None]) -> list[float]:
        x = np.array([[*features(t, self.lexicon), 1.0] for t in texts]).reshape(-1, len(FEATURES) + 1)
        return (1 / (1 + np.exp(-np.clip(x @ self.coefficients, -30, 30)))).tolist()


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients of a logistic regression with a constant, drawn towards PRIOR."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (y - p) - ridge * (b - PRIOR)
        bend = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + ridge * np.eye(len(b))
        move = np.linalg.solve(bend, slope)
        move *= min(1.0, 2.0 / max(1e-9, np.abs(move).max()))  # no far jumps where classes are apart
        b = b + move
        if np.abs(move).max() < 1e-6:
            break
    return b


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is never used: crc32 of the id as text, modulo 3, is 1. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int) -> DataFrame:
    """text, toxic, half: about train_rows labelled texts, equal ones once (toxic if any of them is).

    The smallest hash of a text's long words deals it into a half, so that near copies mostly share one.
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    labels = labels.filter(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = labels.count()
    if rows > train_rows:
        labels = labels.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(train_rows / rows * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).filter("id IS NOT NULL")
    known = texts.join(F.broadcast(labels), "id")  # about train_rows small rows at most
    once = known.groupBy(F.sha2("text", 256).alias("digest")).agg(F.any_value("text").alias("text"), F.max("toxic").alias("toxic"))
    long_words = F.filter(F.split("text", r"\W+"), lambda w: F.char_length(w) >= LONG)
    dealt = F.coalesce(F.array_min(F.transform(long_words, lambda w: F.xxhash64(w))), F.xxhash64("digest"))
    return scratch_table(once.select("text", "toxic", F.pmod(dealt, F.lit(2)).cast("int").alias("half")).coalesce(FILES), "labelled")


def lexeme_counts(labelled: DataFrame) -> DataFrame:
    """word, stem, t0, c0, t1, c1: toxic and clean documents of each half with a word, summed over the words that begin with a stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {k: Counter() for k in range(4)}
        for batch in batches:
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[2 * half + 1 - toxic].update(set(_WORD.findall(text.lower())))
        seen = sorted(set().union(*counts.values()))
        columns = [pa.array([counts[k][w] for w in seen], pa.int64()) for k in range(4)]
        for at in range(0, len(seen), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(seen[part], pa.string()), *(c[part] for c in columns)], ["word", "t0", "c0", "t1", "c1"])

    sums = [F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")]
    words = batched_texts(labelled.select("text", "toxic", "half")).mapInArrow(run, "word string, t0 long, c0 long, t1 long, c1 long").groupBy("word").agg(*sums)
    size = F.char_length("word")
    stems = F.when(size >= STEM[0], F.transform(F.sequence(F.lit(STEM[0]), F.least(size, F.lit(STEM[1]))), lambda n: F.struct(F.substring("word", 1, n).alias("e"), F.lit(True).alias("stem"))))
    whole = F.array(F.struct(F.col("word").alias("e"), F.lit(False).alias("stem")))
    entries = words.select(F.explode(F.concat(whole, F.coalesce(stems, F.slice(whole, 1, 0)))).alias("x"), "t0", "c0", "t1", "c1")
    return entries.groupBy(F.col("x.e").alias("entry"), F.col("x.stem").alias("stem")).agg(*sums).filter(F.col("t0") + F.col("t1") >= LEAST_DOCS)


def _judged(t: Column, c: Column, all_t: int, all_c: int) -> tuple[Column, Column]:
    """(log-odds, G squared) of an entry with t toxic and c clean documents."""
    odds = F.log((t + 0.5) / (all_t + 1.0)) - F.log((c + 0.5) / (all_c + 1.0))
    n = t + c
    expected_t, expected_c = n * (all_t / (all_t + all_c)), n * (all_c / (all_t + all_c))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    return odds, 2 * (part(t, expected_t) + part(c, expected_c))


def learned_lexicon(counts: DataFrame, t: Column, c: Column, all_t: int, all_c: int, entries: int = LEXICON) -> Lexicon:
    """The entries that tell most. Of nested ones the most telling stays, of equally telling ones the longest, a whole word before its stem."""
    out = Lexicon(words=dict.fromkeys(INSULTS, SEED_WEIGHT))
    if not all_t or not all_c:
        return out
    odds, g = _judged(t, c, all_t, all_c)
    told = counts.select("entry", "stem", odds.alias("odds"), F.round(g, 6).alias("g"), t.alias("t")).filter((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_G) & (F.col("t") >= LEAST_DOCS))
    rows = told.orderBy(F.desc("g"), F.desc(F.char_length("entry")), "stem", "entry").limit(8 * entries).collect()
    taken: list[str] = []
    for r in rows:
        nested = any(e.startswith(r.entry) or r.entry.startswith(e) for e in taken)
        if nested or len(taken) >= entries:
            continue
        taken.append(r.entry)
        (out.stems if r.stem else out.words)[r.entry] = r.odds
    return out


def _features_of(labelled: DataFrame, lexicons: list[Lexicon]) -> tuple[np.ndarray, np.ndarray]:
    """Features by the lexicon of the other half, and labels; a row for each labelled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic, half = (c.to_pylist() for c in batch.columns)
            rows = [features(t, lexicons[1 - h]) for t, h in zip(texts, half, strict=True)]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.float64()), *columns], ["toxic", *FEATURES])

    schema = ", ".join(f"{c} double" for c in ("toxic", *FEATURES))
    found = batched_texts(labelled.select("text", "toxic", "half")).mapInArrow(run, schema).toPandas()  # bounded by train_rows
    return found[list(FEATURES)].to_numpy().reshape(-1, len(FEATURES)), found["toxic"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Learns a lexicon and coefficients from rows that are not held out. With labels of one kind only, or none, what is known before stays."""
    labelled = labelled_texts(docs, labels, id_col, text_col, label_col, train_rows)
    sizes = {(r.half, r.toxic): r["count"] for r in labelled.groupBy("half", "toxic").count().collect()}
    counts = scratch_table(lexeme_counts(labelled).coalesce(FILES), "lexemes")
    both = counts.filter("t0 > 0 AND t1 > 0")  # what one group of near copies says is no rule
    n = {(h, x): sizes.get((h, x), 0) for h, x in itertools.product((0, 1), (0, 1))}
    halves = [learned_lexicon(counts, F.col(f"t{h}"), F.col(f"c{h}"), n[h, 1], n[h, 0]) for h in (0, 1)]
    whole = learned_lexicon(both, F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), n[0, 1] + n[1, 1], n[0, 0] + n[1, 0])
    if not sum(sizes.values()):
        return Model(whole, PRIOR)
    return Model(whole, fitted(*_features_of(labelled, halves)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; a row per input row. Null texts score as empty ones, repeated rows each get a row, other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON entries and a few coefficients

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.score(batch.column(2).to_pylist()), pa.float64())
            predicted = pa.array([int(s >= THRESHOLD) for s in scores.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores, predicted], ["doc_id", "held_out", "score", "predicted"])
            release_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return batched_texts(rows).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Trains on the labels of rows that are not held out and scores all documents: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Of several labels for an id the largest counts; labels that are null or no 0 or 1 are ignored,
    as are labels without a document. An empty table gives no rows.
    """
    return predict(docs, train(docs, labels, id_col, text_col, label_col, train_rows), id_col, text_col)
