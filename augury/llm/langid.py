"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of each language, summed per partition before they are
shuffled; the matrix of log-probabilities has (languages x BUCKETS) entries whatever the input's
size and is broadcast. Scoring works on batches of texts: the n-grams of all texts of a block are
hashed as one array, counted per text as a sparse matrix (text, bucket, count), and multiplied
with the matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import batched_texts, release_memory

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: About so many labelled rows are fitted on, taken by a hash of the id.
TRAIN_ROWS = 20_000
MAX_LANGUAGES = 512
UNKNOWN = "und"
BLOCK_CHARS = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
#: Multipliers of the n-gram hash: odd constants below 2**32.
_MIX = (2654435761, 2246822519, 3266489917)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(code points, number of the text of each, points that belong to the block before).

    A long text is in several blocks, each after the first with the last two points of the one before.
    """
    points, owner, size = [], [], 0
    for k, text in enumerate(texts):
        p = _points(f" {text} ")
        if size and size + len(p) > BLOCK_CHARS:
            yield np.concatenate(points), np.concatenate(owner), 0
            points, owner, size = [], [], 0
        if len(p) <= BLOCK_CHARS:
            points.append(p)
            owner.append(np.full(len(p), k, np.int32))
            size += len(p)
            continue
        for at in range(0, len(p), BLOCK_CHARS):
            before = min(at, max(ORDERS) - 1)
            part = p[at - before : at + BLOCK_CHARS]
            yield part, np.full(len(part), k, np.int32), before
    if points:
        yield np.concatenate(points), np.concatenate(owner), 0


def _grams(points: np.ndarray, owner: np.ndarray, before: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of the n-grams that lie within one text and end behind the first `before` points, order by order."""
    for n in ORDERS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ points[k : k + m]) * np.uint32(_MIX[k])
            h ^= h >> np.uint32(15)
        inside = owner[:m] == owner[n - 1 :]
        inside[: max(0, before - n + 1)] = False  # those were in the block before
        yield (h & np.uint32(BUCKETS - 1))[inside].astype(np.int64), owner[:m][inside].astype(np.int64)


def _train_side(spark_docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs.tolist())):
                of = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for block in _blocks([texts[k] for k in np.flatnonzero(langs == lang)]):
                    for buckets, _ in _grams(*block):
                        of += np.bincount(buckets, minlength=BUCKETS)
        for lang, of in counts.items():
            used = np.flatnonzero(of)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(of[used])], ["lang", "bucket", "n"])

    rows = spark_docs.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return batched_texts(rows).mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, the logarithms of their shares of the texts, and a float32 matrix of log-probabilities (buckets, languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray, texts: np.ndarray | None = None):
        self.languages = languages
        texts = np.ones(len(languages)) if texts is None else np.asarray(texts, float)
        self.log_priors = np.log(texts / texts.sum()) if len(languages) else np.zeros(0)
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True) if languages else np.zeros((0, BUCKETS))
        self.log_probs = np.ascontiguousarray(np.log(share).T.astype(np.float32))

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-posteriors (texts x languages), up to a constant: the prior and all n-grams of each text."""
        out = np.tile(self.log_priors, (len(texts), 1))
        for block in _blocks(texts):
            for buckets, of in _grams(*block):
                first = int(of[0]) if len(of) else 0
                cells = (of - first) * BUCKETS + buckets
                width = (int(of[-1]) - first + 1) * BUCKETS if len(of) else 0
                if width <= 8 * len(cells) + BUCKETS:  # counts as one dense stripe, read sparsely
                    dense = np.bincount(cells, minlength=width)
                    used = np.flatnonzero(dense)
                    n = dense[used]
                else:
                    used, n = np.unique(cells, return_counts=True)
                rows = used // BUCKETS
                value = self.log_probs[used % BUCKETS] * n[:, None].astype(np.float32)
                starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else []
                if len(rows):
                    out[rows[starts] + first] += np.add.reduceat(value, starts, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its share among all."""
        lettered = [k for k, t in enumerate(texts) if has_letter(t)]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if lettered and self.languages:
            logs = self.score([texts[k] for k in lettered])
            logs -= logs.max(axis=1, keepdims=True)
            share = np.exp(logs)
            share /= share.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            for k, b, s in zip(lettered, best.tolist(), share[np.arange(len(best)), best].tolist(), strict=True):
                langs[k], scores[k] = self.languages[b], min(1.0, s)
        return langs, scores


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Fits the model on about train_rows of the rows with a language, chosen by a hash of id and text.

    A language's prior is its share of the rows fitted on. The counts that reach the driver have at
    most (languages x BUCKETS) entries: more than MAX_LANGUAGES languages, which a label column that
    is no language has, are refused before anything is collected. Without labelled rows the model
    knows no language.
    """
    labelled = labelled.filter(F.col(lang_col).isNotNull())
    rows = labelled.select(lang_col).count()
    if rows > train_rows:
        share = int(train_rows / rows * (1 << 30))
        labelled = labelled.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) < share)
    texts = labelled.groupBy(F.col(lang_col).cast("string").alias("lang")).count().limit(MAX_LANGUAGES + 1).collect()
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in texts)
    row = {lang: k for k, lang in enumerate(languages)}
    priors = np.zeros(len(languages))
    for r in texts:
        priors[row[r["lang"]]] = r["count"]
    found = _train_side(labelled, lang_col, text_col).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["lang"].map(row).to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy()
    return Model(languages, counts, priors)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never trained on: crc32 of the id as text, modulo 4, is 2. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: list[Column] | None = None) -> DataFrame:
    """doc_id, the extra columns, lang_pred and score, a row per input row.

    Texts that are null or have no letter get UNKNOWN and 0; so does every text if the model knows
    no language. Ties go to the first language in order. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores = [], []
            for at in range(0, len(texts), 256):
                some = shared.value.predict(texts[at : at + 256])
                langs += some[0]
                scores += some[1]
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])
            release_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), *(extra or []), F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return batched_texts(rows).mapInArrow(run, f"{kept}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Trains on the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out(id_col)), lang_col, text_col, id_col, train_rows)
    return predict(docs, model, id_col, text_col, [held_out(id_col).alias("held_out")])
