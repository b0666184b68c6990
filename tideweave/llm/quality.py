"""Quality classifier: a naive Bayes support vector machine.

Features are indicators of n-grams: of words, and of word shapes (letters, digits and marks reduced to their class,
runs shortened), the latter also of their share of the text, so that a long text doesn't hold every indicator.
Indicators are scaled by the log-count ratios of the classes; a hinge loss is fitted by dual coordinate descent; a
logistic curve turns margins into scores. The model is fitted on a bounded sample of labelled rows (TRAIN_ROWS for
each class); every whole text is scored, in one pass, without a shuffle.

Defined results: null and empty texts have no indicators and get the score of the bias; a null doc_id isn't held
out; of repeated labels of a document the highest counts, null labels don't; without labels of both classes every
score is 0.5; repeated documents each have a row; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.llm.common import small_batches, table
from tideweave.llm.linear import chance, dual_coordinate_descent, platt

#: Labelled rows of each class that the model is fitted on, at most.
TRAIN_ROWS = 2000
#: Indicators are hashed to this many places.
PLACES = 1 << 18
#: Shares of a text above which an n-gram of shapes has a further indicator.
SHARES = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4)
#: Longest n-gram of shapes.
ORDER = 5

_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 1 if _c >= 128 or "a" <= _ch <= "z" else 2 if "A" <= _ch <= "Z" else 3 if "0" <= _ch <= "9" else 4 if _ch in " \t\r" else 5 if _ch == "\n" else 6 + (_c % 58)


def indicators(text: str | None) -> np.ndarray:
    """Sorted places of a text's indicators."""
    if not text:
        return np.zeros(0, np.int32)
    raw = text.encode("utf-8", "surrogatepass")
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    shape = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])].astype(np.uint64)
    found: list[np.ndarray] = []

    def share(code: np.ndarray, part: np.ndarray, salt: int) -> None:
        level = np.searchsorted(SHARES, part, side="right").astype(np.uint64)
        for k in range(len(SHARES) + 1):
            held = code[level >= k]
            found.append(((held * np.uint64(2 * len(SHARES) + 3) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(46))

    grams = np.zeros(len(shape), np.uint64)
    for n in range(1, ORDER + 1):
        if len(shape) < n:
            break
        grams = grams[: len(shape) - n + 1] * np.uint64(64) + shape[n - 1 :]
        code, count = np.unique(grams, return_counts=True)
        share(code, count / len(grams), n)
    words = raw.lower().split()
    if words:
        seen = set(words)
        same = sum(map(bytes.__eq__, words, words[1:]))
        lines = [x for x in raw.split(b"\n") if x]
        parts = [same / len(words), 1 - len(seen) / len(words), 1 - len(set(lines)) / max(1, len(lines)), max(map(len, words)) / max(1, len(raw))]
        share(np.arange(len(parts), dtype=np.uint64), np.array(parts), 90)
        found.append(np.fromiter(map(zlib.crc32, seen), np.uint64, len(seen)) % np.uint64(PLACES))
    return np.unique(np.concatenate(found)).astype(np.int32)


class Model:
    """fit() on indicator lists; margins of new ones."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, cost: float = 0.1):
        self.weights, self.bias, self.curve = np.zeros(PLACES, np.float32), 0.0, (1.0, 0.0)
        if len(set(y.tolist())) < 2:
            return
        fold = np.arange(len(y)) % 4 == 3  # for the curve, margins of rows that the weights haven't seen
        if len(set(y[fold].tolist())) == 2 and len(set(y[~fold].tolist())) == 2:
            w, b = self._weights([rows[i] for i in np.flatnonzero(~fold)], y[~fold], alpha, cost)
            unseen = [rows[i] for i in np.flatnonzero(fold)]
            self.curve = platt(np.array([w[r].sum() / max(1.0, len(r) ** 0.5) + b for r in unseen]), y[fold])
        self.weights, self.bias = self._weights(rows, y, alpha, cost)

    @staticmethod
    def _weights(rows, y, alpha, cost):
        sizes = np.array([len(r) for r in rows])
        index = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        of = np.repeat(y, sizes)
        p = np.bincount(index[of > 0], minlength=PLACES) + alpha
        q = np.bincount(index[of == 0], minlength=PLACES) + alpha
        ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        norm = 1 / np.sqrt(np.maximum(sizes, 1))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        value = ratio[index] * np.repeat(norm, sizes)
        balance = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
        w = dual_coordinate_descent(starts, index, value, np.where(y > 0, 1.0, -1.0), PLACES, cost * balance)
        return (w[:-1] * ratio).astype(np.float32), float(w[-1])

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum()) / max(1.0, float(np.sqrt(len(row)))) + self.bias

    def score(self, row: np.ndarray) -> float:
        return float(chance(np.array(self.margin(row)), self.curve))


def fold_of(doc_id: Column, parts: int, held: int) -> Column:
    """Whether a row is held out: the remainder of the crc32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == held, F.lit(False))


def labelled(labels: DataFrame, label: str, parts: int, held: int, id_col: str = "doc_id") -> DataFrame:
    """id and y of all labelled rows that aren't held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~fold_of(F.col(id_col), parts, held))
    return known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))


def sample(known: DataFrame, rows: int) -> DataFrame:
    """At most `rows` of each class, by the order of a hash of the id."""
    of = [known.filter(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    return of[0].unionByName(of[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1, rows: int = TRAIN_ROWS) -> Model:
    """The model of a bounded sample: at most 2 * rows lists of indicators reach the driver."""
    small_batches(docs.sparkSession)
    chosen = F.broadcast(sample(labelled(labels, label, parts, held), rows))
    joined = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("string").alias("txt")).join(chosen, "id").select("id", "y", "txt")

    def features(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            places = [indicators(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p.tobytes() for p in places], pa.binary())], names=["id", "y", "places"])

    schema = T.StructType([joined.schema["id"], joined.schema["y"], T.StructField("places", T.BinaryType())])
    got = sorted(((str(r[0]), r[1], bytes(r[2])) for r in joined.mapInArrow(features, schema).toLocalIterator()), key=lambda r: (zlib.crc32(r[0].encode()), r))
    return Model([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            scores = [shared.value.score(indicators(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias(text_col)).mapInArrow(batches, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", fold_of(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
