"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel compares strings by their subsequences of three letters, weighted by LAMBDA to the power of their span, so
gapped, misspelt and inflected insults stay close to one another. A text is a bag of word windows: its words (marks
taken out, look-alike digits read as letters), runs of single letters read as one word, and overlapping pieces of
very long words; letters in a row count twice at most, and near the insults a window is also read with one letter left out.

Labels belong to whole texts. Windows are suspect if a run of their letters occurs in toxic texts more often than
chance allows; near copies of a text count as one. A hinge loss on Nyström features sets the suspect windows, weighed
by how often they occur in toxic texts more than in clean ones, against those two kinds: suspects that clean texts hold
as often, and windows of all texts. Landmarks come from pivoted Cholesky over the weighed suspects, so that the most
frequent insults are always among them. A text's score is a logistic curve over how many of its windows reach which
margins, and over its length, which can only rise with each insult; it is fitted on folds that the windows' weights
haven't seen, with rows weighed to the classes' sizes among all labels.

After fitting, the landmark expansion is added up into one weight for each subsequence, which gives the same
margins without comparing every word with every landmark. Workers remember the margins of words that they have seen.
The model is fitted on a bounded sample of labelled rows (TRAIN_ROWS); every whole text is scored, in one pass,
without a shuffle. Settings were chosen by the folds of training rows only.

A text without a window that the curve counts scores at most the rate of toxic ones among such texts, whatever its length.
Margins are divided by the norm of a window only where its kernel sum is positive: elsewhere they are at most the bias, and
only that matters.

Defined results: null and empty texts have no windows and score as above; a null doc_id isn't held
out; of repeated labels of a document the highest counts, null labels don't; without labels of both classes every score is
0.5; repeated documents each have a row; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.llm.common import small_batches, table
from tideweave.llm.linear import chance, dual_coordinate_descent, monotone_logistic
from tideweave.llm.quality import fold_of, labelled, sample

#: Labelled rows of each class that the model is fitted on, at most.
TRAIN_ROWS = 1500
#: Weight of a letter's place in a subsequence's span.
LAMBDA = 0.6
#: Letters of a window; longer words give overlapping windows.
LONGEST = 16
LANDMARKS = 160
#: Lengths of the runs of letters whose rates make windows suspect, and the bits of their hashes.
RUNS, RUN_BITS = (4, 5, 6), 20
RUN_PLACES = 1 << RUN_BITS
#: Standard deviations that rates are shifted by against chance, and the log ratio from which a window is suspect.
CAUTION, SUSPECT = 2.0, 0.5
#: How many times as often as in clean texts a suspect must occur in toxic ones to be an insult.
FAVOUR = 3.0
#: Suspects and other windows that a fit reads, at most (of the sample; scoring has no such bounds), and the hinge loss's cost.
CANDIDATES, OTHERS, COST = 6000, 4000, 1.0
#: Margins at which the curve counts windows.
EDGES = np.array([-0.5, -0.2, 0.1, 0.4, 0.7, 1.0])
#: Hashes of a sketch.
SKETCH = 12
#: Margin from which (up to the highest that the curve counts) a window is also read with one letter left out, and what that costs.
NEAR, INSERTED = -0.6, 0.15
#: Words whose margins a worker remembers, and texts that it reads at once.
REMEMBERED, SLICE = 200_000, 512
#: Partitions in which the sample's bags come to the driver, one after the other: each is a job.
BAGS = 16
#: What digits and marks inside a word are read as.
LIKE = str.maketrans("013457@$", "oieastas")

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SINGLES = re.compile(r"(?<!\S)[^\W\d_](?:[^\w\n]+[^\W\d_](?![\w])){2,}")
#: Letters three or more times in a row; they are read as two.
_REPEATED = re.compile(r"(.)\1\1+")
_SIZE = 64


def window_of(word: str) -> list[str]:
    """The windows of one word, as letters."""
    if not word.isalpha():
        if any(map(str.isalpha, word)):
            word = word.strip(".,;:!?\"'()[]{}").translate(LIKE)
        word = _NOT_LETTERS.sub("", word)
    word = _REPEATED.sub(r"\1\1", word)
    if len(word) < 3:
        return []
    if len(word) <= LONGEST:
        return [word]
    return [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def singles(text: str) -> list[str]:
    """Runs of at least three single letters, as words."""
    return [w for m in _SINGLES.finditer(text) for w in window_of(_NOT_LETTERS.sub("", m[0]))]


def codes(windows: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places in the list, and the letters as numbers below 64."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(windows):
        by.setdefault(len(w), []).append(k)
    out = {}
    for n, at in by.items():
        points = np.frombuffer("".join(windows[k] for k in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
        plain = (points >= 97) & (points <= 122)
        out[n] = np.array(at), np.where(plain, points - 97, 26 + points % 37).astype(np.int32)
    return out


@lru_cache(maxsize=None)
def _triples(n: int) -> list[tuple[int, int, int]]:
    return list(combinations(range(n), 3))


def self_kernel(c: np.ndarray) -> np.ndarray:
    """The kernel of each string with itself, by the usual recursion over prefixes."""
    rows, n = c.shape
    lam = np.float32(LAMBDA)
    same = [[(c[:, i] == c[:, j]).astype(np.float32) for j in range(n)] for i in range(n)]
    before = [[np.ones(rows, np.float32)] * (n + 1) for _ in range(n + 1)]
    for _ in range(2):
        now = [[np.zeros(rows, np.float32)] * (n + 1) for _ in range(n + 1)]
        for i in range(1, n + 1):
            run = np.zeros(rows, np.float32)
            for j in range(1, n + 1):
                run = lam * run + lam * lam * same[i - 1][j - 1] * before[i - 1][j - 1]
                now[i][j] = lam * now[i - 1][j] + run
        before = now
    total = np.zeros(rows, np.float32)
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            total += lam * lam * same[i - 1][j - 1] * before[i - 1][j - 1]
    return total


@lru_cache(maxsize=12_000)
def embed(window: str) -> tuple[np.ndarray, np.ndarray]:
    """A window's normalised weights of subsequences: places and values."""
    (_, c), = codes([window]).values()
    t = np.array(_triples(len(window)))
    place = (c[0, t[:, 0]] * _SIZE + c[0, t[:, 1]]) * _SIZE + c[0, t[:, 2]]
    places, inverse = np.unique(place, return_inverse=True)
    value = np.bincount(inverse, LAMBDA ** (t[:, 2] - t[:, 0] + 1.0))
    return places, value / np.linalg.norm(value)


def margins(windows: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """weights: one for each subsequence of three letters."""
    out = np.full(len(windows), bias, np.float32)
    for n, (at, c) in codes(windows).items():
        for low in range(0, len(at), 8192):
            part = c[low : low + 8192]
            pair = {(i, j): (part[:, i] * _SIZE + part[:, j]) * _SIZE for i, j in combinations(range(n), 2)}
            total = np.zeros(len(part), np.float32)
            for i, j, k in _triples(n):
                total += np.float32(LAMBDA ** (k - i + 1)) * weights[pair[i, j] + part[:, k]]
            hot = np.flatnonzero(total > 0)  # the others' margins are at most the bias: only the sign matters
            norm = np.ones(len(part), np.float32)
            if len(hot):
                norm[hot] = np.sqrt(self_kernel(part[hot]))
            out[at[low : low + 8192]] += total / norm
    return out


class Sample:
    """Labelled texts ready for fitting: their windows, the letter runs of these, and how far each text is a copy of others.

    y has the labels, share what each row stands for among all labelled rows of its class.
    """

    def __init__(self, bags: Iterable[list[str]], lengths: np.ndarray, sketches: np.ndarray, y: np.ndarray, share: np.ndarray):
        # the bags may stream in: their words are held once
        index: dict[str, int] = {}
        held = [np.array([index.setdefault(w, len(index)) for w in b], np.int32) for b in bags]
        self._prepare(index, held, lengths, sketches, y, share)

    @classmethod
    def of_rows(cls, index: dict[str, int], held: list[np.ndarray], *rest: np.ndarray) -> Sample:
        """The same of texts whose windows are numbers already: index has the number of each window."""
        out = cls.__new__(cls)
        out._prepare(index, held, *rest)
        return out

    def _prepare(self, index, held, lengths, sketches, y, share):
        self.words = sorted(index)
        place = np.empty(len(index), np.int32)
        place[[index[w] for w in self.words]] = np.arange(len(index), dtype=np.int32)
        self.held = [np.sort(place[h]) for h in held]
        self.places, self.starts = runs_of(self.words)
        self.runs = [np.unique(np.concatenate([self.places[self.starts[k] : self.starts[k + 1]] for k in b])) if len(b) else self.places[:0] for b in self.held]
        self.lengths, self.y, self.share = lengths, y, share
        # a text weighs one through the (estimated) number of its near copies, so that a group of copies is no evidence for its words
        self.weight = np.zeros(len(y))
        for column in sketches.T:
            _, inverse, count = np.unique(column, return_inverse=True, return_counts=True)
            self.weight += 1 / count[inverse] / sketches.shape[1]

    def evidence(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window: its rates in toxic and in clean rows, and the best of its letter runs' log ratios of rates, as low as chance may have it."""
        held = [np.zeros(len(self.words)), np.zeros(len(self.words))]
        runs = [np.zeros(RUN_PLACES), np.zeros(RUN_PLACES)]
        total = [1e-9, 1e-9]
        for r in rows:
            k = int(self.y[r])
            held[k][self.held[r]] += self.weight[r]
            runs[k][self.runs[r]] += self.weight[r]
            total[k] += self.weight[r]
        low = np.maximum(runs[1] - CAUTION * np.sqrt(runs[1]), 1e-3) / total[1]
        high = (runs[0] + 1 + CAUTION * np.sqrt(runs[0] + 1)) / total[0]
        ratio = np.log(low / high)
        best = np.maximum.reduceat(ratio[self.places], self.starts[:-1]) if len(self.words) else np.zeros(0)
        return held[1] / total[1], held[0] / total[0], best


def runs_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed places of each word's runs of four to six letters (the word's start counts as one), flat, and where each word's begin."""
    sizes = np.array([sum(max(0, len(w) + 2 - n) for n in RUNS) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.zeros(starts[-1], np.int32)
    for n, (at, c) in codes(words).items():
        full = np.concatenate([np.full((len(at), 1), _SIZE - 1), c], axis=1).astype(np.uint64)
        place = 0
        for size in RUNS:
            for i in range(n + 2 - size):
                code = np.full(len(at), size, np.uint64)
                for k in range(size):
                    code = code * np.uint64(_SIZE) + full[:, i + k]
                flat[starts[at] + place] = code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - RUN_BITS)
                place += 1
    return flat, starts


def sketch(text: str | None) -> np.ndarray:
    """Smallest hashes of a text's runs of three words, under several hashes: near copies share most of them."""
    words = (text or "").lower().split()
    first = np.array([zlib.crc32(" ".join(words[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 2))], np.uint32)
    mixed = first[:, None] * (np.random.default_rng(1).integers(1, 1 << 31, SKETCH).astype(np.uint32) * np.uint32(2) + np.uint32(1))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed ^ mixed >> np.uint32(12)).min(axis=0)


def landmarks(words: list[str], weight: np.ndarray, most: int) -> list[str]:
    """Pivoted Cholesky: each landmark is the word whose weight times what the others leave unexplained of it is largest."""
    if not words:
        return []
    held, _, _ = _dense(words)
    left, factor, out = np.ones(len(words)), np.zeros((len(words), 0)), []
    for _ in range(min(most, len(words))):
        k = int(np.argmax(left * weight))
        if left[k] < 1e-3:
            break
        row = (held @ held[k] - factor @ factor[k]) / math.sqrt(left[k])
        factor = np.concatenate([factor, row[:, None]], axis=1)
        left = np.maximum(left - row * row, 0)
        left[k] = 0
        out.append(words[k])
    return out


def _dense(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings as rows over the subsequences that occur; the column of each subsequence (the last, all zero, of others); the subsequences."""
    spots = [embed(w) for w in words]
    used = np.unique(np.concatenate([at for at, _ in spots]))
    column = np.full(_SIZE**3, len(used))
    column[used] = np.arange(len(used))
    out = np.zeros((len(words), len(used) + 1), np.float32)
    for k, (places, value) in enumerate(spots):
        out[k, column[places]] = value
    return out, column, used


class Model:
    """A margin for each window, and a curve over how many windows of a text reach which margins; memory of word margins for a worker."""

    def __init__(self, sample: Sample, folds: int = 5):
        self.memory: dict[str, float] = {}
        self.weights, self.bias = np.zeros(_SIZE**3, np.float32), -1.0
        self.slopes, self.base, self.rest = np.zeros(len(EDGES) + 1), 0.0, 0.0
        self.fitted = 0 < sample.y.sum() < len(sample.y)
        if not self.fitted:
            return
        # the curve is fitted to margins of texts that the windows' weights haven't seen, read as scoring reads them
        fold, seen = np.arange(len(sample.y)) % folds, np.zeros((len(sample.y), len(EDGES) + 1))
        for k in range(folds):
            self._fit(sample, np.flatnonzero(fold != k))
            margin = self.tolerant(sample.words)
            for r in np.flatnonzero(fold == k):
                seen[r] = reached(margin[sample.held[r]], sample.lengths[r])
        self.slopes, self.base = monotone_logistic(seen, sample.y, sample.share * sample.weight, np.array([1.0] * len(EDGES) + [-1.0]))
        none, weight = ~self._near(seen), sample.share * sample.weight
        self.rest = float(weight[none] @ sample.y[none] / max(weight[none].sum(), 1e-9))
        self._fit(sample, np.arange(len(sample.y)))

    def _near(self, counts: np.ndarray) -> np.ndarray:
        """Whether a text has a window that the curve counts."""
        return (counts[:, :-1] * (self.slopes[:-1] > 0)).any(axis=1)

    def _fit(self, sample: Sample, rows: np.ndarray) -> None:
        """Weights of subsequences: windows with a run of letters that speaks for toxic texts, against the others, as often as they occur."""
        toxic, clean, best = sample.evidence(rows)
        suspect = (best > SUSPECT) & (toxic + clean > 0)
        candidates = np.flatnonzero(suspect)
        candidates = candidates[np.argsort(-best[candidates], kind="stable")][:CANDIDATES]
        others = np.random.default_rng(0).permutation(np.flatnonzero(~suspect & (toxic + clean > 0)))[:OTHERS]
        chosen = np.concatenate([candidates, others])
        gain = toxic[chosen] - FAVOUR * clean[chosen]
        positive = (gain > 0) & (np.arange(len(chosen)) < len(candidates))
        self.weights[:], self.bias = 0.0, -1.0
        if not positive.any():
            return
        cost = np.where(np.arange(len(chosen)) < len(candidates), np.abs(gain), toxic[chosen] + FAVOUR * clean[chosen])
        cost = np.minimum(cost / cost.mean(), 10.0)
        cost[positive] *= max(1.0, cost[~positive].sum() / cost[positive].sum() / 2)
        words = [sample.words[k] for k in chosen]
        first = np.flatnonzero(positive)[np.argsort(-cost[positive], kind="stable")][: 4 * LANDMARKS]
        marks = landmarks([words[k] for k in first], np.sqrt(cost[first]), LANDMARKS * 3 // 4)
        marks += [words[k] for k in np.flatnonzero(~positive)[: LANDMARKS - len(marks)]]
        held, column, used = _dense(marks)
        values, vectors = np.linalg.eigh((held @ held.T).astype(np.float64))
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        x = np.zeros((len(words), len(marks)))
        for k, w in enumerate(words):
            places, value = embed(w)
            x[k] = held[:, column[places]] @ value
        x = x @ root
        starts, index = np.arange(len(words) + 1) * x.shape[1], np.tile(np.arange(x.shape[1]), len(words))
        w = dual_coordinate_descent(starts, index, x.ravel(), np.where(positive, 1.0, -1.0), x.shape[1], COST * cost, epochs=15)
        self.weights[used], self.bias = ((root @ w[:-1]) @ held)[:-1], float(w[-1])

    def tolerant(self, windows: list[str]) -> np.ndarray:
        """Margins; a window close to the insults is also read with each one of its letters left out."""
        out = margins(windows, self.weights, self.bias)
        every = [k for k in np.flatnonzero((out > NEAR) & (out < EDGES[-1])).tolist() if len(windows[k]) > 4]
        for low in range(0, len(every), 4096):
            near = every[low : low + 4096]
            less = [windows[k][:i] + windows[k][i + 1 :] for k in near for i in range(len(windows[k]))]
            owner = np.repeat(near, [len(windows[k]) for k in near])
            np.maximum.at(out, owner, margins(less, self.weights, self.bias) - INSERTED)
        return out

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """What the curve reads of each text; a few texts at a time, so that a worker stays small."""
        parts = [self._counts(texts[k : k + SLICE]) for k in range(0, len(texts), SLICE)]
        return np.concatenate(parts) if parts else np.zeros((0, len(EDGES) + 1))

    def _counts(self, texts: list[str | None]) -> np.ndarray:
        memory, low = self.memory, EDGES[0]
        lowered = [(t or "").lower() for t in texts]
        listed = [t.split() for t in lowered]
        words = [{*ws, *singles(t)} for ws, t in zip(listed, lowered)]
        new = list({w for ws in words for w in ws if w not in memory})
        windows, owner = [], []
        for k, w in enumerate(new):
            found = window_of(w)
            windows += found
            owner += [k] * len(found)
        best = np.full(len(new), -np.inf)
        if windows:
            np.maximum.at(best, np.array(owner), self.tolerant(windows))
        memory.update(zip(new, best.tolist()))
        out = np.array([reached(np.array([m for w in ws if (m := memory[w]) >= low]), len(all_)) for ws, all_ in zip(words, listed)])
        if len(memory) > REMEMBERED:
            memory.clear()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), 0.5)
        counts = self.counts(texts)
        curve = chance(counts @ self.slopes, (1.0, self.base))
        # a text's length alone says nothing: without a counted window, a text scores at most the rate of toxic ones among such
        return np.where(self._near(counts), np.maximum(curve, self.rest), np.minimum(curve, self.rest))


def reached(margin: np.ndarray, length: int) -> np.ndarray:
    """Logarithms of how many windows reach each of EDGES, and of the number of words."""
    return np.log1p(np.append((margin[:, None] >= EDGES).sum(axis=0), length))


def bag(text: str | None) -> set[str]:
    """All windows of a text."""
    low = (text or "").lower()
    return {x for w in {*low.split()} for x in window_of(w)} | {*singles(low)}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2, rows: int = TRAIN_ROWS) -> Model:
    """The model of a bounded sample: at most 2 * rows bags of windows reach the driver; the classes' sizes are those of all labels."""
    small_batches(docs.sparkSession)
    known = labelled(labels, label, parts, held)
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    joined = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("string").alias("txt")).join(F.broadcast(sample(known, rows)), "id").select("id", "y", "txt")

    def bags(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            texts = b.column(2).to_pylist()
            lists = ["\n".join(sorted(bag(t))) for t in texts]
            sizes = [len((t or "").split()) for t in texts]
            kept = [sketch(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.string()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    extra = [T.StructField("bag", T.StringType()), T.StructField("size", T.LongType()), T.StructField("sketch", T.BinaryType())]
    schema = T.StructType([joined.schema["id"], joined.schema["y"], *extra])
    index: dict[str, int] = {}
    got = []
    # the documents are read by one job of many tasks, not by a job for each of their partitions
    for r in joined.mapInArrow(bags, schema).repartition(BAGS).toLocalIterator():
        windows = np.array([index.setdefault(w, len(index)) for w in r[2].split("\n") if w], np.int32)
        got.append((zlib.crc32(str(r[0]).encode()), str(r[0]), r[1], r[3], bytes(r[4]), windows))
    got.sort(key=lambda r: r[:5])
    y = np.array([r[2] for r in got])
    share = np.array([sizes[k] / max(1, int((y == k).sum())) for k in y])
    sketches = np.array([np.frombuffer(r[4], np.uint32) for r in got]).reshape(len(got), SKETCH)
    return Model(Sample.of_rows(index, [r[5] for r in got], np.array([r[3] for r in got]), sketches, y, share))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()), pa.float64())], names=[id_col, "score"])

    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias(text_col)).mapInArrow(batches, schema)


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose score is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            yield b.filter(pa.array(shared.value.scores(b.column(at).to_pylist()) < threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(batches, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", fold_of(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
