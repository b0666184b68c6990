"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers.

Normalisation lower-cases A-Z and takes words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Each item gives its windows of
ten consecutive words (an item of fewer words is one window). The automaton scans every text once; ends of
occurrences are mapped to words, and words to byte and code point offsets of the original text. Texts are never
shuffled. The automaton is broadcast only up to a size: a larger benchmark is cut into blocks, each with an
automaton of its own, and the documents stream through one stage after another. Blocks stream through the driver one at
a time; a Python worker builds each automaton once and keeps the last ones for its next tasks.

Defined results: a null text has no words; an empty text likewise; an item without words has no windows; items
with a null id hit words, but aren't listed; an item id that repeats counts once; repeated documents each have
their own row; empty tables give an empty result, or one in which nothing is hit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.llm.common import small_batches, table

WINDOW = 10
#: Characters of windows that one broadcast automaton may hold; it takes about 60 times as many bytes.
BLOCK_CHARS = 2_000_000
#: Automata that a worker keeps.
KEPT = 2
#: Bytes that belong to words, A-Z lower-cased; all others become a space.
_MAP = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def normalised(text: str | None) -> bytes:
    """The text with a space for every byte outside words; offsets stay those of the UTF-8 text."""
    return text.encode("utf-8", "surrogatepass").translate(_MAP) if text else b""


def windows(text: str | None) -> list[str]:
    """Windows of an item, as words joined by single spaces."""
    words = normalised(text).decode("utf-8", "surrogatepass").split(" ")
    words = [w for w in words if w]
    if not words:
        return []
    return [" ".join(words[k : k + WINDOW]) for k in range(max(1, len(words) - WINDOW + 1))]


def automata(items: Iterator[tuple[object, str | None]]) -> Iterator[dict[str, tuple]]:
    """Blocks of windows, each small enough for a broadcast: window -> ids of its items."""
    block, chars = defaultdict(set), 0
    for item, text in items:
        for w in windows(text):
            chars += 0 if w in block else len(w)
            block[w].add(item)
        if chars > BLOCK_CHARS:
            yield {k: tuple(v) for k, v in block.items()}
            block, chars = defaultdict(set), 0
    if block:
        yield {k: tuple(v) for k, v in block.items()}


def build(block: dict[str, tuple]) -> ahocorasick.Automaton | None:
    """The automaton of a block, None without windows; a space on either side keeps matches on word boundaries."""
    if not block:
        return None
    machine = ahocorasick.Automaton()
    for w, ids in block.items():
        machine.add_word(f" {w} ", (w.count(" ") + 1, ids))
    machine.make_automaton()
    return machine


_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def built(name: str, block: dict[str, tuple]) -> ahocorasick.Automaton | None:
    """The automaton of a block, built once a worker."""
    if name not in _BUILT:
        while len(_BUILT) >= KEPT:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name] = build(block)
    return _BUILT[name]


def _with_last(blocks: Iterator[dict[str, tuple]]) -> Iterator[tuple[dict[str, tuple], bool]]:
    """Each block, and whether it is the last; an empty one if there is none."""
    held = next(blocks, {})
    for block in blocks:
        yield held, False
        held = block
    yield held, True


def scan(machine: ahocorasick.Automaton | None, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words; the runs of hit words as (first, last); the items with occurring windows."""
    words = [w for w in normalised(text).decode("utf-8", "surrogatepass").split(" ") if w]
    if not words or machine is None:
        return len(words), [], set()
    line = f" {' '.join(words)} "
    runs, found, starts = [], set(), None
    for end, (n, ids) in machine.iter(line):
        if starts is None:
            starts = np.cumsum([0] + [len(w) + 1 for w in words])
        last = int(np.searchsorted(starts, end)) - 1
        runs.append((last - n + 1, last))
        found.update(ids)
    return len(words), _united(runs), found


def _united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans, in the original text, of runs of words."""
    if not runs:
        return []
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(normalised(text), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(point[begin[a]]), int(point[end[b]])) for a, b in runs]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """id, text, n_words, runs (word indexes), items (ids as strings, sorted), spans (code point offsets of the runs in the original
    text) for every document; without keep_text the text is null."""
    spark = docs.sparkSession
    small_batches(spark)
    pairs = T.ArrayType(T.ArrayType(T.LongType()))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", pairs), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", pairs)]
    pairs_type, items_type = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())
    names = [id_col, text_col, *(f.name for f in fields)]
    out = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias(text_col))
    schema = T.StructType([*out.schema.fields, *fields])
    out = out.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    for block, last in _with_last(automata(items.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")).toLocalIterator())):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def batches(source: Iterator[pa.RecordBatch], shared=shared, name=name, last=last) -> Iterator[pa.RecordBatch]:
            machine = built(name, shared.value)
            for b in source:
                n_words, all_runs, all_items, spans = [], [], [], []
                for text, old_runs, old_items in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    n, runs, found = scan(machine, text)
                    n_words.append(n)
                    all_runs.append(_united([*runs, *map(tuple, old_runs or [])]))
                    all_items.append(sorted({*(x for x in found if x is not None), *(old_items or [])}))
                    spans.append(offsets(text or "", all_runs[-1]) if last else None)
                text = b.column(1) if keep_text or not last else pa.nulls(b.num_rows, b.column(1).type)
                columns = [pa.array(n_words, pa.int64()), pa.array(all_runs, pairs_type), pa.array(all_items, items_type), pa.array(spans, pairs_type)]
                yield pa.RecordBatch.from_arrays([b.column(0), text, *columns], names=names)

        out = out.mapInArrow(batches, schema)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, in which no window of an item occurs."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    small_batches(spark)
    out = docs
    for block in automata(items.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")).toLocalIterator()):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def batches(source: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            machine = built(name, shared.value)
            for b in source:
                yield b.filter(pa.array([not scan(machine, t)[1] for t in b.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(batches, docs.schema)
    return out


def digest(found: DataFrame, id_col: str = "doc_id", spans: bool = False) -> DataFrame:
    """The columns of the registered query; with spans also start:end of the hit passages in the original text, comma-joined."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0] + 1)
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        *([F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x[0].cast("string"), x[1].cast("string"))), ",").alias("spans")] if spans else []),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep_text=False))


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]]) -> list[tuple[int, int, int, str]]:
    """n_words, n_hit, n_items, items_sha256 by comparing every window with every position; for tests."""
    wins = defaultdict(set)
    for item, text in items:
        for w in windows(text):
            wins[tuple(w.split(" "))].add(item)
    out = []
    for text in texts:
        words = [w for w in normalised(text).decode("utf-8", "surrogatepass").split(" ") if w]
        hit, ids = set(), set()
        for w, owners in wins.items():
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    ids |= {str(x) for x in owners if x is not None}
        out.append((len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return out


ORACLE_SQL = r"""
WITH i AS (
  SELECT row_number() OVER () AS irow, CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS key
        FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT row, k, p.n, item FROM (SELECT row, n, k, array_to_string(w[k:k + n - 1], ' ') AS key
          FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)) p JOIN win USING (n, key)),
hits AS (SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS spot FROM occ) GROUP BY row),
its AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN its USING (row)
"""
