"""Mixing sources to target weights by blocks of tokens.

Tokens (words between white space) of a source are packed into blocks of a fixed length. A source takes a whole number
of block slots that meets its target; each output shard draws how many of its slots come from which source, by
multinomial draws conditioned on those totals. A source's k-th slot maps to a block by a pseudorandom permutation of its
block indexes (a Feistel network with cycle walking, another for each pass), so no block is taken a second time before
all have been taken once. Slots and documents' blocks are joined by index.

1. Keys, sources, sizes and hashes are written once, as narrow rows; texts are read once here. Equal rows are counted.
2. To lay a source's documents end to end, they are dealt to streams of about STREAM_ROWS rows by a hash, and the streams
   follow one another: running sums within streams, and over the streams' totals.
3. Draws: the range of output shards is halved again and again, and each half draws its share of every source's slots
   from what the whole has. A task follows the halves down to its own shards only, so draws need no table.
4. Texts, for the mixed documents, meet the taken words at the end: the only time that they are shuffled.

Targets: sources in order of code points, null last, weigh 1, 2, 3, repeating, sources without any word too; they share
the size of the corpus; a target stops at three times its source's size, and the excess is shared anew by weight. The
table of sources (one row each) is on the driver. Everything depends on the rows and the seed only, so reruns agree.

Defined results: null texts and texts without words have size 0 and are taken 0 times; repeated rows are documents of
their own; a null id is dealt like any other; an empty table gives an empty result; other columns are ignored. Narrow
rows stay in the shared folder, since the lazy result reads them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.llm.common import looked_up, small_batches, stored, table

#: Words of a block.
BLOCK = 64
#: A target is at most this many times its source's size.
PASSES = 3
#: Rows of a stream, about.
STREAM_ROWS = 2_000
#: Rows of a table that is broadcast, at most; copies of a row that are dealt out by one task.
PART, DEALT = 100_000, 10_000
#: Block slots of an output shard.
SHARD_SLOTS = 1 << 16
SEED = 20260101
WORDS = r"[^\x20\x09-\x0D]+"
_GAPS = r"[\x20\x09-\x0D]+"
_WORD = re.compile(WORDS)


def n_words(text: Column) -> Column:
    """Number of words: what a split at white space leaves, less the empty ends."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    pieces = F.split(t, _GAPS, -1)
    empty = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return (F.size(pieces) - empty).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), cap: int = PASSES) -> dict[str | None, float]:
    """The target of each source; caps are met by raising the level at which weights are served."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    most = {s: float(cap * n) for s, n in order}
    out, left, open_ = {}, float(sum(n for _, n in order)), sorted(most, key=lambda s: most[s] / weight[s])
    total = float(sum(weight.values()))
    for s in open_:
        out[s] = min(most[s], left * weight[s] / total)
        left, total = left - out[s], total - weight[s]
    return out


def _share(random: np.random.Generator, have: int, others: int, n: int) -> int:
    """How many of n slots, drawn from have + others ones, are of the first kind; by the normal law where numbers are very large."""
    if have + others < 500_000_000:
        return int(random.hypergeometric(have, others, n)) if have and n else 0
    all_ = have + others
    mean, spread = n * have / all_, (n * (have / all_) * (others / all_) * ((all_ - n) / (all_ - 1))) ** 0.5
    return min(max(round(random.normal(mean, spread)), n - others, 0), have, n)


def shard_draws(slots: np.ndarray, shards: list[int], shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the wanted shards (in order): its number, how many slots each source fills, and how many it has filled before."""
    slots = np.asarray(slots, np.int64)
    todo = [(0, -(-int(slots.sum()) // shard_slots), slots, np.zeros_like(slots), list(shards))]
    while todo:
        low, high, have, before, wanted = todo.pop()
        if not wanted:
            continue
        if high - low == 1:
            yield low, have, before
            continue
        middle = (low + high) // 2
        random = np.random.default_rng((seed, low, high))
        left, n, pool = np.zeros_like(have), (middle - low) * shard_slots, int(have.sum())
        for k, own in enumerate(have.tolist()):
            pool -= own
            left[k] = _share(random, own, pool, n)
            n -= int(left[k])
        todo.append((middle, high, have - left, before + left, [s for s in wanted if s >= middle]))
        todo.append((low, middle, left, before, [s for s in wanted if s < middle]))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1, applied to indexes."""
    half = max(1, (max(1, int(size - 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 63, 4).astype(np.uint64)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def keys(docs: DataFrame, columns: list[str]) -> list[Column]:
    """Two hashes of the columns of a row."""
    return [F.xxhash64(F.lit(k), *(docs[c] for c in columns)).alias(f"key{k}") for k in (1, 2)]


class Plan:
    """What the mix takes: sources with their sizes, targets and slots; draws come by shard."""

    def __init__(self, sources: list[tuple[str | None, int, int]], block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        """sources: name, words, rows."""
        held = sorted(sources, key=lambda r: (r[0] is None, r[0] or ""))
        self.names, self.sizes = [r[0] for r in held], [int(r[1]) for r in held]
        self.streams = [1 + int(r[2]) // STREAM_ROWS for r in held]
        self.blocks = [-(-n // block) for n in self.sizes]
        self.block, self.seed, self.shard_slots = block, seed, shard_slots
        aim = targets(list(zip(self.names, self.sizes)))
        self.targets = [aim[s] for s in self.names]
        self.slots = np.array([min(PASSES * b, round(t * b / n)) if n else 0 for t, b, n in zip(self.targets, self.blocks, self.sizes)], np.int64)
        self.shards = -(-int(self.slots.sum()) // shard_slots)

    @property
    def draws(self) -> np.ndarray:
        """Sources' slots of every shard, for looking at; one row each."""
        rows = [draw for _, draw, _ in shard_draws(self.slots, list(range(self.shards)), self.shard_slots, self.seed)]
        return np.array(rows, np.int64).reshape(len(rows), len(self.slots))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(len(self.names)), self.names, self.streams, self.sizes, map(float, self.targets)))
        return spark.createDataFrame(rows, "source_no int, s string, streams long, source_size long, target double")


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """shard, slot, source_no, pass_no, block: one row for each block slot of the output."""
    blocks, seed, shard_slots, totals = plan.blocks, plan.seed, plan.shard_slots, plan.slots
    schema = T.StructType([T.StructField(n, t) for n, t in (("shard", T.LongType()), ("source_no", T.IntegerType()), ("pass_no", T.IntegerType()), ("block", T.LongType()))])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for shard, draw, before in shard_draws(totals, sorted(b.column(0).to_pylist()), shard_slots, seed):
                for k in np.flatnonzero(draw).tolist():
                    for low in range(0, int(draw[k]), 1 << 16):
                        at = before[k] + np.arange(low, min(int(draw[k]), low + (1 << 16)))
                        passes, index = at // blocks[k], at % blocks[k]
                        for p in np.unique(passes).tolist():
                            own = permuted(index[passes == p], blocks[k], seed + 1000003 * k + p)
                            ints = [pa.array(np.full(len(own), v, t)) for v, t in ((shard, np.int64), (k, np.int32), (p, np.int32))]
                            yield pa.RecordBatch.from_arrays([*ints, pa.array(own)], names=schema.names)

    parts = max(1, min(plan.shards, int(plan.slots.sum()) // 50_000 + 1))
    return spark.range(0, plan.shards, 1, parts).mapInArrow(batches, schema)


def lay_out(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, whole: bool = False, shard_slots: int = SHARD_SLOTS
) -> tuple[DataFrame, Plan]:
    """id, source, source_no, size, begin (where the document's words lie in its source), key1, key2, many (rows that equal it,
    itself included) of every row; and the plan of the mix. The keys are hashes of the text, with whole of the whole row."""
    spark = docs.sparkSession
    narrow = docs.select(docs[id_col].alias(id_col), docs[source_col].cast("string").alias("source"), n_words(docs[text_col]).alias("size"), *keys(docs, docs.columns if whole else [text_col]))
    narrow = stored(narrow, "mix-rows")
    plan = Plan([tuple(r) for r in narrow.groupBy("source").agg(F.sum("size"), F.count("*")).collect()], block, shard_slots)
    known = plan.frame(spark).select("source_no", "s", "streams")
    alike = narrow.groupBy(id_col, "source", "size", "key1", "key2").agg(F.count("*").alias("many"))
    alike = alike.join(known, alike["source"].eqNullSafe(known["s"]))
    alike = alike.withColumn("stream", F.pmod(F.xxhash64(F.col(id_col).cast("string"), "key1", F.lit(SEED)), F.col("streams"))).drop("s", "streams")
    words = F.col("many") * F.col("size")
    order = Window.partitionBy("source_no", "stream").orderBy("key1", "key2", F.xxhash64(id_col), id_col, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = alike.withColumn("begin", F.sum(words).over(order) - words)
    total = alike.groupBy("source_no", "stream").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select("source_no", "stream", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    laid = laid.join(F.broadcast(offset) if sum(plan.streams) <= PART else offset.hint("merge"), ["source_no", "stream"])
    laid = laid.select(id_col, "source", "source_no", "size", (F.col("begin") + F.col("offset")).alias("begin"), "key1", "key2", "many")
    # equal rows: each copy has its own words, one after the other
    copies = laid.filter("many > 1").withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / DEALT).cast("long"))))
    copies = copies.repartition("source_no", "begin", "stretch")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("stretch") * DEALT, F.least((F.col("stretch") + 1) * DEALT, F.col("many")) - 1)))
    copies = copies.withColumn("begin", F.col("begin") + F.col("copy") * F.col("size")).drop("copy", "stretch")
    return stored(laid.filter("many = 1").unionByName(copies), "mix"), plan


def mix(placed: DataFrame, plan: Plan) -> DataFrame:
    """The taken blocks of the laid out documents: source_no, begin (of the document), block, low and high (the words of
    the document that lie in the block), passes (the numbers of the passes that take it)."""
    block = plan.block
    last = F.floor((F.col("begin") + F.col("size") - 1) / block).cast("long")
    own = placed.filter("size > 0").select("source_no", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block).cast("long"), last)).alias("block"))
    low = F.greatest(F.col("block") * block - F.col("begin"), F.lit(0))
    high = F.least((F.col("block") + 1) * block - F.col("begin"), F.col("size"))
    own = own.select("source_no", "begin", "block", low.alias("low"), high.alias("high"))
    taken = slots(placed.sparkSession, plan).groupBy("source_no", "block").agg(F.sort_array(F.collect_list("pass_no")).alias("passes"))
    # the slots come from a short list of ranges, which hides their number from the planner: it must not broadcast them
    return own.join(taken.hint("merge"), ["source_no", "block"])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix as documents: for each pass in which words of a document are taken a row with its columns, the text cut to
    those words, and the number of characters with it."""
    placed, plan = lay_out(docs, id_col, text_col, source_col, whole=True)
    taken = mix(placed, plan).select("source_no", "begin", F.explode("passes").alias("pass_no"), "low", "high")
    taken = taken.groupBy("source_no", "begin", "pass_no").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs"))
    own = placed.filter("size > 0").select("source_no", "begin", "key1", "key2", "many")
    runs = stored(own.join(taken.hint("merge"), ["source_no", "begin"]).select("key1", "key2", "many", "runs"), "mix-runs")
    keyed = docs.select(*keys(docs, docs.columns), F.struct(*docs.columns).alias("row"))
    # a row of its own has a run for each pass at most: the runs are the hashed side, and texts needn't be sorted
    met = keyed.join(runs.filter("many = 1").hint("shuffle_hash"), ["key1", "key2"]).select("row", "runs")
    copied = runs.filter("many > 1").select("key1", "key2").distinct()
    if n_copied := copied.count():  # equal rows hold the same text: one of them meets the runs of all
        one = looked_up(keyed, copied, n_copied, ["key1", "key2"]).dropDuplicates(["key1", "key2"])
        met = met.unionByName(one.join(runs.filter("many > 1").hint("merge"), ["key1", "key2"]).select("row", "runs"))
    last = "_runs"
    while last in docs.columns:
        last += "_"
    met = met.select("row.*", F.col("runs").alias(last))
    names, at, chars = docs.columns, docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            texts = [words_between(t, [(r["low"], r["high"]) for r in runs]) for t, runs in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([len(t) for t in texts]).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    return met.mapInArrow(cut, docs.schema)


def words_between(text: str, runs: list[tuple[int, int]]) -> str:
    """The words low .. high - 1 of a text for each run, as they stand; runs that touch are one piece."""
    spans = [m.span() for m in _WORD.finditer(text)]
    pieces: list[list[int]] = []
    for low, high in runs:
        if pieces and pieces[-1][1] == low:
            pieces[-1][1] = high
        else:
            pieces.append([low, high])
    if pieces == [[0, len(spans)]]:
        return text
    return " ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in pieces)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    placed, plan = lay_out(table(spark, sf_dir, "documents"))
    per_doc = mix(placed, plan).groupBy("source_no", "begin").agg(F.sum((F.col("high") - F.col("low")) * F.size("passes")).alias("taken"))
    known = plan.frame(spark).select("source_no", "source_size", "target")
    out = placed.join(per_doc.hint("merge"), ["source_no", "begin"], "left").join(known, "source_no", "left")
    return out.select(
        "doc_id", "size", F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"),
    )


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the mix: every document's size, and its source's size and target."""
    placed, plan = lay_out(table(spark, sf_dir, "documents"))
    known = plan.frame(spark).select("source_no", "source_size", F.round("target", 6).alias("target"))
    return placed.join(known, "source_no").select("doc_id", "size", "source_size", "target")


#: Sources in the order in which they reach their caps: each takes its share of what is left, or its cap.
TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source IS NULL, source) AS k, sum(weight) OVER () AS w, sum(source_size) OVER () AS n FROM s),
t AS (SELECT 0::BIGINT AS k, max(n)::DOUBLE AS left_, max(w)::DOUBLE AS weights, NULL::VARCHAR AS source, 0::BIGINT AS source_size, 0::DOUBLE AS target FROM o
  UNION ALL SELECT o.k, t.left_ - least(3.0 * o.source_size, t.left_ * o.weight / t.weights), t.weights - o.weight, o.source, o.source_size, least(3.0 * o.source_size, t.left_ * o.weight / t.weights)
  FROM t JOIN o ON o.k = t.k + 1)
SELECT doc_id, size, source_size, round(target, 6) AS target FROM d JOIN t ON t.k > 0 AND t.source IS NOT DISTINCT FROM d.source
"""
