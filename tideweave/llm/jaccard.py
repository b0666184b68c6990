"""N-gram Jaccard join by vertical partitioning, and the groups of near copies that its links make.

A document's set is its distinct word n-grams. All n-grams have one global order, rare ones first, which is cut into
FRAGMENTS fragments; a document's set falls into one segment for each fragment. For a pair of documents the overlaps
of their segments are counted fragment by fragment and summed.

1. Counts: occurrences of n-grams are counted over all documents in COUNTERS hashed counters (an order needs no exact
   counts; any order gives the same links). Counters are ranked; the ranks, and within a counter the hashes, are the
   order. Fragments are stretches of ranks with about as many occurrences each. The table has a fixed size and is
   broadcast.
2. Heads: each document gives the size and a digest of its set, and the head of its set in the global order: two sets
   that reach the threshold share an n-gram of their heads. Equal sets are one class from here on.
3. Candidates: classes meet at the n-grams of their heads. Each class is first compared with one hub of each n-gram (the
   class with the fewest rarer n-grams), which joins groups of near copies without comparing all their pairs. Only
   n-grams at which several groups still meet give further pairs, and only pairs between different groups.
   Bounds on size and position drop pairs that can't reach the threshold. No cap on partners.
4. Partial overlaps: (document, fragment) is a key. Each candidate pair meets the two segments of one fragment at a time,
   their overlap is a row, and the rows of a pair are summed. Only documents that occur in pairs are cut into segments:
   a bitmap of a fixed size tells them (its false hits cost time, not results).
5. Components of the links.

A hub with very many members is one side of an equi-join with one row for each key, which Spark splits when skewed.
jaccard_pairs() gives all links between classes, and the members of these; jaccard_groups() leaves out pairs inside a
group that hubs have joined, since they can't change it.

Digests have 128 bits and tell sets apart with the set's size. In a segment, 48 bits of a hash stand for an n-gram: sets
of m n-grams show one too many in common with a chance of at most m * m / 2^48, which matters on the very threshold only.

Defined results: null texts and texts without words have the empty set, which links with nothing, not even another
empty set; fewer words than n are one n-gram; repeated rows link as copies do, but a row whose id repeats joins the
group of that id, and one_of_each() keeps one of them, always the same; a null id gives a row of its own group (component null); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.llm.common import dropped, looked_up, shared_dir, small_batches, stored, table
from tideweave.llm.components import components

#: Hashed counters of n-gram occurrences, and how many of them travel together.
COUNTERS, CHUNK = 1 << 20, 1 << 12
FRAGMENTS = 8
#: Bits that tell which documents occur in pairs.
BITMAP = 1 << 26
_PRIME, _MIX1, _MIX2 = np.uint64(0x100000001B3), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.cumprod(np.full(1 << 16, _PRIME, np.uint64), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams of words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.zeros(0, np.uint64)
    # a word's hash: a polynomial in the place within the word, as a difference of running sums, brought to one scale
    length = end - begin
    inside = np.flatnonzero(~space)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    term = (raw[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 0xFFFF] * (np.uint64(1) + (place >> 16).astype(np.uint64))
    words = _mixed(np.add.reduceat(term, np.cumsum(length) - length) + length.astype(np.uint64))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for j in range(k):
        out = _mixed(out * _PRIME + words[j : len(words) - k + 1 + j])
    return np.unique(out)


def _counters(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """Occurrences (at most one a document) of n-grams, by hashed counter; the driver gets COUNTERS numbers."""
    schema = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for b in source:
            found = [(ngrams(t, n) % np.uint64(COUNTERS)).astype(np.int64) for t in b.column(0).to_pylist()]
            total += np.bincount(np.concatenate(found), minlength=COUNTERS).astype(np.uint32) if found else np.uint32(0)
        rows = []
        for k in range(COUNTERS // CHUNK):
            part = total[k * CHUNK : (k + 1) * CHUNK]
            if len(at := np.flatnonzero(part)):
                rows.append((k, at.astype(np.uint16).tobytes(), part[at].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=schema.names)

    def add(key: tuple, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.uint32)
        for b in source:
            for at, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(m, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([b""], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=schema.names)

    out = np.zeros(COUNTERS, np.uint32)
    parts = docs.select(docs[text_col].cast("string").alias("txt")).mapInArrow(count, schema)
    for k, _, m in parts.groupBy("chunk").applyInArrow(add, schema).collect():  # 4 MB; an iterator would be a job for each partition
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(bytes(m), np.uint32)
    return out


def global_order(counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each counter, rare ones first, and the ranks at which fragments are cut."""
    order = np.argsort(counters, kind="stable")
    rank = np.empty(len(counters), np.uint32)
    rank[order] = np.arange(len(counters), dtype=np.uint32)
    reached = np.cumsum(counters[order], dtype=np.float64)
    return rank, np.searchsorted(reached, reached[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS).astype(np.uint32)


def _ordered(grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The global order: rare first, equals by hash."""
    return grams[np.lexsort((grams, rank[grams % np.uint64(COUNTERS)]))]


def segments_of(grams: np.ndarray, rank: np.ndarray, cuts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The fragments that a set has n-grams of, and these, sorted by hash."""
    fragment = np.searchsorted(cuts, rank[grams % np.uint64(COUNTERS)], side="right").astype(np.uint8)
    own = grams[np.argsort(fragment, kind="stable")]
    ends = np.cumsum(np.bincount(fragment, minlength=FRAGMENTS))
    return [(f, own[low:high]) for f, (low, high) in enumerate(zip([0, *ends[:-1]], ends)) if high > low]


def _heads(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, shared: Broadcast) -> DataFrame:
    """id, n (size of the set), d1 and d2 (digest), head (n-grams as long)."""
    source_df = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("txt"))
    schema = T.StructType(
        [source_df.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")), T.StructField("head", T.ArrayType(T.LongType()))]
    )

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            sizes, d1, d2, heads, starts = [], [], [], [], [0]
            for text in b.column(1).to_pylist():
                grams = ngrams(text, n)
                sizes.append(len(grams))
                d1.append(np.bitwise_xor.reduce(_mixed(grams + np.uint64(7))) if len(grams) else np.uint64(0))
                d2.append(np.add.reduce(_mixed(grams ^ _MIX1)) if len(grams) else np.uint64(0))
                head = len(grams) - -(-percent * len(grams) // 100) + 1 if len(grams) else 0
                heads.append(_ordered(grams, shared.value[0])[:head])
                starts.append(starts[-1] + head)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            head_array = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), as_long(np.concatenate(heads) if heads else []))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), as_long(d1), as_long(d2), head_array], names=schema.names)

    return source_df.mapInArrow(batches, schema)


def _possible(percent: int, a: str, b: str) -> str:
    """SQL: whether sizes and places of a shared n-gram, the first of the pair, leave room for the threshold."""
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND "
        f"(100 + {percent}) * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {percent} * ({a}.n + {b}.n)"
    )


def _bit() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(BITMAP))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bytes in which the bits of all ids are set; the driver gets BITMAP bits at most."""
    spot = _bit() + 1
    rows = ids.groupBy(F.bitmap_bucket_number(spot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    out = np.zeros((BITMAP // 32768, 4096), np.uint8)
    for k, bits in rows.collect():  # 8 MB; an iterator would be a job for each partition
        out[k - 1] = np.frombuffer(bytes(bits), np.uint8)
    return out.ravel()


def _linked(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, shared: Broadcast) -> DataFrame:
    """a, b and shared (n-grams in common) of the pairs a, b, na, nb that reach the threshold: overlaps by fragment, summed per pair."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = spark.sparkContext.broadcast(_bitmap(ids))
    source_df = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("txt"))
    source_df = source_df.withColumn("bit", _bit())
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("fragment", T.ByteType()), T.StructField("segment", T.BinaryType())])

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, cuts = shared.value
        for b in source:
            bit = b.column(2).to_numpy()
            b = b.filter(pa.array((wanted.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
            owners, fragments, parts = [], [], []
            for owner, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f, own in segments_of(ngrams(text, n), rank, cuts):
                    owners.append(owner)
                    fragments.append(f)
                    # six bytes tell the n-grams of a pair apart
                    parts.append(np.ascontiguousarray(own.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(fragments, pa.int8()), pa.array(parts, pa.binary())], names=schema.names)

    segments = source_df.mapInArrow(cut, schema)
    side = lambda c: segments.select(F.col("id").alias(c), "fragment", F.col("segment").alias(f"s{c}"))
    each = pairs.withColumn("fragment", F.explode(F.array(*(F.lit(f).cast("byte") for f in range(FRAGMENTS)))))
    # the hubs' side first: what is shuffled for the second join is spread by the other side, whose members are many
    both = each.join(side("b"), ["b", "fragment"]).join(side("a"), ["a", "fragment"]).select("a", "b", "na", "nb", "sa", "sb")

    def wide(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 6, 8), np.uint8)
        out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return out.view(">u8").ravel().astype(np.uint64)

    def overlaps(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            part = [partial_overlap(wide(x), wide(y)) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(part, pa.int64())], names=["a", "b", "na", "nb", "part"])

    counted = both.mapInArrow(overlaps, "a long, b long, na long, nb long, part long")
    total = counted.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("shared"))
    return total.filter(f"100 * shared >= {percent} * (na + nb - shared)").select("a", "b", "shared")


def partial_overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many n-grams two sorted segments share."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> tuple[Broadcast, DataFrame, DataFrame, DataFrame]:
    """The global order; heads of all rows; id and rep of the rows with a set; token, id, n, pos of the representatives' heads."""
    spark = docs.sparkSession
    small_batches(spark)
    shared_dir(spark)
    shared = spark.sparkContext.broadcast(global_order(_counters(docs, text_col, n)))
    heads = stored(_heads(docs, id_col, text_col, n, percent, shared), "heads")
    real = heads.filter("n > 0 AND id IS NOT NULL").withColumn("id", F.col("id").cast("long"))
    several = stored(real.groupBy("n", "d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k"), "copied")
    found = looked_up(real, several, several.count(), ["n", "d1", "d2"], "left")
    classes = found.select("id", F.coalesce("first", "id").alias("rep"))
    # repeated rows of a representative count once
    reps = found.filter("first IS NULL").select("id", "n", "head").unionByName(found.filter("id = first").select("id", "n", "d1", "d2", "head").dropDuplicates(["id", "n", "d1", "d2"]).drop("d1", "d2"))
    return shared, heads, classes, reps.select("id", "n", F.posexplode("head").alias("pos", "token"))


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links: id and rep of every row with a set; a < b, shared (n-grams in common) of each linked pair of representatives.

    The pairs are as many as the links between different texts: for groups of near copies, the square of their sizes.
    """
    shared, _, classes, tokens = _classes(docs, id_col, text_col, n, percent)
    tokens = stored(tokens, "tokens")
    met = tokens.alias("x").join(tokens.alias("y"), F.expr(f"x.token = y.token AND x.id <> y.id AND {_possible(percent, 'x', 'y')}"))
    met = met.filter("x.id < y.id").select(F.expr("x.id AS a"), F.expr("y.id AS b"), F.expr("x.n AS na"), F.expr("y.n AS nb")).distinct()
    pairs = stored(met, "pairs")
    return classes.withColumnRenamed("id", id_col), _linked(pairs, docs, id_col, text_col, n, percent, shared)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links reach, the id itself included) for every row.

    Two rows link if 100 * shared >= percent * joint n-grams. The ids are integers.
    """
    spark = docs.sparkSession
    shared, heads, classes, tokens = _classes(docs, id_col, text_col, n, percent)
    hubs = tokens.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("hub"), F.count("*").alias("k")).filter("k > 1")
    met = stored(tokens.join(hubs, "token").select("token", "id", "n", "pos", "hub"), "met")

    near = met.alias("x").filter(f"x.id <> x.hub.id AND {_possible(percent, 'x', 'x.hub')}")
    pairs = stored(near.select(F.col("x.id").alias("a"), F.col("x.hub.id").alias("b"), F.col("x.n").alias("na"), F.col("x.hub.n").alias("nb")).distinct(), "pairs")
    links = stored(_linked(pairs, docs, id_col, text_col, n, percent, shared).drop("shared"), "links1")
    group = components(links)

    # n-grams at which several groups still meet: rows outside the n-gram's largest group against all of its rows
    labelled = met.select("token", "id", "n", "pos").join(group.withColumnRenamed("node", "id"), "id", "left")
    labelled = stored(labelled.select("token", "id", "n", "pos", F.coalesce("component", "id").alias("c")), "labelled")
    sizes = labelled.groupBy("token", "c").agg(F.count("*").alias("k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "c")).alias("most"), F.count("*").alias("groups")).filter("groups > 1")
    open_ = labelled.join(main.select("token", F.col("most.c").alias("main")), "token")
    x, y = open_.filter("c <> main").alias("x"), open_.alias("y")
    apart = "x.c <> y.c AND (y.c = y.main OR x.id < y.id) AND " + _possible(percent, "x", "y")
    more = x.join(y, F.expr(f"x.token = y.token AND {apart}")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    more = stored(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    dropped(spark, met, labelled)
    all_links = links.unionByName(_linked(more, docs, id_col, text_col, n, percent, shared).drop("shared"))

    # copies, and rows whose id repeats, hang on their class
    same = classes.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(all_links.unionByName(same))
    ids = heads.select("id", "n")
    out = ids.join(found, ids["id"].cast("long") == found["node"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", F.col("id").cast("long")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row, with all its columns, of each group: that with the smallest id; rows without an id stay."""
    groups = jaccard_groups(docs, id_col, text_col, n, percent)
    chosen = groups.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("id")).distinct()
    # which row of an id stays is settled on hashes of the rows; texts are shuffled once, and needn't be sorted. The rows are
    # held as a whole, so that no column of theirs meets one of these
    hashed = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("h1"), F.xxhash64(F.lit(1), *docs.columns).alias("h2"), F.struct(*docs.columns).alias("row")
    )
    alike = hashed.groupBy("id", "h1", "h2").agg(F.count("*").alias("many"))
    first = alike.groupBy("id").agg(F.min(F.struct("h1", "h2", "many")).alias("f"))
    keys, on = stored(first.join(chosen, "id", "left_semi").select("id", "f.*"), "kept"), ["id", "h1", "h2"]
    kept = hashed.join(keys.filter("many = 1").hint("shuffle_hash"), on, "left_semi").select("row.*")
    repeated = keys.filter("many > 1").drop("many")
    if n_repeated := repeated.count():
        one = looked_up(hashed, repeated, n_repeated, on).dropDuplicates(on)
        kept = kept.unionByName(one.select("row.*"))
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents: four words, a similarity of 0.85."""
    return jaccard_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
