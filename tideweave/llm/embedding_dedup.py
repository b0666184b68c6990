"""Embedding near-dedup: an exact metric range join.

Vectors of one label link when their cosine is at least a threshold. On unit vectors that is a range query of the
Euclidean metric: cosine >= c means a distance of at most r = sqrt(2 - 2c).

1. Equal vectors of a label become one class with a number of copies. A label starts as one cell.
2. Every label of two vectors and more gets pivots (far points of a bounded sample, by hash, n^GROWTH of them, so more the
   larger the label): each vector has its home in the cell of its nearest pivot.
3. By the triangle inequality, a partner of a vector with home h can have its home in cell c only if
   d(v, p_c) - d(v, p_h) <= 2r, and, more sharply, if the vector is within r of the plane between the two pivots:
   d(v, p_c)^2 - d(v, p_h)^2 <= 2 r d(p_c, p_h). The vector is a guest of such cells c < h, so that each pair with a
   vector at home meets in exactly one cell, and cells join independently. Pairs of guests are passed over.
4. Cells that are too large for the memory of a task (PART) are parted again in the same way, LEVELS times at most, where
   that pays: where the smaller cells, with their guests, need at most half the comparisons.
5. What is left of such a cell (vectors that are all close to one another) is dealt out in tiles of PART vectors, and
   each pair of tiles is a task. Within a task, only vectors whose distances from one point differ by at most r are
   compared, and guests only with vectors at home. Tasks give numbers of linked vectors and a forest of the links, not the pairs.
6. Components of the forests.

Pivots stay on executors, as rows: nothing here grows with the number of labels on the driver.

Defined results: a null label, and vectors that are null, zero, or hold null or non-finite components link with nothing
and keep themselves; vectors of different lengths don't link; repeated rows of one id link like other copies; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.common import looked_up, shared_dir, stored, table
from tideweave.llm.components import components, forest

#: Pivots of a cell at most, and how their number grows with its vectors.
PIVOTS, GROWTH = 256, 0.4
#: Vectors of a cell or tile that are compared in one task, and that one task places: bounds of memory only. Rows of a block of products.
PART, PLACED, ROWS = 20_000, 8000, 500
#: How often cells are parted, at most, and the share of a cell's comparisons that a further parting may leave.
LEVELS, PAYS = 4, 0.5
#: Distances are compared with this much room, so that rounding loses no partner; the cosine itself decides.
ROOM = 1e-9


def _vector_columns(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    usable = F.col(label_col).isNotNull() & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable & F.exists(F.col(vec_col), lambda x: x != 0)
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    return df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def assign(v: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and (as a matrix of truth values) the lower cells that it is a guest of."""
    square = np.maximum(2 - 2 * v @ pivots.T, 0)
    home = square.argmin(axis=1)
    own = square[np.arange(len(v)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    guest = (np.sqrt(square) - np.sqrt(own) <= 2 * radius + 1e-6) & (square - own <= 2 * (radius + 1e-6) * apart + 1e-9)
    return home, guest & (np.arange(len(pivots)) < home[:, None])


def far_points(v: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of the unit vectors, each as far as can be from those before it."""
    chosen = [0]
    far = 2 - 2 * v @ v[0]
    while len(chosen) < most:
        k = int(far.argmax())
        if far[k] < 1e-9:
            break
        chosen.append(k)
        far = np.minimum(far, 2 - 2 * v @ v[k])
    return v[chosen]


def cell_links(v: np.ndarray, rep: np.ndarray, copies: np.ndarray, guest: np.ndarray, block: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked vectors of each one, and a forest of the links: node, root. Compared are pairs of one block, or across two blocks,
    that aren't both guests of any level (bits of guest)."""
    count, a, b = np.zeros(len(rep), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(v) < 2:
        return count, a, b
    away = np.sqrt(np.maximum(2 - 2 * v @ v[0], 0))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    by = {g: np.flatnonzero(guest == g) for g in np.unique(guest).tolist()}
    by = {g: rows[np.argsort(away[rows], kind="stable")] for g, rows in by.items()}
    for g, own in by.items():
        for h, others in by.items():
            if h < g or g & h:  # both are guests of the same parting
                continue
            theirs, their_away = v[others], away[others]
            for low in range(0, len(own), ROWS):
                rows = own[low : low + ROWS]
                start = low if g == h else int(np.searchsorted(their_away, away[rows[0]] - reach))
                end = int(np.searchsorted(their_away, away[rows[-1]] + reach, side="right"))
                hit = v[rows] @ theirs[start:end].T >= threshold
                if g == h:
                    hit &= np.arange(start, end) > np.arange(low, low + len(rows))[:, None]
                if across:
                    hit &= block[rows, None] != block[None, others[start:end]]
                i, j = np.nonzero(hit)
                i, j = rows[i], others[start + j]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                for k in range(0, len(i), 1 << 20):  # contracted by and by: never more than the nodes and one stretch of links
                    a, b = forest(np.concatenate([a, rep[i[k : k + (1 << 20)]]]), np.concatenate([b, rep[j[k : k + (1 << 20)]]]))
    return count, a, b


def _vectors(table_: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table_.column("v").to_pylist()), np.float64).reshape(table_.num_rows, -1)


CELLS = "cell string, rep long, copies long, guest int, v binary"


def _placer(radius: float, level: int):
    """Vectors of a part of a cell, cogrouped with the cell's pivots, as vectors of the smaller cells."""

    def place(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        v, pivots = _vectors(left), _vectors(right)
        home, guests = assign(v, pivots, radius)
        i, j = np.nonzero(guests)
        rows = np.concatenate([np.arange(len(v)), i])
        bit = np.concatenate([np.zeros(len(v), np.int32), np.full(len(i), 1 << level, np.int32)])
        cells = [f"{key[0].as_py()}/{c}" for c in np.concatenate([home, j]).tolist()]
        taken = left.take(pa.array(rows))
        guest = taken.column("guest").to_numpy() | bit
        return pa.table({"cell": cells, "rep": taken.column("rep"), "copies": taken.column("copies"), "guest": pa.array(guest, pa.int32()), "v": taken.column("v")})

    return place


def _pick(key: tuple, rows: pa.Table) -> pa.Table:
    """The pivots of a cell, out of its sample."""
    chosen = far_points(_vectors(rows.sort_by("v")), rows.column("most")[0].as_py())
    return pa.table({"cell": pa.array([key[0].as_py()] * len(chosen), pa.string()), "v": pa.array([x.tobytes() for x in chosen], pa.binary())})


def _units(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, rep, copies, v: v as the bytes of a vector of length one."""
    for b in source:
        vectors = [unit(np.array([v], np.float64)).tobytes() for v in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.zeros(b.num_rows, np.int32)), pa.array(vectors, pa.binary())], names=["cell", "rep", "copies", "guest", "v"])


def parted(placed: DataFrame, sizes: DataFrame, count: int, radius: float, level: int) -> DataFrame:
    """The rows of the cells in sizes (cell, n; count of them) in smaller cells."""
    rows = looked_up(placed, sizes, count, ["cell"])
    shard = F.pmod(F.xxhash64("rep"), F.lit(4 * PIVOTS))  # one of each shard: a bounded sample, without a sort of a cell's rows
    sample = rows.groupBy("cell", "n", shard.alias("shard")).agg(F.min_by("v", F.xxhash64("rep", F.lit(1))).alias("v"))
    most = F.least(F.lit(PIVOTS), F.greatest(F.lit(2), F.ceil(F.pow("n", F.lit(GROWTH))).cast("int")))
    pivots = sample.withColumn("most", most).groupBy("cell").applyInArrow(_pick, "cell string, v binary")
    parts = 1 + F.floor(F.col("n") / PLACED).cast("int")
    pivots = pivots.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("cell", "part", "v")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(2)), parts).cast("int")).select("cell", "part", "rep", "copies", "guest", "v")
    return rows.groupBy("cell", "part").cogroup(pivots.groupBy("cell", "part")).applyInArrow(_placer(radius, level), CELLS)


def cells(classes: DataFrame, radius: float) -> DataFrame:
    """cell, rep, copies, guest (bits of the partings at which the vector was copied), v (of length one, as bytes)."""
    placed, level = stored(classes.select(F.concat_ws("|", "dim", "label").alias("cell"), "rep", "copies", "v").mapInArrow(_units, CELLS), "cells"), 0
    while level < LEVELS:
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > (PART if level else 1))
        sizes = stored(sizes, "cell-sizes")
        if not (count := sizes.count()):
            break
        finer = stored(parted(placed, sizes, count, radius, level), "cells")
        # cells whose further parting doesn't pay stay as they are
        parent = F.regexp_replace("cell", "/[0-9]+$", "")
        after = finer.groupBy("cell").agg(F.count("*").cast("double").alias("m")).groupBy(parent.alias("cell")).agg(F.sum(F.col("m") * F.col("m")).alias("work"))
        kept = after.join(sizes, "cell").filter(F.lit(level == 0) | (F.col("work") <= PAYS * F.col("n") * F.col("n"))).select("cell", F.lit(True).alias("again"))
        kept = stored(kept, "cell-sizes")
        n_kept = kept.count()
        if not n_kept:
            break
        old = looked_up(placed, kept, n_kept, ["cell"], "left").filter("again IS NULL").drop("again")
        new = looked_up(finer.select(F.col("cell").alias("own"), parent.alias("cell"), "rep", "copies", "guest", "v"), kept, n_kept, ["cell"])
        placed = stored(old.unionByName(new.select(F.col("own").alias("cell"), "rep", "copies", "guest", "v")), "cells")
        level += 1
    return placed


def _joiner(threshold: float):
    """Counts and forest of one task; forest rows have -1 for the count."""

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        rep, copies, guest, block = (rows.column(c).to_numpy() for c in ("rep", "copies", "guest", "block"))
        count, a, b = cell_links(_vectors(rows), rep, copies, guest, block, key[1].as_py() != key[2].as_py(), threshold)
        linked = count > 0
        columns = np.concatenate([rep[linked], a]), np.concatenate([count[linked], np.full(len(a), -1)]), np.concatenate([rep[linked], b])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "n_links", "b"), columns)})

    return join


def near_duplicates(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept for every row; ids are integers."""
    spark = df.sparkSession
    shared_dir(spark)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = _vector_columns(df, id_col, vec_col, label_col)
    usable = rows.filter("usable AND id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "label", "v")
    # equal vectors (0.0 and -0.0 alike) are found by two hashes, which take the place of the long key
    usable = usable.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumns({"h1": F.xxhash64("v"), "h2": F.md5(F.to_json("v"))})
    classes = usable.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("dim", F.size("v")), "vectors")
    copied = classes.filter("copies > 1").select("label", "h1", "h2", F.col("rep").alias("first"), "copies")
    member = looked_up(usable.select("id", "label", "h1", "h2"), copied, copied.count(), ["label", "h1", "h2"], "left")
    member = member.select("id", F.coalesce("first", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))

    placed = cells(classes, radius)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks"))
    sizes = stored(sizes, "cell-sizes")
    dealt = looked_up(placed, sizes, sizes.count(), ["cell"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("cell", "block", other, "rep", "copies", "guest", "v").select(
        "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "guest", "v"
    )
    linked = stored(dealt.groupBy("cell", "low", "high").applyInArrow(_joiner(threshold), "a long, n_links long, b long"), "vector-links")
    counts = linked.filter("n_links >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("more"))
    group = components(linked.filter("n_links < 0").select("a", "b")).withColumnRenamed("node", "rep")
    known = member.join(counts, "rep", "left").join(group, "rep", "left")
    known = known.select("id", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = known.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    ids = rows.select("id", "usable")
    out = ids.join(known.withColumnRenamed("id", "known"), (F.col("id").cast("long") == F.col("known")) & F.col("usable"), "left")
    component = F.coalesce("component", F.col("id").cast("long"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, cosine >= 0.98 within a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE every AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: coalesce(x, 0)) AS v,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
e AS (SELECT vec_id, label, usable, CASE WHEN usable THEN v END AS v FROM every),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id AND x.usable AND y.usable
          WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = vec_id
"""
