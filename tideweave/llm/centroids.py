"""Centroid clustering of integer vectors by Elkan's bounds.

Each vector carries an upper bound of its distance to its own centroid, and a lower bound of its distance to each one. When
centroids move, the bounds give way by as much. A centroid isn't looked at for a vector if the upper bound is less than
the lower bound for that centroid, or than half the distance between the two centroids: then it is farther than the own
one. Bounds are doubles, rounded outwards, and pruning is strict, so that a centroid at the same distance is always
looked at; distances that are looked at, and the final ones, are exact integers. Results are those of comparing everything.

A round is one pass over the vectors with the centroids (k * dims numbers, a fixed size) sent along. It is written to the
shared folder, which cuts the lineage, and only vectors that have changed their cluster are then added to and taken
from the sums: exact integers, summed in each partition, then by cluster and component. No vector is shuffled.

Defined results: vectors that are null, have another number of components, or a null or non-finite one are left out;
repeated rows each count and each have a row; null ids are kept, and become first centroids only if others run out; fewer
vectors than k give fewer clusters; an empty table gives an empty result; other columns are ignored. Components of
2 ** 27 and more after scaling raise an error: squared distances would not fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.llm.common import dropped, small_batches, stored, table

#: Integers at and beyond this aren't taken.
LARGEST = 1 << 27


def integers(vec: Column, dims: int, scale: float) -> Column:
    """floor(scale * x) of each component; null for vectors that are left out."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(vec, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(vec, lambda x: F.abs(x.cast("double") * scale) < LARGEST - 1)
    return F.when((F.size(vec) == dims) & finite, F.when(fits, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large"))))


def kept(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """id and integers of the vectors that take part."""
    return vectors.select(vectors[id_col].alias(id_col), integers(vectors[vec_col], dims, scale).alias("v")).filter("v IS NOT NULL")


def above(square: np.ndarray) -> np.ndarray:
    """A double that isn't under the root of an integer."""
    return np.nextafter(np.nextafter(np.sqrt(square.astype(np.float64)), np.inf), np.inf)


def below(square: np.ndarray) -> np.ndarray:
    """A double that isn't over the root of an integer."""
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(square.astype(np.float64)), -np.inf), -np.inf), 0.0)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, or to one row."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Step:
    """One round's centroids: how far they have moved, and how far they are from one another."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids, self.first = centroids, before is None
        self.moved = above(squares(centroids, before)) if before is not None else np.zeros(len(centroids))
        self.half = np.stack([below(squares(centroids, c)) for c in centroids]) / 2  # halving is exact

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (ties: the smaller number), its bounds, and how many distances it took."""
        rows, k = np.arange(len(v)), len(self.centroids)
        looked = np.zeros(len(v), np.int32)
        if self.first:
            exact = np.stack([squares(v, c) for c in self.centroids], axis=1)
            own = exact.argmin(axis=1).astype(np.int32)
            return own, above(exact[rows, own]), below(exact), looked + k
        own, lower = own.copy(), np.maximum(np.nextafter(lower - self.moved, -np.inf), 0.0)
        upper = np.nextafter(upper + self.moved[own], np.inf)
        other = np.arange(k) != own[:, None]
        open_ = np.flatnonzero((other & (upper[:, None] >= lower) & (upper[:, None] >= self.half[own])).any(axis=1))
        near = squares(v[open_], self.centroids[own[open_]])
        upper[open_], lower[open_, own[open_]] = above(near), below(near)
        looked[open_] += 1
        for j in range(k):
            a = own[open_]
            ask = np.flatnonzero((a != j) & (upper[open_] >= lower[open_, j]) & (upper[open_] >= self.half[a, j]))
            at = open_[ask]
            if not len(at):
                continue
            exact = squares(v[at], self.centroids[j])
            lower[at, j] = below(exact)
            looked[at] += 1
            won = (exact < near[ask]) | ((exact == near[ask]) & (j < own[at]))
            near[ask[won]] = exact[won]
            own[at[won]], upper[at[won]] = j, above(exact[won])
        return own, upper, lower, looked


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """A column of equally long arrays as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _assigned(rows: DataFrame, step: Step, id_col: str) -> DataFrame:
    """rows (id, v and, but for the first round, cluster, upper, lower) after one round."""
    k = len(step.centroids)
    schema = T.StructType([rows.schema[id_col], *(T.StructField(n, t) for n, t in _STATE)])
    shared = rows.sparkSession.sparkContext.broadcast(step)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        for b in source:
            v = _matrix(b.column(1), np.int64)
            was = np.full(len(v), -1, np.int32) if step.first else b.column(2).to_numpy()
            upper = np.zeros(len(v)) if step.first else b.column(3).to_numpy()
            lower = np.zeros((len(v), k)) if step.first else _matrix(b.column(4), np.float64)
            own, upper, lower, looked = step.assign(v, was, upper, lower)
            bounds = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * k, lower.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), bounds, pa.array(looked, pa.int32())], names=schema.names)

    read = [id_col, "v"] if step.first else [id_col, "v", "cluster", "upper", "lower"]
    return rows.select(*read).mapInArrow(batches, schema)


_STATE = (
    ("v", T.ArrayType(T.IntegerType())), ("cluster", T.IntegerType()), ("was", T.IntegerType()), ("upper", T.DoubleType()),
    ("lower", T.ArrayType(T.DoubleType())), ("looked", T.IntegerType()),
)


def _changes(state: DataFrame, k: int) -> dict[int, tuple[int, list[int]]]:
    """For each cluster by how much its number of vectors and their sums change: at most k * dims rows reach the driver."""

    def partial(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = None, np.zeros(k, np.int64)
        for b in source:
            v, own, was = _matrix(b.column(0), np.int64), b.column(1).to_numpy(), b.column(2).to_numpy()
            sums = np.zeros((k, v.shape[1]), np.int64) if sums is None else sums
            for j in range(k):
                sums[j] += v[own == j].sum(axis=0) - v[was == j].sum(axis=0)
                counts[j] += (own == j).sum() - (was == j).sum()
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k), pa.int32()), pa.array(np.column_stack([counts, sums]).tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"]
            )

    parts = state.filter("NOT cluster <=> was").select("v", "cluster", "was").mapInArrow(partial, "cluster int, sums array<long>")
    each = parts.select("cluster", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, dict[int, int]] = {}
    for r in each.collect():
        out.setdefault(r["cluster"], {})[r["place"]] = int(r["s"])
    return {j: (s[0], [s[p] for p in range(1, len(s))]) for j, s in out.items()}


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: float = 1024, seed: str = "3"
) -> tuple[DataFrame, list[list[int]]]:
    """id, cluster, distance (squared) and looked (distances that the last round took) of every vector, and the final centroids.

    Centroids start as the k vectors whose ids have the smallest sha256 of `seed:id`, in that order; each round assigns all
    vectors and replaces the centroids of clusters that aren't empty by floor(sum / count); then all are assigned once more.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = kept(vectors, id_col, vec_col, dims, scale)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    first = [r["v"] for r in rows.orderBy(rank.asc_nulls_last(), "v").limit(k).collect()]
    if not first:
        empty = rows.select(id_col, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("looked")).limit(0)
        return empty, []
    centroids, before, state = np.array(first, np.int64), None, rows
    counts, sums = [0] * len(first), [[0] * dims for _ in first]
    for _ in range(rounds):
        older, state = state, stored(_assigned(state, Step(centroids, before), id_col), "centroids")
        for j, (n, s) in _changes(state, len(first)).items():
            counts[j] += n
            sums[j] = [a + b for a, b in zip(sums[j], s)]
        if before is not None:
            dropped(spark, older)
        means = [[s // n for s in row] if n else c.tolist() for row, n, c in zip(sums, counts, centroids)]
        before, centroids = centroids, np.array(means, np.int64)
    last = _assigned(state, Step(centroids, before), id_col)
    centre = F.get(F.array(*(F.array(*map(F.lit, c.tolist())) for c in centroids)), F.col("cluster"))
    gap = F.zip_with("v", centre, lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    distance = F.aggregate(gap, F.lit(0).cast("long"), lambda s, x: s + x)
    return last.select(id_col, "cluster", distance.alias("distance"), "looked"), centroids.tolist()


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters after ten rounds."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    found = stored(found.drop("looked"), "clusters")
    by = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # at most eight rows
    every = by.agg(F.sum("cluster_inertia").alias("inertia"))
    named = spark.createDataFrame([(j, ",".join(map(str, c))) for j, c in enumerate(centroids)], "cluster int, centroid string")
    named = named.select("cluster", F.sha2("centroid", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(by.join(named, "cluster").crossJoin(every)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Every distance of every round, in plain SQL."""
    near = lambda c: (
        f"SELECT row, v, arg_min(c, (CAST(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), c)) AS c,"
        f" min(CAST(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)) AS d FROM kept, {c} GROUP BY row, v"
    )
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v AS w FROM (SELECT v, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM kept)
  ORDER BY c LIMIT {k})""",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near(f'c{r}')})")
        parts.append(
            f"s{r} AS MATERIALIZED (SELECT c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {dims + 1})) AS j) GROUP BY c, j),\n"
            f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.w, o.w) AS w FROM c{r} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS w FROM s{r} GROUP BY c) m ON m.c = o.c)"
        )
    parts.append(f"last AS MATERIALIZED ({near(f'c{rounds}')})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(last.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY last.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256
FROM last JOIN kept USING (row) JOIN c{rounds} ON c{rounds}.c = last.c"""


ORACLE_SQL = _sql()
