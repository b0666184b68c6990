"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash of the key. All buckets start at depth 0; a bucket over the byte
limit, and no other, splits on its next bit, until every bucket fits.

1. Keys, sizes and hashes are written once, as narrow rows; texts are read once.
2. The directory has one entry for each occurring prefix of as many bits as the corpus needs (the logarithm of its bytes
   over the limit, and three more). Executors fill it: bytes are summed by prefix, and groups of at most 2^LEVEL_BITS
   neighbouring entries decide in one task how far their common prefix splits; with more bits there are several levels
   of groups, each handing its decisions down. The driver sees totals only.
3. Rows find their entry by prefix: a small directory is broadcast, a larger one meets the rows in a salted shuffle.
4. If prefixes are still too large, their rows, and no others, go through 2 and 3 again, with further bits.

Rows whose hashes agree in all BITS (repeated keys) can't be split by bits: a chain of overflow pages takes them, cut
where the running sum of their bytes passes the limit. Rows of one key and size are alike there: they are counted, the
chain runs over the counts, and the rows are dealt out again from them. A single row over the limit is alone on its page.

Defined results: a null key is hashed as empty text; a null text has 0 bytes; repeated rows share a bucket, and fill
overflow pages if they are too many; an empty table gives an empty result; other columns are ignored. The narrow rows
and the directory stay in the shared folder, since the lazy result reads them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideweave.llm.common import looked_up, stored, table

#: Bytes of a shard at most: the registered query's.
LIMIT = 1 << 20
#: Bits of the hash that buckets may use.
BITS = 60
#: Bits that one group of directory entries resolves.
LEVEL_BITS = 12
#: Rows of an overflow chain that are dealt out by one task.
DEALT = 10_000


def hash_bits(key: Column) -> Column:
    """60 bits of the md5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    """The leading bits of a hash."""
    return F.shiftright(h, BITS - depth)


def split(bits: np.ndarray, sizes: np.ndarray, given: np.ndarray, base: int, depth: int, limit: int) -> np.ndarray:
    """For entries of one prefix of `base` bits, the depth of each one's bucket, -1 if it is still too large.

    bits: the leading `depth` bits of each entry; given: depths that an upper level has found, else -1.
    """
    found = given.copy()
    for d in range(base, depth + 1):
        _, inverse = np.unique(bits >> (depth - d), return_inverse=True)
        fits = np.bincount(inverse, sizes)[inverse] <= limit
        found[(found < 0) & fits] = d
    return found


def _decider(base: int, depth: int, limit: int):
    """split() of one group of entries, as a function of its batches."""

    def decide(key: tuple, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(source))
        at, n, given = (got.column(c).to_numpy() for c in ("at", "n", "given"))
        depths = split(at, n, given.astype(np.int64), base, depth, limit)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(depths, pa.int32())], names=["at", "n", "depth"])

    return decide


def directory(rows: DataFrame, base: int, depth: int, limit: int, level_bits: int = LEVEL_BITS) -> DataFrame:
    """at (the leading `depth` bits), n (bytes), depth of the bucket (-1: still too large) for each occurring prefix of rows with h and n_bytes."""
    bounds = [*range(base, depth, level_bits), depth]
    level = rows.groupBy(prefix(F.col("h"), depth).alias("at")).agg(F.sum("n_bytes").alias("n"))
    levels = [level]
    for fine, coarse in zip(bounds[:0:-1], bounds[-2:0:-1]):
        level = level.groupBy(F.shiftright("at", fine - coarse).alias("at")).agg(F.sum("n").alias("n"))
        levels.append(level)
    known = None
    for low, high, sums in zip(bounds, bounds[1:], reversed(levels)):
        sums = sums.withColumn("parent", F.shiftright("at", high - low) if high > low else F.col("at"))
        if known is None:
            sums = sums.withColumn("given", F.lit(-1))
        else:
            upper = known.select(F.col("at").alias("parent"), F.col("depth").alias("given"))
            sums = sums.join(upper, "parent")

        known = sums.groupBy("parent").applyInArrow(_decider(low, high, limit), "at long, n long, depth int")
    return known


def buckets(rows: DataFrame, limit: int, bits: int = BITS, level_bits: int = LEVEL_BITS) -> tuple[DataFrame, DataFrame | None]:
    """rows has h and n_bytes, and comes back with depth and bucket; second the rows, if any, that need overflow pages."""
    out, rest, base = None, rows, 0
    most = rows.agg(F.sum("n_bytes")).first()[0] or 0
    while True:
        depth = min(bits, base + max(1, math.ceil(math.log2(max(1.0, most / limit)))) + 3)
        entries = stored(directory(rest, base, depth, limit, level_bits), "directory")
        large = F.col("depth") < 0
        count, left, most = entries.agg(F.count("*"), F.count_if(large), F.max(F.when(large, F.col("n")))).first()
        placed = looked_up(rest.withColumn("at", prefix(F.col("h"), depth)), entries.select("at", "depth"), count, ["at"]).drop("at")
        done = placed.filter("depth >= 0").withColumn("bucket", F.expr(f"shiftright(h, {BITS} - depth)"))
        out = done if out is None else out.unionByName(done)
        rest = placed.filter("depth < 0").drop("depth")
        if not left:
            return out, None
        if depth == bits:
            return out, rest.withColumns({"depth": F.lit(bits), "bucket": prefix(F.col("h"), bits)})
        base = depth


def overflow(rest: DataFrame, limit: int, id_col: str) -> DataFrame:
    """page of each row that bits can't part, dealt out of the counts of rows with one bucket, key and size."""
    alike = rest.groupBy("bucket", "depth", id_col, "n_bytes").agg(F.count("*").alias("many"))
    chain = Window.partitionBy("bucket").orderBy("n_bytes", id_col).rowsBetween(Window.unboundedPreceding, -1)
    # pages of half the limit, counted where a row begins: a page then holds at most the limit, unless one row is larger
    half = max(1, limit // 2)
    large = F.col("n_bytes") > half
    alike = alike.withColumns(
        {
            "before": F.coalesce(F.sum(F.col("many") * F.col("n_bytes")).over(chain), F.lit(0)),
            "singles": F.coalesce(F.sum(F.when(large, F.col("many")).otherwise(0)).over(chain), F.lit(0)),
        }
    )
    stretch = alike.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / DEALT).cast("long")))).repartition("bucket", id_col, "n_bytes", "stretch")
    last = F.least((F.col("stretch") + 1) * DEALT, F.col("many")) - 1
    each = stretch.withColumn("k", F.explode(F.sequence(F.col("stretch") * DEALT, last)))
    page = F.when(large, F.lit(-1) - F.col("singles") - F.col("k")).otherwise(F.floor((F.col("before") + F.col("k") * F.col("n_bytes")) / half))
    return each.select(id_col, "n_bytes", "depth", "bucket", page.cast("long").alias("page"))


def shard(
    docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, level_bits: int = LEVEL_BITS
) -> DataFrame:
    """id, n_bytes, depth, bucket (leading bits of the hash, as text), page, shard for every row."""
    id_of = docs[id_col]
    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long")
    rows = stored(docs.select(id_of.alias(id_col), size.alias("n_bytes"), hash_bits(id_of).alias("h")), "keys")
    placed, rest = buckets(rows, limit, bits, level_bits)
    out = placed.select(id_col, "n_bytes", "depth", "bucket", F.lit(0).cast("long").alias("page"))
    if rest is not None:
        out = out.unionByName(overflow(rest, limit, id_col))
    out = out.withColumn("bits", F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("bucket"), F.col("depth"), F.lit("0"))))
    return out.select(id_col, "n_bytes", "depth", F.col("bits").alias("bucket"), "page", F.concat_ws("-", "bits", F.col("page").cast("string")).alias("shard"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                  CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:{BITS // 4}] AS BIGINT) AS h FROM documents),
p AS (SELECT row, doc_id, n_bytes, depth, h >> ({BITS} - depth) AS b FROM d, (SELECT unnest(range(0, 25)) AS depth)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, b) AS total FROM p)
SELECT doc_id, n_bytes, CAST(depth AS INT) AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(b), CAST(depth AS INT), '0') END AS bucket,
       CAST(0 AS BIGINT) AS page, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(b), CAST(depth AS INT), '0') END || '-0' AS shard
FROM s WHERE total <= {LIMIT} QUALIFY row_number() OVER (PARTITION BY row ORDER BY depth) = 1
"""
