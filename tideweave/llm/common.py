"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to Python at once; texts are long, so few rows make a batch.
ARROW_ROWS = 512
#: Entries of a table that looked_up() broadcasts, at most (some MB); copies of an entry in its shuffle otherwise.
BROADCAST_ROWS, SALT = 30_000, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of texts holds in an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's; only where it names none, one in its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what stored() wrote for the frames; only for those that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_dir(spark)
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
            if root.split("://")[-1].split(":", 1)[-1].lstrip("/") in folder.toString():
                folder.getFileSystem(conf).delete(folder, True)


def looked_up(rows: DataFrame, entries: DataFrame, count: int, on: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of their entry; count is the number of entries, which are unique in `on`.

    Few entries are broadcast. More meet the rows in a shuffle in which each entry has SALT copies, so that a frequent
    key is dealt out. The rows come from files: their numbers, and with them the salts, are the same if a task runs again.
    """
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(entries), on, how)
    rows = rows.withColumn("salt", (F.monotonically_increasing_id() % SALT).cast("int"))
    entries = entries.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALT)))))
    return rows.join(entries.hint("merge"), [*on, "salt"], how).drop("salt")
