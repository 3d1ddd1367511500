"""Helpers shared by the operators: shared scratch tables, folds, samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the session is local (tests, notebooks) a
    temporary folder is made and set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tidelark-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage: the rows survive the loss of any executor and are not
    computed twice.
    """
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that long texts fit in a worker.

    Bounds of the session that are lower stay; they are never raised, so it
    doesn't matter in which order operators are called.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key, None) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str | Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, train: Column, columns: list[str], id_col: str = "doc_id") -> "pandas.DataFrame":  # noqa: F821
    """At most ``per_class`` labelled rows of each class, on the driver.

    The rows with the smallest ``xxhash64(id)`` are taken, so reruns agree.
    ``train`` is the condition on the id that training rows meet.  The sample
    is at most ``2 * per_class`` ids: a bound known beforehand, hence the
    broadcast.
    """
    known = labels.select(quoted(id_col).cast("long").alias("__id"), quoted(label).cast("int").alias("__y")).where(F.col("__id").isNotNull() & train)
    order = (F.xxhash64("__id"), F.col("__id"), F.col("__y"))
    picked = [known.where(F.col("__y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).dropDuplicates(["__id"])
    rows = docs.select(quoted(id_col).cast("long").alias("__id"), F.struct(*[quoted(c).alias(c) for c in columns]).alias("__row"))
    return one_by_id(rows.join(F.broadcast(ids), "__id").withColumn("__row", F.struct("__y", "__row.*")))


def one_by_id(rows: DataFrame) -> "pandas.DataFrame":  # noqa: F821
    """Columns ``__id`` and those of the struct ``__row``, on the driver: one row for each id, of several the one with the smallest hash.

    They are told apart before they are collected, in partial aggregates, so an
    id that is repeated without end costs a row.
    """
    one = rows.groupBy("__id").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return one.select("__id", "__row.*").orderBy("__id").toPandas()
