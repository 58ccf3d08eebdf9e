"""A sink that commits a batch's writes to several tables together, or not at all.

Each batch is a generation. Its tables are written under the generation's
number first; then one small marker makes it count. Readers look at marked
generations only, so a run that dies between two tables shows nothing of its
batch. The batch comes again after a restart, under the same number: what it left is
overwritten, and if its marker is there already nothing is written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Where the markers lie, beside the tables.
_MARKERS = "committed-generations"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def commit(spark: SparkSession, root: str, generation: int, tables: dict[str, DataFrame]) -> bool:
    """Write tables as one generation of root; False if it is committed already. The marker comes last and is created atomically."""
    marker = f"{root}/{_MARKERS}/{generation:020d}"
    if _exists(spark, marker):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/generation={generation:020d}")
    # written aside and renamed: a marker is there whole or not at all
    fs, at = _file_system(spark, marker)
    aside = at.suffix(".tmp")
    out = fs.create(aside, True)
    out.write(1)
    out.close()
    if not fs.rename(aside, at):
        raise OSError(f"generation {generation} could not be marked")
    return True


def sink(stream: DataFrame, root: str, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> DataStreamWriter:
    """A writer of stream whose every batch becomes a generation: tables makes a batch's tables. Set its checkpoint and start it."""

    def batch(df: DataFrame, generation: int) -> None:
        # one read of the source for all tables
        kept = df.persist()
        try:
            commit(df.sparkSession, root, generation, tables(kept))
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(batch)


def committed(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """The rows of a table in committed generations, with `generation`; none before the first commit."""
    with_generation = spark.createDataFrame([], schema).withColumn("generation", F.lit(None).cast("string"))
    if not _exists(spark, f"{root}/{_MARKERS}") or not _exists(spark, f"{root}/{name}"):
        return with_generation
    marks = spark.read.format("binaryFile").load(f"{root}/{_MARKERS}").select(F.regexp_extract("path", "([0-9]+)$", 1).alias("generation")).where("generation <> ''")
    rows = spark.read.option("basePath", f"{root}/{name}").schema(with_generation.schema).parquet(f"{root}/{name}")
    # one short name a generation
    return rows.join(marks, "generation", "left_semi").select(*with_generation.columns)


def newest(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """The rows of the newest committed generation: the state that a client shows."""
    rows = committed(spark, root, name, schema)
    last = rows.agg(F.max("generation").alias("generation"))
    return rows.join(F.broadcast(last), "generation", "left_semi").drop("generation")
