"""Helpers shared by the corpus operators: column picking, the shared folder, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than these (fixed value).
WORD = "[^\\x20\\x09-\\x0D]+"


#: Bytes of an Arrow batch that goes to a Python worker; whole texts are long, and a worker holds several copies.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES, unless the session has a setting of its own."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, the first of each exact name.

    Extra columns never matter, even if their names differ in case alone or
    equal one that an operator adds. Texts that go on to Python workers go in
    bounded batches.
    """
    bound_batches(df.sparkSession)
    cols = df.columns
    flat = df.toDF(*[f"__c{i}" for i in range(len(cols))])
    lower = [c.lower() for c in cols]
    at = [cols.index(n) if n in cols else lower.index(n.lower()) for n in names]
    return flat.select(*[F.col(f"__c{i}").alias(n) for i, n in zip(at, names)])


def carry(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and __row: all columns, out of the way of their names; batches are bounded as for pick."""
    bound_batches(docs.sparkSession)
    cols = docs.columns
    lower = [c.lower() for c in cols]
    at = [cols.index(n) if n in cols else lower.index(n.lower()) for n in names]
    flat = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    return flat.select(F.struct(*flat.columns).alias("__row"), *[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def unpack(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, from __row."""
    return df.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a temporary
    folder takes its place, and the session's setting from then on.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="regionspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; Hadoop deletes it when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def _collect_garbage(spark: SparkSession) -> None:
    """Collect the driver JVM's garbage once its heap has grown past a quarter of its limit.

    Many short jobs leave plans, broadcasts and shuffles behind; the heap shrinks
    again, and Spark's cleaner drops dead broadcasts and shuffle files at the
    executors only after a collection.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 4 * runtime.totalMemory() > runtime.maxMemory():
        jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts lineage: lost executors cost at most the stage that reads it.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    release_memory()
    _collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes up to which a table counts as proven small; a broadcast table takes a few times as many in memory.
MAX_BROADCAST_BYTES = 32 << 20


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes: 8 for a number, and the contents of texts, binaries, arrays and structs."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(24), lambda acc, x: acc + _width(x, kind.elementType)), F.lit(24))
        return 24 + 8 * F.coalesce(F.size(value), F.lit(0))
    return F.lit(8)


def fits(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether its rows prove to take at most `limit` bytes; not many more than that are looked at."""
    size = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8)).cast("long")
    total = df.select(size.alias("size")).limit(limit // 16 + 1).agg(F.sum("size")).first()[0]
    return (total or 0) <= limit


def bounded(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if it fits; else as it is, for a shuffle join."""
    return F.broadcast(df) if fits(df, limit) else df


def hash_sample(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most `limit` rows, those with the least hashes of their keys, so that reruns agree.

    A bound on the hash first leaves little more than `limit` rows in all
    partitions together, however many there are; only those are ordered.
    """
    n = df.count()
    u = F.xxhash64(*keys)
    if n > limit:
        share = (limit + 5 * limit**0.5 + 10) / n
        df = df.where(F.pmod(u, F.lit(1 << 40)) < int(share * (1 << 40)))
    return df.withColumn("__u", F.pmod(u, F.lit(1 << 40))).orderBy("__u", *keys).limit(limit).drop("__u")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_memory(key: str, make):
    """What a Python worker keeps from task to task, under a name: caches only, for a new worker starts without."""
    import sys
    import types

    kept = sys.modules.setdefault("_regionspark_worker_memory", types.ModuleType("_regionspark_worker_memory")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def release_memory() -> None:
    """Give back what this process's allocators keep for later."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """The function of a mapInArrow, which at its end gives back the memory that its allocators keep in a worker that lives on."""

    def whole(batches):
        yield from run(batches)
        release_memory()

    return whole


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    solid = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, "[\\x20\\x09-\\x0D]+", -1))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may learn a label from; a null doc_id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


