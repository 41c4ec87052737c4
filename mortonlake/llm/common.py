"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipped import ship

#: Fixed value: what separates words, as a Java/RE2 pattern. Python's bytes.split() uses the same six characters.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a local master gets a temporary folder; on a cluster that is an error, as executors do not share one."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark's own switch: what a write shuffled goes once it is written. The table cuts its lineage, so nothing reads it again.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors.

    The table belongs to the DataFrames that read it. Once the JVM holds no plan that does, a
    later table() or sweep() deletes it; release() does so at once.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    try:
        spark.conf.set(CLEAN, "true")
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    relation = out._jdf.queryExecution().analyzed().relation()  # each plan made from out holds this very object
    _made.setdefault(spark.sparkContext.applicationId, {})[path] = spark._jvm.java.lang.ref.WeakReference(relation)
    return out


#: By application, the paths that table() has written and that are still there, each with a weak reference to what reads it.
_made: dict[str, dict[str, object]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def made(spark: SparkSession) -> list[str]:
    """The paths that table() has written and that are still there."""
    return list(_made.get(spark.sparkContext.applicationId, {}))


def forget(df: DataFrame) -> None:
    """Delete what table() wrote, once its only reader has run."""
    path = getattr(df, "_stored_at", None)
    if path and _made.get(df.sparkSession.sparkContext.applicationId, {}).pop(path, None):
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession, collect: bool = False) -> None:
    """Delete the tables that no plan reads any more. collect: look for garbage first, here and in the driver's JVM."""
    left = _made.get(spark.sparkContext.applicationId, {})
    if collect:
        gc.collect()
        spark._jvm.System.gc()
    for path, reader in list(left.items()):
        if reader.refersTo(None) and left.pop(path, None):
            _delete(spark, path)


def release(df: DataFrame) -> None:
    """Delete every table that df reads, when its caller is done with it; other results that read the same tables go with it."""
    spark = df.sparkSession
    plain = lambda p: re.sub("^file:/+", "/", p)
    read = {plain(f).rpartition("/")[0] for f in df.inputFiles()}
    left = _made.get(spark.sparkContext.applicationId, {})
    for path in [p for p in left if plain(p) in read]:
        del left[path]
        _delete(spark, path)
    sweep(spark, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, buckets: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo buckets."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Before Python runs on executors: Arrow batches of a few hundred rows, as one text may have megabytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Rows of a bucket of running(), at most.
BUCKET_ROWS = 1 << 14


def running(df: DataFrame, value: str, order: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with, in column name, the sum of value over the rows before it (among those equal in keys), in the order of the unique long column `order`.

    No task sorts everything: rows are summed in buckets of BUCKET_ROWS numbers of the order, and
    shifted by the sum of the buckets before. So a key that holds most rows is spread
    over as many buckets as any other, and only the buckets' sums are ever sorted together.
    """
    bucket, at, total, shift, inside = (free_name(df, x) for x in ("__bucket", "__at", "__sum", "__shift", "__inside"))
    df = df.withColumn(bucket, F.expr(f"`{order}` div {BUCKET_ROWS}L"))
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias(total))
    before = prefix_sums(sums, total, bucket, shift, keys).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(bucket).alias(at), shift)
    here = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(inside, F.coalesce(F.sum(value).over(here), F.lit(0)))
    on = F.col(bucket) == F.col(at)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return df.join(before, on).withColumn(name, (F.col(inside) + F.col(shift)).cast("long")).drop(bucket, at, inside, shift, *[f"__{k}" for k in keys])


def prefix_sums(sums: DataFrame, value: str, order: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """sums with the sum of value over the rows before (among those equal in keys): again by blocks, so a window holds no more than a block of rows, or of blocks."""
    block, held = free_name(sums, "__block"), free_name(sums, "__held")
    sums = sums.withColumn(block, F.expr(f"`{order}` div {BUCKET_ROWS}L"))
    blocks = sums.groupBy(*keys, block).agg(F.sum(value).alias(held))
    upto = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, block, F.coalesce(F.sum(held).over(upto), F.lit(0)).alias(held))
    here = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = sums.withColumn(name, F.coalesce(F.sum(value).over(here), F.lit(0)))
    return summed.join(blocks, [*keys, block]).withColumn(name, F.col(name) + F.col(held)).drop(block, held)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have about size bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
