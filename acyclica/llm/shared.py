"""Helpers of the training-data operators: shared scratch tables and running sums that no single task has to hold."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_scratch: list[tuple[SparkSession, str]] = []
#: Path -> the table of the catalogue that is stored there.
_named: dict[str, str] = {}
#: Bytes of rows that go to a Python worker at a time (a longer row goes alone): Spark holds a few such batches for each task outside the heap, and the worker as many.
BATCH_BYTES = "2MB"
#: Rows that a Parquet reader decodes at a time: 4,096 long texts (Spark's default) are tens of MB in one array for each task.
READ_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset on one machine (local runs and tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else tempfile.mkdtemp(prefix="acyclica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches of this session's Python workers by bytes, and its readers' by fewer rows: by many rows only, one of long texts takes many times the memory of others."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: cuts the lineage and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_table(spark: SparkSession, path: str) -> str:
    """The name of a table to be saved at that scratch path: release() drops it from the catalogue."""
    _named[path] = path.rpartition("/")[2].replace("-", "_")
    return _named[path]


def scratch_count() -> int:
    return len(_scratch)


def release(first: int = 0, end: int | None = None) -> None:
    """Deletes scratch tables of this process, all or those numbered from first to end; their frames can't be read afterwards."""
    for i, (spark, path) in enumerate(_scratch[first:end], first):
        if not path:
            continue
        _scratch[i] = (spark, "")
        with contextlib.suppress(Exception):
            if path in _named:
                spark.sql(f"DROP TABLE IF EXISTS `{_named.pop(path)}`")
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a name inside one expression, which the optimizer can't copy into each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column | str, out: str) -> DataFrame:
    """df with ``out``: the sum of ``value`` over the rows before, in the group and order given.

    ``bucket`` is an integer column that never falls along the order. Rows are
    ordered within (group, bucket) only and the buckets' sums are added up
    before they, so a group of any size is spread over as many tasks as it has
    buckets. df is read twice: pass a stored table.
    """
    value = F.lit(1) if isinstance(value, str) and value == "1" else F.col(value) if isinstance(value, str) else value
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ahead = sums.select(*keys, F.coalesce(F.sum("_sum").over(upto.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(ahead, keys).withColumn(out, (F.col("_inside") + F.col("_ahead")).cast("long")).drop("_inside", "_ahead")


def hash_bucket(hex_digest: str | Column, buckets: int) -> Column:
    """Bucket of a hex digest by its leading 32 bits: never falls along the digests' order."""
    hex_digest = F.col(hex_digest) if isinstance(hex_digest, str) else hex_digest
    return F.floor(F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int")
