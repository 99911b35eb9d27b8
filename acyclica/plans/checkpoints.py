"""Round boundaries of iterative queries.

A loop writes each round's frame to the folder that the cluster shares and reads
it again: the plan stays short, and a lost executor costs a round's tasks, not
the rounds before it.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import itertools
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Session, path and place in the order of writing of each round table; and the paths of frames that read one.
_written: list[tuple[SparkSession, str, int]] = []
_path_of: dict[int, str] = {}
_order = itertools.count(1)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset on one machine, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="acyclica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str = "round") -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path, next(_order)))
    return path


def settle(df: DataFrame) -> DataFrame:
    """df's rows as a table in the shared folder."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[id(out)] = path
    weakref.finalize(out, _path_of.pop, id(out), None)
    return out


def settle_counted(df: DataFrame, only: Column | None = None) -> tuple[DataFrame, int]:
    """settle(df) and the number of its rows (those for which ``only`` holds), observed while they are written."""
    seen = Observation()
    out = settle(df.observe(seen, (F.count(F.lit(1)) if only is None else F.count_if(only)).alias("n")))
    return out, seen.get["n"]


#: Settings by which Spark broadcasts what it takes for small.
AUTO_BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@contextlib.contextmanager
def no_auto_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins without a hint are shuffled.

    Rounds join hundreds of tables that are a little under Spark's threshold at
    some size of the input; each would go through the driver.
    """
    before = {k: spark.conf.get(k, None) for k in AUTO_BROADCASTS}
    try:
        for k in AUTO_BROADCASTS:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_rounds(f: Callable) -> Callable:
    """For functions of an edge table first of all that work in rounds."""

    @functools.wraps(f)
    def run(edges: DataFrame, *args, **more):
        with no_auto_broadcasts(edges.sparkSession):
            return f(edges, *args, **more)

    return run


def discard(*frames: DataFrame) -> None:
    """Deletes the round tables of frames that nothing will read any more."""
    paths = {_path_of.get(id(f)) for f in frames}
    _delete([x for x in _written if x[1] in paths])


def mark() -> int:
    """A point in the order of writing, for discard_since()."""
    return next(_order)


def discard_since(first: int, *keep: DataFrame) -> None:
    """Deletes the round tables written since a mark, but for those of the frames to keep."""
    paths = {_path_of.get(id(f)) for f in keep}
    _delete([x for x in _written if x[2] > first and x[1] not in paths])


def _delete(tables: list[tuple[SparkSession, str, int]]) -> None:
    for x in tables:
        _written.remove(x)
        with contextlib.suppress(Exception):
            spark, at = x[0], x[0].sparkContext._jvm.org.apache.hadoop.fs.Path(x[1])
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget() -> None:
    """Deletes this process's round tables."""
    _delete(list(_written))


atexit.register(forget)
