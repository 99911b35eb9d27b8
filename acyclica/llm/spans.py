"""Rows numbered for the length of a job, and byte spans cut out of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.llm.shared import scratch_path, scratch_table, stored
from acyclica.llm.workers import lean

SPANS = "array<struct<s:int,e:int>>"


def numbered(docs: DataFrame, name: str, text_col: str = "text", bucketed: bool = False) -> DataFrame:
    """Stored rows: _rid (ascending in the order of the table, unique), _row (the columns) and _text (null: empty), which is read from _row.

    bucketed: dealt by _rid once, as a bucketed table in the shared folder, so
    that joins on _rid don't shuffle the texts again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    if bucketed:
        spark = docs.sparkSession
        n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, name)
        called = scratch_table(spark, path)
        rows.repartition(n, "_rid").write.bucketBy(n, "_rid").format("parquet").option("path", path).saveAsTable(called)
        rows = spark.table(called)
    else:
        rows = stored(rows, name)
    return rows.withColumn("_text", F.coalesce(F.col("_row")[text_col], F.lit("")))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([np.nonzero(new)[0][1:] - 1, [len(s) - 1]])
    return s[new], e[last]


def without(data: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    """The bytes outside maximal runs."""
    edges = [0, *[x for pair in zip(s.tolist(), e.tolist(), strict=True) for x in pair], len(data)]
    return b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _cut(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            text, spans = b.column(names.index("_text")), b.column(names.index("_spans"))
            out = {k: [] for k in ("_bytes", "_removed", "_runs", "_kept")}
            where = []
            flat, offsets = spans.flatten(), spans.offsets.to_numpy()
            starts, ends = flat.field("s").to_numpy(zero_copy_only=False), flat.field("e").to_numpy(zero_copy_only=False)
            valid = spans.is_valid().to_numpy(zero_copy_only=False)
            base = offsets[0] if len(offsets) else 0
            for i in range(len(b)):
                data = text[i].as_py().encode()
                out["_bytes"].append(len(data))
                lo, hi = offsets[i] - base, offsets[i + 1] - base
                if not valid[i] or lo == hi:
                    s = e = np.zeros(0, np.int64)
                else:
                    s, e = merged(starts[lo:hi].astype(np.int64), ends[lo:hi].astype(np.int64))
                    long = e - s >= min_run
                    s, e = s[long], e[long]
                out["_removed"].append(int((e - s).sum()))
                out["_runs"].append(len(s))
                out["_kept"].append(without(data, s, e) if len(s) else data)
                where.append([{"s": int(x), "e": int(y)} for x, y in zip(s, e, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [b.column(names.index("_row")), *[pa.array(out[k], pa.int64()) for k in ("_bytes", "_removed", "_runs")], pa.array(out["_kept"], pa.binary()), pa.array(where, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))],
                names=["_row", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    return run


def cut(rows: DataFrame, spans: DataFrame, min_run: int = 1, text_col: str = "text") -> DataFrame:
    """_row, n_bytes, n_removed, n_spans, kept (binary), spans: rows of numbered() without the union of their spans (_rid, s, e), as far as its runs have min_run bytes."""
    lists = spans.groupBy("_rid").agg(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))).alias("_spans"))
    kind = rows.schema["_row"].dataType.simpleString()
    both = rows.select("_rid", "_row").join(lists, "_rid", "left")
    return both.select("_row", F.coalesce(F.col("_row")[text_col], F.lit("")).alias("_text"), "_spans").mapInArrow(lean(_cut(min_run)), f"_row {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans {SPANS}")
