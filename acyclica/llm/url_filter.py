"""URL rules in a sorted digest array.

A rule list is held as the ascending 64-bit xxhash keys of its strings (host and
path prefix), with the strings behind them. Each worker maps that array from a
file; a URL's candidate rules (each suffix of its host at a dot, with each path
prefix length that rules have) are hashed and found by one vectorised binary
search for a whole batch, and a hit counts only if the stored string is equal.
Lists over ``max_bytes`` aren't broadcast: candidates are joined to them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acyclica.llm.workers import lean

#: Above this size a rule list is joined instead of broadcast.
MAX_BYTES = 64 << 20
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty if null or without '://'."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; empty if null or without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """The rules as flat arrays: keys (ascending), starts and lengths of the strings, verdicts, and the strings' bytes."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        kept = {rule.encode(): verdict == BLOCK for verdict, rule in rules}
        rows = sorted((xxhash.xxh64_intdigest(r), r, b) for r, b in kept.items())
        self.head = np.array([len(rows), max([0, *(len(r) - r.index(b"/") for _, r, _ in rows)])], "<i8")
        lengths = np.array([len(r) for _, r, _ in rows], "<i8")
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("<i8") if rows else np.zeros(0, "<i8")
        paths = np.array(sorted({len(r) - r.index(b"/") for _, r, _ in rows}), "<i8")
        self.head = np.array([len(rows), len(paths)], "<i8")
        arrays = [self.head, np.array([k for k, _, _ in rows], "<u8"), starts, lengths, np.array([b for _, _, b in rows], "<i8"), paths]
        self.data = b"".join(a.tobytes() for a in arrays) + b"".join(r for _, r, _ in rows)


class Probe:
    """A DigestArray's bytes mapped from a file that has no name any more, so nothing stays behind."""

    def __init__(self, data: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(data)
        self.file.flush()
        words = np.memmap(self.file, "<i8", "r", shape=(len(data) // 8,))
        n, p = int(words[0]), int(words[1])
        self.keys = words[2 : 2 + n].view("<u8")
        self.starts, self.lengths, self.block = (words[2 + n * i : 2 + n * (i + 1)] for i in (1, 2, 3))
        self.path_lengths = words[2 + 4 * n : 2 + 4 * n + p].tolist()
        self.text = np.memmap(self.file, "u1", "r", offset=8 * (2 + 4 * n + p)) if len(data) > 8 * (2 + 4 * n + p) else np.zeros(0, "u1")

    def find(self, strings: list[bytes]) -> np.ndarray:
        """The row of each string in the array, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not len(self.keys) or not strings:
            return out
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, wanted)
        open_ = np.nonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted))[0]
        for i in open_:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == wanted[i]:  # equal digests of other strings
                if self.text[self.starts[j] : self.starts[j] + self.lengths[j]].tobytes() == strings[i]:
                    out[i] = j
                    break
                j += 1
        return out


def candidates(host: str, path: str, path_lengths: list[int]) -> list[bytes]:
    """Every rule string that could fit, longest first."""
    labels, p, found = host.split("."), path.encode(), []
    for i in range(len(labels)):
        h = ".".join(labels[i:]).encode()
        found += [h + p[:n] for n in path_lengths if n <= len(p)]
    return sorted(found, key=len, reverse=True)


_probes: dict[int, tuple[object, Probe]] = {}


def _judge(shared, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value
        if id(data) not in _probes:
            _probes.clear()
            _probes[id(data)] = (data, Probe(data))
        probe = _probes[id(data)][1]
        for b in batches:
            hosts, paths = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            flat, first = [], [0]
            for h, p in zip(hosts, paths, strict=True):
                flat += candidates(h, p, probe.path_lengths) if h else []
                first.append(len(flat))
            hit = probe.find(flat)
            rules, verdicts = [], []
            for i in range(len(hosts)):
                found = hit[first[i] : first[i + 1]]
                k = np.nonzero(found >= 0)[0]
                rules.append(flat[first[i] + int(k[0])].decode() if len(k) else None)
                verdicts.append((BLOCK if probe.block[found[k[0]]] else ALLOW) if len(k) else default)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=[*b.schema.names, "rule", "verdict"])

    return run


def _joined(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a join on digests, for lists too long to send to each worker."""
    rules = rules.groupBy("rule").agg(F.max_by("verdict", "_n").alias("_v")).withColumn("_path", F.octet_length(F.expr("substring(rule, instr(rule, '/'))")))
    lengths = [r[0] for r in rules.select("_path").distinct().orderBy("_path").collect()]  # path lengths: as many as the longest path at most
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefix = F.filter(F.array(*[F.when(F.octet_length("path") >= n, F.expr(f"cast(substring(cast(path as binary), 1, {n}) as string)")) for n in lengths]), lambda x: x.isNotNull())
    each = rows.withColumn("_row", F.monotonically_increasing_id()).select("*", F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(prefix, lambda p: F.concat(h, p))))).alias("_c"))
    hits = each.select("_c", "host", "path").distinct().join(rules.withColumnRenamed("rule", "_c"), "_c")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("_c", "_v"), F.struct(F.octet_length("_c"), F.octet_length(F.substring_index("_c", "/", 1)))).alias("_best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(*rows.columns, F.col("_best._c").alias("rule"), F.coalesce(F.col("_best._v"), F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict.

    ``rules`` are (verdict, rule) pairs or a frame with these columns; a rule is
    'host/path prefix', fits that host and its subdomains, and the longest one
    that fits decides (of equal lengths the one with the longer host, of equal
    rules the last); very long URLs are read whole. A URL that none fits gets
    ``default`` and a null rule; a null URL or one without '://' has empty host
    and path and fits none. Repeated rows and null ids each get their row; other
    columns aren't looked at; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("rule") + 40)).first()[0] or 0
        if size > max_bytes:
            return _joined(rows, rules.withColumn("_n", F.monotonically_increasing_id()), default)
        rules = [(r["verdict"], r["rule"]) for r in rules.select("verdict", "rule").collect()]
    elif sum(len(r) + 40 for _, r in rules) > max_bytes:
        return _joined(rows, spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "_n long, verdict string, rule string"), default)
    shared = spark.sparkContext.broadcast(DigestArray(rules).data)
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(lean(_judge(shared, default)), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
