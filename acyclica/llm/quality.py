"""Quality rules at two levels, with DataFrame functions only.

Each document is judged by rules on its own words and lines. Rule failures are
then counted by host; each host's failure rate is shrunk towards the mean of all
hosts by a beta prior fitted to the hosts' rates (method of moments), and the
documents of hosts whose shrunk rate is over a limit, or far over that mean, go
too. Where hosts don't differ by more than chance, all have the mean's rate and
none fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acyclica.llm.shared import let, stored

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: White space between words: blank, and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Host-level rules only: symbols per 100 word characters, repeated lines per 100 lines with words.
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    #: A host goes if its shrunk failure rate is over this, or over so many times the mean of all hosts.
    max_host_rate: float = 0.5
    max_host_ratio: float = 2.0


def words_of(text: Column) -> Column:
    blank = F.translate(text, SPACES, " " * len(SPACES))
    return F.array_remove(F.split(blank, " "), "")


def _covered(windows: Column) -> Column:
    """Words in windows found twice or more: windows are sorted by key, those with an equal neighbour kept, and their spans added up."""

    def positions(rows: Column) -> Column:
        flagged = F.transform(rows, lambda r, i: F.when((F.get(rows, i - 1)["k"] == r["k"]) | (F.get(rows, i + 1)["k"] == r["k"]), r["i"]))
        return F.array_sort(F.filter(flagged, lambda x: x.isNotNull()))

    def spans(at: Column) -> Column:
        each = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0), lambda a, b: a + b)

    rows = F.array_sort(F.transform(windows, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return let(let(rows, positions), spans)


def repeat_words(words: Column) -> Column:
    """Words inside some 5-word window that the text has twice or more, its first place included."""

    def of_hashes(h: Column) -> Column:
        starts = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), F.size(h) - WINDOW)).otherwise(F.array().cast("array<int>"))
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes).cast("long")


def document_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, _host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    solid = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    words = words_of(text)
    rows = docs.select(
        F.col(id_col),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"),
        F.size(words).cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("_lines"),
        repeat_words(words).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    more = (100 * F.col("n_symbols") > limits.max_symbol_percent * F.col("word_chars")) | (100 * F.col("_lines.dup") > limits.max_dup_line_percent * F.col("_lines.all"))
    return rows.select(id_col, "_host", "n_words", "word_chars", "n_symbols", F.col("_lines.dup").alias("n_dup_lines"), "n_repeat_words", base.alias("base_failed"), (base | more).alias("rule_failed"))


def host_rates(rules: DataFrame) -> DataFrame:
    """_host, host_docs, host_failed, host_rate (the failure rate of each host under the empirical beta prior), mean_rate (the prior's mean)."""
    hosts = rules.groupBy("_host").agg(F.count("*").alias("host_docs"), F.sum(F.col("rule_failed").cast("int")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("host_docs")).alias("noise")).first()
    mean = m["mean"] or 0.0
    # the hosts' own spread: what is left of the variance without the binomial noise
    spread = (m["var"] or 0.0) - mean * (1 - mean) * (m["noise"] or 0.0)
    weight = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    return hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(weight * mean)) / (F.col("host_docs") + F.lit(weight))).withColumn("mean_rate", F.lit(mean))


def judge_quality(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """document_rules with host_rate and kept: no base failure, and the host's shrunk rate is within the limits.

    A null text counts as an empty one (it fails), a null host as a host of its
    own. Repeated rows each count and each get their row; an empty table gives
    an empty result; other columns aren't looked at; a very long text is judged
    whole, in one task. Hosts are counted with partial sums and stored, so that
    Spark knows their size: few are sent to all tasks, and of many a hot host's
    rows can be split.
    """
    rules = stored(document_rules(docs, limits, id_col, text_col, host_col), "quality-rules")
    hosts = stored(host_rates(rules).select("_host", "host_rate", "mean_rate"), "quality-hosts")
    within = (F.col("host_rate") <= limits.max_host_rate) & (F.col("host_rate") <= limits.max_host_ratio * F.col("mean_rate") + 1e-9)
    return rules.join(hosts, "_host").withColumn("kept", ~F.col("base_failed") & within).drop("mean_rate").withColumnRenamed("_host", "host")
