"""Collocations: frequent word sequences and how much more often their parts meet than by chance.

A shard's words become a generalised suffix automaton that is cut at a depth:
its states are the sets of places at which substrings end, found for the whole
shard at once by splitting the ends of each length by the word before. A state
has the length of its longest substring, a link to the longest suffix that ends
at more places, and their number. Shards enumerate their states' substrings and
the counts are added up over all shards.

So that shards don't hand on every rare sequence, lengths are taken in turn: a
first pass adds up hashes of words and pairs, a second the words and frequent
pairs themselves and hashes of triples of frequent pairs, a third enumerates
longer sequences of frequent triples. Frequent hashes are marked in a bitmap of
fixed size. Two sequences of one mark let more through and change nothing: what
is counted is the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acyclica.llm.shared import stored
from acyclica.llm.workers import lean

# Fixed values of the words: what ends a piece, what lies between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: A byte that no UTF-8 text has stands for the end of a piece.
END = b"\xff"
_TABLE = bytes(0xFF if i in PIECE_ENDS else 0x20 if i in BLANKS else i for i in range(256))
#: Words of a task that go into automata at a time.
SHARD_WORDS = 2_000_000
#: Bits of the map of frequent hashes, 16 MB.
MARKS = 1 << 27


@dataclass
class Automaton:
    """States of all substrings of up to ``depth`` symbols. State 0 is the empty string's."""

    length: np.ndarray
    shortest: np.ndarray
    link: np.ndarray
    count: np.ndarray
    #: A place at which the state's substrings end.
    end: np.ndarray


def automaton(symbols: np.ndarray, depth: int) -> Automaton:
    """The automaton of the strings that lie between zeros in symbols (positive numbers)."""
    at = np.nonzero(symbols)[0]
    # node numbers over all lengths; the root is 0
    node = np.zeros(len(at), np.int64)
    length, suffix, count, end, first = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.array([len(at)])], [np.zeros(1, np.int64)], 1
    top = int(symbols.max(initial=0)) + 1
    for k in range(1, depth + 1):
        before = at - k + 1
        inside = before >= 0
        at, node, before = at[inside], node[inside], before[inside]
        inside = symbols[before] > 0
        at, node, before = at[inside], node[inside], before[inside]
        if not len(at):
            break
        _, some, mine, n = np.unique(node * top + symbols[before], return_index=True, return_inverse=True, return_counts=True)
        length.append(np.full(len(n), k))
        suffix.append(node[some])
        count.append(n)
        end.append(at[some])
        node, first = mine + first, first + len(n)
    length, suffix, count, end = (np.concatenate(x) for x in (length, suffix, count, end))
    # a substring that ends wherever its suffix does shares its state; numbers grow with lengths
    same = count == count[suffix]
    same[0] = False
    same &= suffix > 0
    longest, shortest, link = np.arange(len(length)), length.copy(), suffix.copy()
    for k in range(1, depth + 1):
        (of,) = np.nonzero((length == k) & same)
        shortest[of], link[of] = shortest[suffix[of]], link[suffix[of]]
    for k in range(depth, 0, -1):
        (of,) = np.nonzero((length == k) & same)
        longest[suffix[of]] = longest[of]
    own = longest == np.arange(len(length))
    number = np.cumsum(own) - 1
    return Automaton(length[own], shortest[own], number[longest[link[own]]], count[own], end[own])


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Shard:
    """Words of one language, numbered; 0 is the end of a piece."""

    def __init__(self, lang: str):
        self.lang, self.words, self.parts = lang, _Words({END: 0}), []

    def add(self, text: bytes) -> int:
        found = text.lower().translate(_TABLE).replace(END, b" " + END + b" ").split()
        self.parts.append(np.fromiter(map(self.words.__getitem__, found), np.int64, len(found)))
        return len(found)

    def symbols(self) -> np.ndarray:
        out = np.concatenate([[0], *[x for p in self.parts for x in (p, [0])]]).astype(np.int64)
        self.parts = []
        return out

    def hashes(self) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(self.lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
    """A task's texts in shards of one language each: (lang, text) rows."""
    shards, size = {}, 0
    for b in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, of in texts.items():
            shard = shards.setdefault(lang, _Shard(lang))
            size += shard.add(b"\n".join(of))
        if size >= SHARD_WORDS:
            yield from shards.values()
            shards, size = {}, 0
    yield from shards.values()


def _hash_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n) of each word and each pair of a shard."""
    for shard in _shards(batches):
        symbols, h = shard.symbols(), shard.hashes()
        a = automaton(symbols, 2)
        one, two = a.length == 1, a.length == 2
        # a pair's state may be its second word's too
        both = two & (a.shortest == 1)
        hashes = np.concatenate([h[symbols[a.end[one | both]]], pair_hash(h[symbols[a.end[two] - 1]], h[symbols[a.end[two]]])])
        counts = np.concatenate([a.count[one | both], a.count[two]])
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(MARKS - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def marks(frequent: DataFrame) -> np.ndarray:
    """The bitmap of the hashes in frequent(h): at most MARKS / 64 numbers come to the driver, whatever the input."""
    bit = F.col("h").bitwiseAND(F.lit(MARKS - 1))
    words = frequent.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _segments(symbols: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The symbols of runs of neighbouring starts (each stands for width symbols), with a zero before each run."""
    if not len(starts):
        return np.zeros(1, np.int64)
    new = np.concatenate([[True], np.diff(starts) > 1])
    first, last = starts[new], starts[np.concatenate([new[1:], [True]])] + width
    size = last - first + 1
    take = np.repeat(first - np.cumsum(size) + size - 1, size) + np.arange(int(size.sum()))
    out = symbols[take]
    out[np.cumsum(size) - size] = 0
    return out


def _frequent_pairs(symbols: np.ndarray, h: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where a marked pair begins."""
    (at,) = np.nonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
    return at[_marked(pairs, pair_hash(h[symbols[at]], h[symbols[at + 1]]))]


def _triple_hash(symbols: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return pair_hash(pair_hash(h[symbols[at]], h[symbols[at + 1]]), h[symbols[at + 2]])


def _strings(words: list[bytes], symbols: np.ndarray, a: Automaton, low: int, high: int) -> Iterator[tuple[str, int]]:
    """(phrase, count) of the substrings of low to high words."""
    for n, least, most, end in zip(a.count.tolist(), a.shortest.tolist(), a.length.tolist(), a.end.tolist(), strict=True):
        if most >= low:
            run = [words[w] for w in symbols[end - most + 1 : end + 1].tolist()]
            for k in range(max(least, low), min(most, high) + 1):  # all substrings of a state end at the same places
                yield b" ".join(run[most - k :]).decode(), n


def _batches(lang: str, rows: Iterator[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 100_000)):
        phrases, counts = zip(*some, strict=True)
        yield _batch(lang, phrases, None, counts)


def _batch(lang: str | None, phrases, hashes, counts) -> pa.RecordBatch:
    n = len(counts)
    cols = [pa.array([lang] * n, pa.string()), pa.nulls(n, pa.string()) if phrases is None else pa.array(phrases, pa.string()), pa.nulls(n, pa.int64()) if hashes is None else pa.array(hashes), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "phrase", "h", "n"])


COUNTED = "lang string, phrase string, h long, n long"


def _short_counts(pairs):
    """(lang, phrase, n) of all words and of marked pairs; (h, n) of triples of marked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            symbols, h, words = shard.symbols(), shard.hashes(), list(shard.words)
            used = np.bincount(symbols, minlength=len(words)).tolist()
            yield from _batches(shard.lang, ((w.decode(), n) for i, (w, n) in enumerate(zip(words, used, strict=True)) if i and n))
            runs = _segments(symbols, _frequent_pairs(symbols, h, pairs.value), 2)
            a = automaton(runs, 3)
            yield from _batches(shard.lang, _strings(words, runs, a, 2, 2))
            three = a.length == 3
            yield _batch(None, None, _triple_hash(runs, h, a.end[three] - 2).view(np.int64), a.count[three])

    return run


def _long_counts(pairs, triples, depth: int):
    """(lang, phrase, n) of sequences of marked triples, of 3 to depth words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            symbols, h = shard.symbols(), shard.hashes()
            at = _frequent_pairs(symbols, h, pairs.value)
            at = at[:-1][np.diff(at) == 1]
            at = at[_marked(triples.value, _triple_hash(symbols, h, at))]
            runs = _segments(symbols, at, 3)
            yield from _batches(shard.lang, _strings(list(shard.words), runs, automaton(runs, depth), 3, depth))

    return run


def phrase_counts(docs: DataFrame, depth: int, at_least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f) of words and phrases of up to depth words that occur at_least times in a language, and the number of all its words with a null phrase."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    often = F.col("n") >= at_least
    hashed = texts.mapInArrow(lean(_hash_counts), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    pairs = spark.sparkContext.broadcast(marks(hashed.filter(often)))
    counted = lambda f: texts.mapInArrow(lean(f), COUNTED).groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"))
    word = F.col("phrase").isNotNull() & ~F.contains("phrase", F.lit(" "))
    short = stored(counted(_short_counts(pairs)).filter(often | word), "phrase-short")
    total = short.filter(word).groupBy("lang").agg(F.lit(None).cast("string").alias("phrase"), F.sum("n").alias("f"))
    out = short.filter(often & F.col("phrase").isNotNull()).select("lang", "phrase", F.col("n").alias("f"))
    if depth > 2:
        triples = spark.sparkContext.broadcast(marks(short.filter("h is not null")))
        out = out.unionByName(counted(_long_counts(pairs, triples, depth)).filter(often).select("lang", "phrase", F.col("n").alias("f")))
    return stored(out.unionByName(total), "phrase-counts")


def words_of(phrase: str = "phrase") -> Column:
    return F.size(F.split(phrase, " "))


def subsumed(candidates: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of the candidates inside a longer one of at least that percentage of their count.

    Each candidate goes along its suffix link (without its first word) and to
    its prefix (without its last): if a longer one is frequent enough, so is one
    of a single word more in between.
    """
    longer = candidates.filter("k > 2").select("lang", "f", F.explode(F.array(F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"), F.expr("substring_index(phrase, ' ', k - 1)"))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return candidates.join(most, ["lang", "phrase"]).filter(F.col("most") * 100 >= F.col("f") * percent).select("lang", "phrase")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidates with l, r, n and score: of all cuts the one with the least of floor(1000 a n / (l r)), the first where several have it; decimals, so that products may pass 64 bits."""
    part = counts.filter("phrase is not null")
    total = counts.filter("phrase is null").select("lang", F.col("f").alias("n"))
    cuts = candidates.select("lang", "phrase", "k", "f", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring_index(phrase, ' ', cut - k)"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_above", wide("f") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("_below", wide("l") * wide("r"))
    least = F.min(F.struct(F.expr("_above div _below").alias("score"), "cut", "l", "r", "n")).alias("_least")
    best = cuts.groupBy("lang", "phrase").agg(F.first("f").alias("a"), least)
    return best.select("lang", "phrase", "a", "_least.l", "_least.r", "_least.n", "_least.score")


def collocations(docs: DataFrame, top: int = 2000, max_words: int = 5, at_least: int = 100, percent: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases of 2 to max_words words: lang, rank, phrase, a (its count), l, r (those of the parts), n (all words), score.

    Phrases don't cross pieces. Null and empty texts have no words, a null
    language is ``und``; a very long text is counted whole. Repeated rows count
    each time; other columns aren't looked at, whatever their names. Ties are
    ordered by count and phrase. An empty table gives an empty result.
    """
    counts = phrase_counts(docs, max_words, at_least, text_col, lang_col)
    candidates = counts.filter("phrase is not null").withColumn("k", words_of()).filter("k > 1")
    kept = candidates.join(subsumed(candidates, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = scored(kept, counts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
