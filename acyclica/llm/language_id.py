"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows in both directions, labels every byte with a
distribution over the languages, and a document's probabilities are the means
over all bytes of its whole text. Windows overlap by CONTEXT bytes at both ends,
which are read but not counted, so that each labelled byte has that much text on
either side. The network is trained here in numpy by backpropagation through
time on windows from anywhere in the labelled rows' whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acyclica.llm.wordcache import drop_tokenizers, spread
from acyclica.llm.workers import lean

#: Bytes of a window that is learned from; bytes labelled in one go, and read before and after them.
WINDOW, LABELLED, CONTEXT = 64, 256, 16
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
GATES = ("r", "z", "n")


@dataclass(frozen=True)
class Training:
    """``docs_per_lang`` and ``windows_per_lang`` bound the sample (as expected numbers): rows are drawn by a hash of their id, and windows by a hash from all of their whole texts."""

    docs_per_lang: int = 400
    windows_per_lang: int = 1600
    hidden: int = 8
    epochs: int = 4
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


class Direction:
    """One gated recurrent unit: x holds each byte's input to the three gates, u and c the state's."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.x = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
        self.c = np.zeros(3 * hidden, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c]

    def states(self, data: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States after each byte of data (time x windows); where mask is 0 the state is 0. keep: gets what the gradient needs."""
        steps, n = data.shape
        k = self.u.shape[0]
        h = np.zeros((n, k), np.float32)
        out = np.empty((steps, n, k), np.float32)
        for t in range(steps):
            g = self.x[data[t]]
            s = h @ self.u + self.c
            gates = np.tanh((g[:, : 2 * k] + s[:, : 2 * k]) * np.float32(0.5))
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            r, z = gates[:, :k], gates[:, k:]
            sn = s[:, 2 * k :]
            c = np.tanh(g[:, 2 * k :] + r * sn)
            if keep is not None:
                keep.append((h, r, z, sn, c))
            h = c + z * (h - c)
            if mask is not None:
                h = h * mask[t][:, None]
            out[t] = h
        return out

    def read(self, data: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """states() for predictions: halves and biases are put into the weights, and no step takes new memory."""
        (steps, n), k, half = data.shape, self.u.shape[0], np.float32(0.5)
        xg, xn = (self.x[:, : 2 * k] + self.c[: 2 * k]) * half, np.ascontiguousarray(self.x[:, 2 * k :])
        ug, un, cn = self.u[:, : 2 * k] * half, self.u[:, 2 * k :] * half, self.c[2 * k :] * half
        gates, more, c, s = (np.empty((n, w), np.float32) for w in (2 * k, 2 * k, k, k))
        h, out = np.zeros((n, k), np.float32), np.empty((steps, n, k), np.float32)
        for t in range(steps):
            xg.take(data[t], 0, gates, "clip")
            np.matmul(h, ug, more)
            gates += more
            np.tanh(gates, gates)
            gates += 1  # twice the gates
            np.matmul(h, un, s)
            s += cn
            s *= gates[:, :k]
            xn.take(data[t], 0, c, "clip")
            c += s
            np.tanh(c, c)
            np.subtract(h, c, s)
            s *= gates[:, k:]
            s *= half
            h = np.add(s, c, out[t])
            if mask is not None:
                h *= mask[t][:, None]
        return out

    def gradient(self, data: np.ndarray, mask: np.ndarray, keep: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Of the parameters, given that of the states: backwards through time."""
        steps, n = data.shape
        k = self.u.shape[0]
        dx, du, dc = (np.zeros_like(p) for p in self.parameters())
        dh = np.zeros((n, k), np.float32)
        inputs = np.empty((steps, n, 3 * k), np.float32)
        for t in range(steps - 1, -1, -1):
            h, r, z, sn, c = keep[t]
            dh = (dh + d_out[t]) * mask[t][:, None]
            da_n = dh * (1 - z) * (1 - c * c)
            da_z = dh * (h - c) * z * (1 - z)
            da_r = da_n * sn * r * (1 - r)
            inputs[t] = np.concatenate([da_r, da_z, da_n], 1)
            ds = np.concatenate([da_r, da_z, da_n * r], 1)
            du += h.T @ ds
            dc += ds.sum(0)
            dh = dh * z + ds @ self.u.T
        flat, rows = data.ravel(), inputs.reshape(-1, 3 * k)
        order = np.argsort(flat, kind="stable")
        first = np.concatenate([[0], np.nonzero(np.diff(flat[order]))[0] + 1])
        dx[flat[order][first]] = np.add.reduceat(rows[order], first, axis=0)
        return [dx, du, dc]


class Network:
    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.behind = Direction(hidden, rng), Direction(hidden, rng)
        self.v = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.b = np.zeros(len(langs), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.behind.parameters(), self.v, self.b]

    def label(self, data: np.ndarray, mask: np.ndarray | None, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Probabilities at each byte (time x windows x languages), and the states if there is a gradient to come."""
        back = None if mask is None else mask[::-1]
        if keep is None:
            k = self.ahead.u.shape[0]
            f, r = self.ahead.read(data, mask), self.behind.read(data[::-1], back)[::-1]
            y = f @ self.v[:k]
            y += r @ self.v[k:]
            y += self.b
            h = None
        else:
            f, r = self.ahead.states(data, mask, keep[0]), self.behind.states(data[::-1], back, keep[1])[::-1]
            h = np.concatenate([f, r], 2)
            y = h @ self.v + self.b
        y -= y.max(2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(2, keepdims=True)
        return y, h

    def gradient(self, data: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all bytes, each to have the label of its window, and its gradient."""
        keep = ([], [])
        y, h = self.label(data, mask, keep)
        total = float(mask.sum())
        windows = np.arange(data.shape[1])
        loss = -float((np.log(y[:, windows, target] + 1e-9) * mask).sum()) / total
        dy = y
        dy[:, windows, target] -= 1
        dy *= (mask / np.float32(total))[:, :, None]
        flat = dy.reshape(-1, dy.shape[2])
        dv, db = h.reshape(flat.shape[0], -1).T @ flat, flat.sum(0)
        dh = dy @ self.v.T
        k = self.ahead.u.shape[0]
        one = self.ahead.gradient(data, mask, keep[0], dh[:, :, :k])
        two = self.behind.gradient(data[::-1], mask[::-1], keep[1], dh[::-1, :, k:])
        return loss, [*one, *two, dv, db]

    def fit(self, data: np.ndarray, mask: np.ndarray, target: np.ndarray, how: Training) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(how.seed)
        p = self.parameters()
        m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        step = 0
        for _ in range(how.epochs):
            order = rng.permutation(data.shape[1])
            for lo in range(0, len(order), how.batch):
                rows = order[lo : lo + how.batch]
                _, grads = self.gradient(data[:, rows], mask[:, rows], target[rows])
                step += 1
                for x, g, a, s in zip(p, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    s += 0.001 * (g * g - s)
                    x -= how.rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts as (time x windows), the mask of real bytes, and the text of each window."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = -(-lengths // size)
    owner = np.repeat(np.arange(len(texts)), counts)
    grid = np.zeros((len(owner), size), np.uint8)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        grid[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        at += n
    last = np.minimum(size, lengths[owner] - size * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)))
    mask = (np.arange(size)[:, None] < last[None, :]).astype(np.float32)
    return np.ascontiguousarray(grid.T), mask, owner


def pooled(net: Network, texts: list[bytes], part: int = 2048) -> np.ndarray:
    """Mean probabilities of each text over all its bytes; zeros for an empty one."""
    out = np.zeros((len(texts), len(net.langs)))
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    counts = -(-size // LABELLED)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(size) - size
    lo = spread(np.zeros(len(texts), np.int64), counts) * LABELLED  # of the labelled bytes, in the text
    begin, end = np.maximum(0, lo - CONTEXT), np.minimum(size[owner], lo + LABELLED + CONTEXT)
    order = np.argsort(end - begin, kind="stable")  # windows of like lengths together
    for at in range(0, len(order), part):
        w = order[at : at + part]
        time = np.arange(int((end - begin)[w].max()))[:, None]
        place = begin[w] + time
        there = place < end[w]
        data = flat[np.where(there, first[owner[w]] + place, 0)]
        y, _ = net.label(data, None if there.all() else there.astype(np.float32))
        counted = there & (place >= lo[w]) & (place < lo[w] + LABELLED)
        np.add.at(out, owner[w], np.einsum("tnl,tn->nl", y, counted.astype(np.float32)))
    return out / np.maximum(1, size)[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text and LETTER.search(text))


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tokenizers()
        for b in batches:
            langs, scores = [UNKNOWN] * len(b), [0.0] * len(b)
            rows, texts, size = [], [], 0
            for i, t in enumerate(b.column(b.num_columns - 1)):
                text = t.as_py()
                if net is not None and has_letter(text):
                    rows.append(i)
                    texts.append(text.encode())
                    size += len(texts[-1])
                if texts and (size > 1 << 20 or i == len(b) - 1):
                    p = pooled(net, texts)
                    best = p.argmax(1)
                    for r, k, s in zip(rows, best.tolist(), p[np.arange(len(p)), best].tolist(), strict=True):
                        langs[r], scores[r] = net.langs[k], min(1.0, max(0.0, s))
                    rows, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text is 2 modulo 4. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(labelled: DataFrame, text_col: str, lang_col: str, key: Column, how: Training = Training()) -> Network | None:
    """A network from a bounded sample of rows with text and language; None if there are none. Every language is learned; the driver gets one row and about windows_per_lang windows a language."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), key.alias("key"))
    rows = rows.withColumn("windows", F.ceil(F.length("text") / WINDOW).cast("long"))
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy("lang").agg(F.count("*"), F.sum("windows")).collect()}
    if not counts:
        return None
    docs = {lang: min(1.0, how.docs_per_lang / n) for lang, (n, _) in counts.items()}
    shares = [(lang, docs[lang], min(1.0, how.windows_per_lang / (docs[lang] * w))) for lang, (_, w) in counts.items()]
    shares = rows.sparkSession.createDataFrame(shares, "lang string, share double, part double")

    def lot(*cols):
        return F.pmod(F.xxhash64(*cols, F.lit(how.seed)), F.lit(1_000_000)) / 1_000_000

    drawn = rows.join(F.broadcast(shares), "lang").filter(lot("key") < F.col("share"))
    places = drawn.select("lang", "text", "key", "part", "windows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("at"))
    taken = places.filter(lot("key", "at") < F.col("part"))
    piece = F.substring(F.col("text"), (F.col("at") * WINDOW).cast("int") + 1, F.lit(WINDOW))
    sample = sorted((r[0], r[1]) for r in taken.select("lang", piece.alias("piece")).collect())
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    net = Network(langs, how.hidden, how.seed)
    if len(langs) > 1:
        data, mask, owner = windows([p.encode()[:WINDOW] for _, p in sample])
        net.fit(data, mask, np.array([langs.index(sample[i][0]) for i in owner.tolist()]), how)
    return net


def predict(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row with lang_pred and score: the most probable language of the whole text and its pooled probability.

    A null text and one without a letter are 'und' with score 0, and so is every
    text if there was nothing to learn from. Only the text is read for a
    prediction; a very long text is read whole, in one task; repeated rows each
    get their row; an empty table gives an empty result.
    """
    kinds = dict(docs.dtypes)
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).alias("_text"))
    schema = ", ".join([*[f"{n} {kinds[c]}" for c, n in zip(keep, names, strict=True)], "lang_pred string, score double"])
    return rows.mapInArrow(lean(_predict(net)), schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))
