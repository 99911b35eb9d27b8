"""Exact tokenization through a bounded cache of text pieces.

A byte-pair tokenizer encodes each pre-token on its own, so a text may be cut
at any place where two pre-tokens are sure to meet, and the ids of the parts
joined. Words repeat far more than texts do: each distinct one is encoded once
per cache generation, and the rest are numbers in an Arrow dictionary.

The cuts are conservative. A piece is a run of Latin letters that an ASCII
character other than a letter follows, or else everything up to the next blank
(so "'t", "$$$" and every script other than Latin stay whole and the library
decides). Texts with characters that may change a neighbour across a cut
(unusual white space, controls, capital sigma) go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from acyclica.llm.workers import give_back


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
OTHER_ASCII = r"\x00-\x40\x5b-\x60\x7b-\x7f"
UNSURE = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0Ǆ-ǌ̀-ͯΣ  -‏ -  　﻿]")
#: White space is dropped by this kind of tokenizer.
DROPS_SPACE = re.compile(rf"[{LETTERS}]+(?=[{OTHER_ASCII}]|\Z)|[^ \t\n]+")
#: A blank belongs to the word after it; of a longer run only the last blank does.
KEEPS_SPACE = re.compile(rf" ?[{LETTERS}]+(?=[{OTHER_ASCII}]|\Z)| ?[^ \t\n]+|[ \t\n]+(?![^ \t\n])|[ \t\n]")
#: A word's Latin letters at the front and what follows, if an ASCII character other than a letter does (for Arrow's regular expressions).
FRONT = rf"^(?P<l> ?[{LETTERS}]+)(?P<r>[\x00-\x08\x0b-\x40\x5b-\x60\x7b-\x7f][^\t\n]*)?$"
#: Bytes of texts encoded at a time; words merged at a time.
PART, ROWS = 1 << 20, 1 << 14
MULTIPLIER, U32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that byte-level vocabularies write it as: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """A vocabulary file's byte-pair merges for many words at once: rows of ids, in each the merge of the lowest rank (the leftmost of equal ones) a round."""

    NONE = np.int32(1 << 30)

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        shown = byte_letters()
        self.first = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[shown[b] + end] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a, b, made = (np.array([vocab[x] for x in ids], np.uint64) for ids in ([p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
        self.made = made.astype(np.int32)
        # open addressing, a fifth full at most: a look-up ends at an equal key or a free slot
        self.bits = int(len(pairs) * 5).bit_length()
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ranks = np.full(1 << self.bits, self.NONE, np.int32)
        key, rank = (a << U32 | b) + np.uint64(1), np.arange(len(pairs), dtype=np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == 0
            at, which = np.unique(slot[free], return_index=True)
            which = np.nonzero(free)[0][which]
            self.keys[at], self.ranks[at] = key[which], rank[which]
            left = np.ones(len(key), bool)
            left[which] = False
            key, rank, slot = key[left], rank[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE if there is no such merge."""
        key = (a.astype(np.uint64) << U32 | b.astype(np.uint64)) + np.uint64(1)
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], self.NONE)
        open_ = np.nonzero((held != key) & (held != 0))
        while len(open_[0]):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[tuple(x[hit] for x in open_)] = self.ranks[slot[open_][hit]]
            more = ~hit & (held != 0)
            open_ = tuple(x[more] for x in open_)
        return out

    def rows(self, data: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of ``size`` bytes that begin at ``start``, and how many of each row count."""
        ids = self.first[data[start[:, None] + np.arange(size)]]
        ids[:, -1] = self.last[data[start + size - 1]]
        n = np.full(len(ids), size)
        live, cur = np.arange(len(ids)), ids
        rank = self.rank(cur[:, :-1], cur[:, 1:]) if size > 1 else np.zeros((len(ids), 0), np.int32)
        while rank.shape[1]:
            at = rank.argmin(1)
            least = rank[np.arange(len(rank)), at]
            go = least < self.NONE
            done = live[~go]
            ids[done, : cur.shape[1]] = cur[~go]
            n[done] = cur.shape[1]
            live, cur, rank, at, least = live[go], cur[go], rank[go], at[go], least[go]
            if not len(live):
                return ids, n
            row, cols = np.arange(len(live)), np.arange(cur.shape[1] - 1)[None, :]
            cur = np.take_along_axis(cur, cols + (cols > at[:, None]), 1)
            cur[row, at] = self.made[least]
            cols = cols[:, :-1]
            # the pair at ``at`` is gone; the pairs before and after the new id are others
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), 1)
            for k, some in ((at - 1, at > 0), (at, at < cur.shape[1] - 1)):
                r, k = row[some], k[some]
                rank[r, k] = self.rank(cur[r, k], cur[r, k + 1])
        ids[live, : cur.shape[1]] = cur
        n[live] = cur.shape[1]
        return ids, n

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has. No word is null or empty."""
        words = words.cast(pa.large_string())
        ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        start, size = ends[:-1], np.diff(ends)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        n, parts = np.zeros(len(words), np.int64), []
        for s in np.unique(size).tolist():
            which = np.nonzero(size == s)[0]
            for lo in range(0, len(which), ROWS):
                w = which[lo : lo + ROWS]
                ids, n[w] = self.rows(data, start[w], s)
                parts.append((w, ids))
        first = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.uint32)
        for w, ids in parts:
            col = np.arange(ids.shape[1])[None, :]
            here = col < n[w][:, None]
            out[(first[w][:, None] + col)[here]] = ids[here]
        return out, n


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n of them) for each row, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class PieceTokenizer:
    """encode() gives what the library's encode(text, add_special_tokens=False) does, for many texts at once.

    The words of a batch are numbered by Arrow, so that each distinct one is
    looked up once. Words are kept as long as there are at most ``max_pieces``,
    so memory is bounded. Pieces of Latin letters go through Merges, all others,
    and whole texts that can't be cut, to the library.
    """

    def __init__(self, path: str, max_pieces: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.keeps_space = self.library.pre_tokenizer.__class__.__name__ == "ByteLevel"
        self.cut = KEEPS_SPACE if self.keeps_space else DROPS_SPACE
        self.merges, self.max_pieces = Merges(path), max_pieces
        self._forget()

    def _forget(self) -> None:
        self.known, self.others = pa.array([], pa.large_string()), {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _append(self, words: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        """New words, numbered from the number of those known; a null stands for ids that no word is to find."""
        at = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(n) > len(self.size):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[at : at + len(n)] = self.used + np.cumsum(n) - n
        self.size[at : at + len(n)] = n
        self.used += len(ids)
        self.known = pa.concat_arrays([self.known, words])

    def _other(self, text: str) -> np.ndarray:
        """Ids of a piece that isn't all Latin letters, or of several."""
        if (ids := self.others.get(text)) is None:
            ids = self.others[text] = np.array([x for p in self.cut.findall(text) for x in self.whole(p)], np.uint32)
        return ids

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has: Latin letters at the front by Merges, what follows by the library."""
        cut = pc.extract_regex(words, FRONT)
        front, rest = pc.fill_null(pc.struct_field(cut, "l"), ""), pc.if_else(cut.is_valid(), pc.fill_null(pc.struct_field(cut, "r"), ""), words)
        front = front if self.keeps_space else pc.utf8_lower(front)
        ids, first, size, at = [], np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64), 0
        for k, part in enumerate((front, rest)):
            some = pc.not_equal(part, "")
            coded = part.filter(some).dictionary_encode()
            if not len(coded):
                continue
            if k:
                each = [self._other(x) for x in coded.dictionary.to_pylist()]
                flat, n = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
            else:
                flat, n = self.merges.encode(coded.dictionary)
            which, code = some.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
            first[which, k], size[which, k] = (at + np.cumsum(n) - n)[code], n[code]
            ids.append(flat)
            at += len(flat)
        return np.concatenate(ids)[spread(first.ravel(), size.ravel())], size.sum(1)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of different words, none of them empty; those without one are encoded."""
        out = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.nonzero(out < 0)[0]
        if len(missing):
            new = words.take(pa.array(missing))
            out[missing] = len(self.known) + np.arange(len(missing))
            self._append(new, *self._fresh(new))
        return out

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of texts that can be cut at blanks, and how many words each has."""
        parts = pc.split_pattern(texts, " ") if self.keeps_space else pc.ascii_split_whitespace(texts)
        offsets = parts.offsets.to_numpy()
        offsets = offsets - offsets[0]
        words = parts.flatten()
        if self.keeps_space:  # a blank belongs to the word behind it: the first of a text has none
            heads = np.zeros(len(words), bool)
            heads[offsets[:-1]] = True
            coded, out = words.dictionary_encode(), np.full(len(words), -1, np.int64)
            codes, blank = coded.indices.to_numpy(), [pa.scalar(x, pa.large_string()) for x in ("", " ")]
            for which in (heads, ~heads):
                used = np.zeros(len(coded.dictionary), bool)
                used[codes[which]] = True
                number, names = np.full(len(used), -1, np.int64), coded.dictionary
                if which is heads:
                    used &= pc.not_equal(names, "").to_numpy(zero_copy_only=False)
                else:
                    names = pc.binary_join_element_wise(blank[0], names, blank[1])
                number[used] = self._numbers(names.filter(pa.array(used)))
                out[which] = number[codes[which]]
        else:
            coded = words.dictionary_encode()
            full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)  # empty: white space at a text's ends
            number = np.full(len(full), -1, np.int64)
            number[full] = self._numbers(coded.dictionary.filter(pa.array(full)))
            out = number[coded.indices.to_numpy()]
        keep = out >= 0
        upto = np.concatenate([[0], np.cumsum(keep)])[offsets]
        return out[keep], np.diff(upto)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words of all texts, in their order, and how many words each text has."""
        if len(self.known) > self.max_pieces or self.used > 16 * self.max_pieces:
            self._forget()
        lost = pc.match_substring_regex(texts, UNSURE.pattern).to_numpy(zero_copy_only=False) | pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        odd = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " ")).to_numpy(zero_copy_only=False) if self.keeps_space else np.zeros(len(texts), bool)
        if not (lost | odd).any():
            return self._words(texts)
        easy = ~(lost | odd)
        kinds = [(easy, *self._words(texts.filter(pa.array(easy))))]
        if (some := odd & ~lost).any():
            pieces = [self.cut.findall(t) for t in texts.filter(pa.array(some)).to_pylist()]
            coded = pa.array(chain.from_iterable(pieces), pa.large_string()).dictionary_encode()
            kinds.append((some, self._numbers(coded.dictionary)[coded.indices.to_numpy()], np.array([len(x) for x in pieces])))
        if lost.any():
            ids = [np.array(self.whole(t), np.uint32) for t in texts.filter(pa.array(lost)).to_pylist()]
            kinds.append((lost, len(self.known) + np.arange(len(ids)), np.ones(len(ids), np.int64)))
            self._append(pa.nulls(len(ids), pa.large_string()), np.concatenate(ids), np.array([len(x) for x in ids]))
        count = np.zeros(len(texts), np.int64)
        for which, _, n in kinds:
            count[which] = n
        first = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int64)
        for which, numbers, n in kinds:
            flat[spread(first[which], n)] = numbers
        return flat, count

    def parts(self, texts: pa.Array) -> Iterator[pa.Array]:
        """Slices of about PART bytes, nulls as empty texts: what is encoded at a time."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, "right")))
            yield texts.slice(lo, hi - lo)
            lo = hi

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of parts(texts): the ids of its texts, one after the other, and how many each text has."""
        for part in self.parts(texts):
            words, n = self._encode(part)
            size = self.size[words]
            ends = np.concatenate([[0], np.cumsum(size)])
            upto = np.cumsum(n)
            yield self.flat[spread(self.first[words], size)], ends[upto] - ends[upto - n]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = [np.zeros(0, np.int64)]
        for part in self.parts(texts):
            words, n = self._encode(part)
            ends = np.concatenate([[0], np.cumsum(self.size[words])])
            upto = np.cumsum(n)
            out.append(ends[upto] - ends[upto - n])
        return np.concatenate(out)


_made: dict[tuple[str, int], PieceTokenizer] = {}
MAX_PIECES = 300_000


def piece_tokenizer(path: str, max_pieces: int = MAX_PIECES) -> PieceTokenizer:
    """One tokenizer for each Python worker, kept between batches and tasks."""
    key = (path, max_pieces)
    if key not in _made:
        drop_tokenizers()
        _made[key] = PieceTokenizer(path, max_pieces)
    return _made[key]


def drop_tokenizers() -> None:
    """Frees what the worker keeps for encoding, and gives it back to the system; called by operators that don't encode, as Spark uses workers again."""
    if _made:
        _made.clear()
        give_back()
