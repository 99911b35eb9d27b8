"""Sentence pieces against the library, with a compiled character map too."""

from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from acyclica.llm import pieces
from acyclica.llm.queries import op13_sentencepiece, tokenizer_file

MODEL = "piece_bpe_32k.model"
SIGNS = list("abcde  ▁Zé日😀\x00\t\n\r.,'́ﬁÀ𐍈　")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(MODEL))


def spans(library, text: str) -> list[tuple[int, int, int]]:
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


@pytest.mark.parametrize("by_word", [True, False])
def test_ids_and_spans_are_the_librarys(library, by_word):
    encoder, draw = pieces.Encoder(tokenizer_file(MODEL)), random.Random(7)
    kept = encoder.model.by_word
    encoder.model.by_word = by_word
    texts = ["", " ", "  ", "▁", "a" * 5000, " " * 300, "日" * 400, *["".join(draw.choice(SIGNS) for _ in range(draw.randint(1, 40))) for _ in range(600)]]
    try:
        for text, (ids, starts, ends) in zip(texts, encoder.encode(texts), strict=True):
            assert list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)) == spans(library, text), text
    finally:
        encoder.model.by_word = kept


def test_words_are_forgotten_at_the_limit(library, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_WORDS", 3)
    encoder = pieces.Encoder(tokenizer_file(MODEL))
    for text in ["one two three four", "five six one", "one two seven eight nine", ""]:
        assert [i.tolist() for i, _, _ in encoder.encode([text])] == [library.encode(text)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_longest_prefixes_and_places_of_a_compiled_map(rule):
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model, draw = pieces.Model(norm.serialized_model_proto()), random.Random(3)
    signs = SIGNS + list("①Ⅷ ﬁﾊﾞ ̈é가각ẞ")
    for text in ["", " ", "   ", *["".join(draw.choice(signs) for _ in range(draw.randint(1, 25))) for _ in range(400)]]:
        got, places = model.normalise(text.encode())
        want, offsets = norm.Normalize(text, with_offsets=True)
        assert got.decode() == want
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
        first = [0]
        for c in want:
            first.append(first[-1] + len(c.encode()))
        assert [int(places[i]) for i in first[:-1]] == [at[o] for o in offsets[: len(want)]], text


def test_rows_nulls_and_clashing_names(spark, library):
    texts = ["Hello  wörld", None, "", "Hello  wörld", "x" * 300_000]
    df = spark.createDataFrame([(i, t, i, [i]) for i, t in enumerate(texts)], "doc_id long, text string, ids long, `a.b` array<int>")
    out = pieces.decode(pieces.encode(df, tokenizer_file(MODEL)), tokenizer_file(MODEL)).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r["_row"]["doc_id"]] or ""
        assert r["ids"] == library.encode(text) and r["decoded"] == (library.decode(r["ids"]) if r["ids"] else "")
        assert r["_row"]["ids"] == r["_row"]["doc_id"] and r["_row"]["a.b"] == [r["_row"]["doc_id"]]
        if text:
            covered = b"".join(text.encode()[s:e] for s, e in zip(r["starts"], r["ends"], strict=True))
            assert covered == text.encode()
    empty = pieces.decode(pieces.encode(df.limit(0), tokenizer_file(MODEL)), tokenizer_file(MODEL))
    assert empty.count() == 0 and empty.columns == ["_row", "ids", "starts", "ends", "decoded"]


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {r["doc_id"]: library.encode(r["t"]) for r in docs}
    want = sorted((k, len(v), sha(",".join(map(str, v))), sha(library.decode(v) if v else "")) for k, v in ids.items())
    assert sorted(map(tuple, op13_sentencepiece(spark, "/root/testdata/sf0.001").collect())) == want
