"""Each stage of the corpus pipeline, on its own input, against plain Python."""

import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from acyclica.llm import decontaminate, packing  # noqa: E402
from acyclica.llm.wordcache import PieceTokenizer  # noqa: E402
from tests.llm.test_dedup import brute_chunks, brute_components  # noqa: E402
from tests.llm.test_near_copies import alike, brute_set  # noqa: E402
from tests.llm.test_tables import brute_edits  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _at string, edits int"


def corpus(seed=1):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "tion", "er", "th", "and"], "de": ["sch", "ung", "keit", "ü", "ein", "ver"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    prose = lambda lang, n: " ".join(word(lang) for _ in range(n))
    texts = [(prose(lang, rng.randint(20, 120)), lang) for lang in ("en", "de") for _ in range(25)]
    items = [prose("en", rng.randint(15, 40)) for _ in range(5)] + [None, "tiny"]
    passage = prose("de", 70)
    rows = list(texts)
    rows += [(t, lang) for t, lang in texts[:6]]  # exact copies
    for t, lang in texts[6:12]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = word(lang)
        rows.append((" ".join(w), lang))
    rows += [(prose("de", 30) + " " + passage + " " + prose("de", 20), "de") for _ in range(4)]
    rows += [(prose("en", 30) + "\n" + items[i].upper() + " " + prose("en", 10), "en") for i in range(3)]
    rows += [(None, "en"), ("", "en"), ("12 34 !!", "de"), ("the", "en"), (prose("en", 4000), None)]
    rng.shuffle(rows)
    docs = [(i, t, lang, rng.choice(["a", "b", None]), None if t is None else len(t), "x", 1) for i, (t, lang) in enumerate(rows)]
    return [*docs, docs[3], (None, "the nameless thing and the other thing", "en", "a", 38, "x", 1)], items


def test_stages_equal_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frames = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], str(tmp_path)).write.parquet(str(tmp_path / f"{i}-{name}"))
        frames.append(spark.read.parquet(str(tmp_path / f"{i}-{name}")))
    first, language, near, chunks, clean, packed = [f.collect() for f in frames]
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    key = lambda r: str(tuple(r))

    assert sorted(map(key, language)) == sorted(key(r) for r in first if r["text"] and any(c.isalpha() for c in r["text"]))

    sets = [brute_set(r["text"]) for r in language]
    roots = brute_components(len(language), lambda a, b: alike(sets[a], sets[b]))
    classes = defaultdict(list)
    for r, root in zip(language, roots):
        classes[root].append(r)
    assert sorted(map(key, near)) == sorted(key(min(c, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))) for c in classes.values())
    assert len(near) < len(language) - 8

    want = []
    for r, spans in zip(near, brute_chunks([r["text"] for r in near], 96)):
        data, at, kept = r["text"].encode(), 0, b""
        for s, e in spans:
            kept, at = kept + data[at:s], e
        kept = (kept + data[at:]).decode()
        if kept.strip():
            want.append(key([r["doc_id"], kept, r["lang"], r["source"], len(kept) if spans else r["n_chars"], *r[5:]]))
    assert sorted(map(key, chunks)) == sorted(want) and sum(len(r["text"]) for r in chunks) < sum(len(r["text"]) for r in near) - 500

    def leaks(text):
        t = decontaminate.normal(text)
        return any((e := decontaminate.budget(len(p))) >= 0 and brute_edits(p, t) <= e for p in map(decontaminate.normal, items))

    assert sorted(map(key, clean)) == sorted(key(r) for r in chunks if len(r["text"]) > 5000 or not leaks(r["text"]))
    assert len(clean) < len(chunks)

    lib, ids = PieceTokenizer(corpus_pipeline.tokenizer_file("word_bpe_49k.json")).library, {}
    for r in clean:
        ids[r["doc_id"]] = [*lib.encode(r["text"], add_special_tokens=False).ids, corpus_pipeline.END_ID]
    places = set()
    for r in packed:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        places |= {4096 * r["sequence_id"] + r["offset"] + k for k in range(r["length"])}
    assert places == set(range(sum(map(len, ids.values())))) and sum(r["length"] for r in packed) == len(places)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.columns == frames[-1].columns and run.agg({"length": "sum"}).first()[0] == len(places)
    assert packing.pack(frames[0].limit(0), corpus_pipeline.tokenizer_file("word_bpe_49k.json")).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
