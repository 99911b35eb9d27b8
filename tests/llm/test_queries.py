"""Every registered query of the training-data operators over whole small tables, and its SQL."""

import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from acyclica.llm.oracles import ORACLES  # noqa: E402
from acyclica.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_url_filter": "page_id host path rule verdict",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_language_id": "doc_id held_out lang_pred score",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_its_columns_and_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    assert set(COLUMNS.get(name, "doc_id").split()) <= set(got.columns)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    if name not in ("op1_decontamination", "op5_packing"):
        table, key = ("pages", "page_id") if "url" in name else ("documents", "doc_id")
        assert sorted(r[key] for r in rows) == sorted(x[0] for x in con.sql(f"select {key} from {table}").fetchall())
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        order = sorted(want.columns)
        assert order == sorted(got.columns)
        assert sorted(str(tuple(r[c] for c in order)) for r in rows) == sorted(str(x) for x in want.select(", ".join(order)).fetchall())
    if name == "op10_language_id":
        lang = dict(con.sql("select doc_id, lang from documents").fetchall())
        held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
        assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held) > 0
