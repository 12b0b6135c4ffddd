import pytest

from lodestone.llm import queries

from ..conftest import SMALL
from ..oracle import connection, same

COLUMNS = {
    "op1_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_quality": {"doc_id", "held_out", "score", "predicted"},
    "op4_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op5_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_shard": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op7_pack": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op8_minhash": {"doc_id", "n_shingles", "component_id", "kept"},
    "op9_fingerprint": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op10_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op11_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    "op12_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
    "op13_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert COLUMNS[name] <= set(df.columns)
    if name in queries.ORACLES:
        same(df, connection(SMALL), queries.ORACLES[name])
    else:
        whole = "pages" if name.startswith("op4") else "documents"
        n = spark.read.parquet(f"{SMALL}/{whole}.parquet").count()
        assert df.count() >= n
