"""The registered queries: against their SQL where there is one, else against the libraries or the slow versions, row by row."""

import duckdb
import pytest
import sentencepiece

from loomwork.llm import oracles, queries

from .test_simhash_dedup import components, signed, slow_fingerprint


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf), duck.sql(oracles.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda found: sorted(tuple(str(v) for v in r) for r in found)
    assert rows(got.select(*columns).collect()) == rows(want.select(", ".join(columns)).fetchall())


def test_op4_by_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    group = components(fps.values(), 4)
    for r in queries.op4_simhash_near_dedup(spark, sf).collect():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == min(i for i, fp in fps.items() if fp in group[fps[r.doc_id]])
    assert signed(0) == 0


def test_op10_is_the_library(spark, sf):
    import hashlib

    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    for r in queries.op10_sentencepiece(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
