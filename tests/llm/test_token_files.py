import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomwork.llm import token_files as tf


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tf.default_tokenizer())


def test_chunks_are_the_librarys(library):
    with open(tf.default_tokenizer()) as f:
        own = tf.ChunkedTokenizer(f.read())
    rng = random.Random(2)
    texts = ["", " ", "\n", "a ", " a", "<|endoftext|> x", "don't I'll\n's", "ab.", "ab.. c"]
    texts += ["".join(rng.choice("abcde th\n.,'s 12é漢\t\r \0<|") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_round_trip(odd, spark, tmp_path, library):
    folder = f"file://{tmp_path / 'tokens'}"
    manifest = tf.write_token_files(odd, folder)
    rows = sorted(tf.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert manifest["docs"] == len(rows) == odd.count()
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in odd.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert at == manifest["tokens"]
    sums = {(r.start): r.ids_crc32 for r in tf.read_token_checksums(spark, folder).collect()}
    assert sums == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}


def test_files_are_flat_integers(make, spark, tmp_path):
    folder = tmp_path / "flat"
    manifest = tf.write_token_files(make([(2, "b"), (1, "a")]), f"file://{folder}")
    shards = [np.memmap(folder / f"shard-{s['shard']:05d}.tokens", manifest["dtype"], mode="r") for s in manifest["shards"]]
    assert np.concatenate(shards).tolist() == [64, 0, 65, 0]
    assert [s["token_base"] for s in manifest["shards"]] == np.cumsum([0, *[len(s) for s in shards]])[:-1].tolist()


def test_empty_table(none_at_all, spark, tmp_path):
    folder = f"file://{tmp_path / 'none'}"
    assert tf.write_token_files(none_at_all, folder)["docs"] == 0
    assert tf.read_token_files(spark, folder).collect() == []
