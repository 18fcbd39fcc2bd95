import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomwork.llm import piece_codec as pc


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pc.default_model())


@pytest.fixture(scope="module")
def codec():
    with open(pc.default_model(), "rb") as f:
        return pc.PieceCodec(f.read())


def test_ids_and_text_are_the_librarys(library, codec):
    rng = random.Random(3)
    pieces = [library.id_to_piece(i) for i in range(300, 32000)]
    texts = [None, "", " ", "  a", "\n", " \n x", "▁▁x ▁", "<s></s>", "a\x00b", "漢字 😀", "a" * 400, "ab" * 200]
    texts += ["".join(rng.choice("abdet hon\n▁.ßé漢😀\t01") for _ in range(rng.randrange(90))) for _ in range(800)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))).replace("▁", rng.choice(["", " "])) for _ in range(1500)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = library.encode(text or "") + [library.eos_id()]
        assert ids.tolist() == want, text
        assert codec.decode(ids) == library.decode(want)


def test_one_merge_a_round_gives_the_same(codec):
    words = ["▁" + w for w in ("aaaaaaa", "thatthatthat", "abababab", "....!!!!", "internationalisation")]
    symbols = codec.symbol[np.array([ord(c) for w in words for c in w])]
    lengths = np.array([len(w) for w in words])
    fast, slow = codec.merge_words(symbols.copy(), lengths), codec.merge_words(symbols.copy(), lengths, one_at_a_time=True)
    assert np.array_equal(fast[0], slow[0]) and np.array_equal(fast[1], slow[1])


def test_decode_of_any_ids_is_the_librarys(library, codec):
    rng = random.Random(4)
    for _ in range(1500):
        ids = [rng.randrange(32000) if rng.random() < 0.3 else rng.randrange(262) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_memory_is_bounded_by_bytes(library):
    """Long words that never come again are forgotten, and ids stay the library's when words fade and come back."""
    with open(pc.default_model(), "rb") as f:
        codec = pc.PieceCodec(f.read())
    most, merge = [], codec.merge_words
    codec.merge_words = lambda symbols, *a, **b: most.append(len(symbols)) or merge(symbols, *a, **b)
    rng = random.Random(5)
    for _ in range(10):
        text = " ".join(["the same words again", *("".join(rng.choices("abdethon", k=1000)) for _ in range(1000))])
        assert codec.encode([text, None])[0].tolist() == library.encode(text) + [library.eos_id()]
    assert sum(map(len, [*codec.known, *codec.faded])) < 7_000_000
    assert max(most) <= pc.BATCH_CHARS + 1000


def test_rows(odd, library):
    rows = pc.encode_documents(odd).collect()
    assert sorted(map(str, ((r.doc_id, r.ids) for r in rows))) == sorted(map(str, ((r.doc_id, library.encode(r.text or "") + [2]) for r in odd.select("doc_id", "text").collect())))


def test_digests(odd):
    both = pc.encoding_digests(odd).join(pc.encode_documents(odd), "doc_id")
    assert both.where((F.size("ids") != F.col("n_tokens")) | (F.sha2(F.array_join("ids", " "), 256) != F.col("ids_sha256"))).isEmpty()


def test_empty_table(none_at_all):
    assert pc.encode_documents(none_at_all).collect() == []
