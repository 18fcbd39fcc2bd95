import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomwork.llm import queries, token_alignment

from .conftest import ODD

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def spelled(libraries, text):
    """(ids, bytes of each token) of both sides, over the whole text at once."""
    a, b = libraries
    letters = token_alignment.byte_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    raw_a = [bytes([letters[c] for c in a.id_to_token(i)]) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return ids_a, raw_a, ids_b, raw_b


def ranges(raw):
    out, at = [], 0
    for r in raw:
        out.append((at, at + len(r)))
        at += len(r)
    return out


def slow(libraries, texts):
    """The columns of each text, by comparing byte ranges of all its tokens."""
    links, groups, sizes = [], [], []
    for text in texts:
        ids_a, raw_a, ids_b, raw_b = spelled(libraries, text) if text else ([], [], [], [])
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            ids_a, raw_a, ids_b, raw_b = [], [], [], []
        at_a, at_b = ranges(raw_a), ranges(raw_b)
        found, j = [], 0
        for i, (s, e) in enumerate(at_a):
            while j and at_b[j - 1][1] > s:
                j -= 1
            while j < len(at_b) and at_b[j][1] <= s:
                j += 1
            k = j
            while k < len(at_b) and at_b[k][0] < e:
                found.append((ids_a[i], ids_b[k]))
                k += 1
        links.append(found)
        both = sorted({e for _, e in at_a} & {e for _, e in at_b})
        told, first = [], 0
        for end in both:
            inside = lambda ids, at: ",".join(str(x) for x, (s, e) in zip(ids, at, strict=True) if s >= first and e <= end)  # noqa: B023, E731
            told.append(f"{inside(ids_a, at_a)}|{inside(ids_b, at_b)}" if len(at_a) < 3000 else None)
            first = end
        groups.append(told)
        sizes.append((len(ids_a), len(ids_b)))
    counts = Counter(x for found in links for x in found)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    rows = []
    for found, told, (n_a, n_b) in zip(links, groups, sizes, strict=True):
        text = None if None in told else ";".join(told)
        digest = None if text is None else hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        rows.append((n_a, n_b, len(told), len(found), sum(counts[x] == highest[x[1]] for x in found), sum(counts[x] for x in found), digest))
    return rows


TEXTS = [
    "Plain words, with marks; and numbers 12345.",
    "two  spaces\n\nand lines \n with\ttabs\r\nand more   ",
    " a leading blank",
    "\nfeed first",
    "漢字かな 混じり文 éàü ŵ Ω",
    "😀😀 👨‍👩‍👧 x😀y",
    "<|endoftext|> and <s> and </s> [INST]",
    "a ▁ mark of its own",
    "▁",
    " ",
    "\n",
    "\x00 control \x1f\x1c x",
    "nb sp thin　wide line",
    "don't we'll it's I'VE",
    "x" * 3000,
    "é combining, ﬁ ligature ½",
    "",
    None,
    "Plain words, with marks; and numbers 12345.",
]


def test_texts_of_all_kinds(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = slow(libraries, TEXTS)
    for most in (token_alignment.MOST_PAIRS, 0):
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_alignment.aligned_documents(docs, most_pairs=most).collect()}
        assert [got[i] for i in range(len(TEXTS))] == want
    assert want[7] == want[8] == want[16] == want[17] == (0, 0, 0, 0, 0, 0, "")


def test_chunks_join_to_whole_texts(libraries):
    """What chunks give is what the whole text gives: the same with cuts switched off."""
    spec, model = open(public_tokenizers.path("byte_bpe_50k.json")).read(), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    cutting, whole = token_alignment.Aligner(spec, model), token_alignment.Aligner(spec, model)
    assert cutting.can_cut
    whole.can_cut = False
    for x, y in zip(cutting.align(TEXTS), whole.align(TEXTS), strict=True):
        assert x[0] == y[0] and x[1].tolist() == y[1].tolist() and x[2:] == y[2:]


def test_query_by_brute_force(spark, sf, libraries):
    texts = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    want = dict(zip([i for i, _ in texts], slow(libraries, [t for _, t in texts]), strict=True))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i][:6] == row[:6] and (row[6] is None or got[i][6] == row[6])


def test_odd_rows(spark, odd, none_at_all, libraries):
    rows = token_alignment.aligned_documents(odd).collect()
    assert len(rows) == len(ODD)
    got = sorted((tuple(r[c] for c in COLUMNS[:6]) for r in rows))
    assert got == sorted(r[:6] for r in slow(libraries, [t for _, t in ODD]))
    assert token_alignment.aligned_documents(none_at_all).count() == 0
