import re
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from loomwork.llm import license_scan as ls
from loomwork.llm import quality_rules as qr


def test_licenses(make, odd, none_at_all, spark):
    mit = ls.MIT.replace("<year> <copyright holders>", "2021 Some Body").upper().replace("LICENSE", "LICENCE")
    texts = [(1, mit), (2, ls.MIT + " more"), (3, "released  under the mit\nlicence"), (4, None), (5, ls.ISC.replace('"', "''"))]
    found = {r.doc_id: r.license_id for r in ls.scan(make(texts).withColumn("digest", F.lit("clash")).withColumn("license_id", F.lit("clash")), ls.known_digests(spark)).collect()}
    assert found == {1: "MIT", 2: None, 3: "MIT", 4: None, 5: "ISC"}
    rows = ls.scan(odd, ls.known_digests(spark)).collect()
    assert len(rows) == odd.count() and {r.license_id for r in rows} == {None}
    assert ls.scan(none_at_all, ls.known_digests(spark)).collect() == []


def test_canonical_forms_stay_as_they_are(make):
    texts = [(1, "licence licence licence sub licence licence"), (2, ls.MIT), (3, "Licence, sub-licence organisation organisation")]
    once = make(texts).select(ls.canonical(F.col("text")).alias("text"))
    assert once.where(ls.canonical(F.col("text")) != F.col("text")).count() == 0
    assert "licence" not in " ".join(r.text for r in once.collect())


def test_every_known_text_is_found_in_other_dress(make, spark):
    dress = lambda t: t.upper().replace(",", " , ").replace("LICENSE", "LICENCE").replace("\n\n", "\n\n\n").replace("<YEAR>", "1999").replace(".", " .")
    rows = [(k, dress(t), name) for k, (name, t) in enumerate((name, t) for name, texts in ls.KNOWN.items() for t in texts)]
    found = {r.doc_id: r.license_id for r in ls.scan(make([r[:2] for r in rows]), ls.known_digests(spark)).collect()}
    assert found == {k: name for k, _, name in rows}


def test_whole_texts_of_long_licenses(make, spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {f: name for f, name in files.items() if Path("/usr/share/common-licenses", f).exists()}
    texts = [Path("/usr/share/common-licenses", f).read_text() for f in there]
    docs = [(k, t.upper().replace("\n", "\n  ")) for k, t in enumerate(texts)] + [(100 + k, t[:-40]) for k, t in enumerate(texts)]
    found = {r.doc_id: r.license_id for r in ls.scan(make(docs), ls.known_digests(spark)).collect()}
    assert found == dict(enumerate(there.values())) | {100 + k: None for k in range(len(texts))}


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_rules(make, odd, none_at_all):
    more = make([(20, "a b c a b c d a b"), (21, "x y\nx y\n \n \nx y"), (22, "a a a a"), (23, " ".join(f"the w{k}" for k in range(60))), (24, " ".join(["the w x"] * 40)), (25, "#*$%&|<> é ")])
    texts = {(str(r.doc_id), r.text) for r in odd.union(more).collect()}
    rows = qr.judged(odd.union(more)).collect()
    assert len(rows) == odd.count() + 6
    by_id = {str(r.doc_id): r for r in rows}
    for i, text in texts:
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed)
    assert by_id["23"].kept and by_id["24"].base_failed and not by_id["24"].kept
    assert qr.judged(none_at_all).collect() == []
