import random
import re
from collections import defaultdict

import numpy as np
import pytest

from loomwork.llm import ngram_join, queries

from .conftest import ODD


def slow_sets(rows, words=5):
    out = []
    for i, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        out.append((i, {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    return out


def brute(rows):
    """Multiset of (doc_id, n_shingles, component_id), by comparing all pairs that share a shingle."""
    sets = slow_sets(rows)
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(k)
    met = {(a, b) for ks in holders.values() for i, b in enumerate(ks) for a in ks[:i]}
    for a, b in met:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= 80 * len(x | y):
            parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, words, times):
    w = list(words)
    for _ in range(times):
        at = rng.randrange(len(w))
        w[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
    return w


def corpus(seed):
    """Copies near the threshold, blocks added and cut off, a common passage, permutations, subsets and repeats."""
    rng = random.Random(seed)
    draw = lambda n, v=3000: [f"w{rng.randrange(v)}" for _ in range(n)]
    passage, docs = draw(30), []
    for _ in range(12):
        base = draw(rng.choice([6, 9, 20, 60, 150, 400]))
        for _ in range(8):
            docs.append(edited(rng, base, rng.randrange(0, 1 + len(base) // 25)))
        docs.append(base + draw(len(base) // 5))
        docs.append(base[: -len(base) // 6])
        docs.append(base[len(base) // 2 :] + base[: len(base) // 2])
        docs.append([w.upper() for w in base])
        docs.append(base + base)
    docs += [draw(rng.randrange(5, 60)) + passage + draw(rng.randrange(0, 40)) for _ in range(40)]
    docs += [passage + draw(rng.randrange(0, 9)) for _ in range(25)]
    docs += [draw(rng.randrange(1, 12), 3) for _ in range(40)]
    docs += [draw(4, 2) for _ in range(20)]
    rng.shuffle(docs)
    return [(k, " ".join(d)) for k, d in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert sum(c != i for i, _, c in want) > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ngram_join.joined(docs)) == want


def test_without_broadcasts_and_with_all_ngrams_rare(spark, monkeypatch):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    monkeypatch.setattr(ngram_join, "MOST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "MOST_SET_BYTES", 0)
    assert got(ngram_join.joined(docs)) == want
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 0)
    assert got(ngram_join.joined(docs)) == want


def test_a_large_group_of_near_copies(spark):
    """1,200 near copies with edits of their own are one component, and no step writes out their pairs."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(edited(rng, base, rng.randrange(5)))) for k in range(1200)] + [(5000 + k, " ".join(base)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = ngram_join.ngram_sets(docs)
    star = ngram_join.written(ngram_join.star_pairs(ngram_join.prefix_index(sets)))
    assert star.count() < 20 * len(rows)
    # Four edits leave at least 276 of 296 shingles, so all are linked with the text without edits.
    assert {(i, c) for i, _, c in got(ngram_join.joined(docs))} == {(i, 0) for i, _ in rows}


def test_filters_keep_every_pair_at_the_threshold(spark):
    """Sets of all sizes that are just alike, equal in size and not, sharing their first, last or scattered n-grams."""
    rng = random.Random(4)
    rows = []
    for n in (1, 2, 3, 4, 5, 9, 10, 18, 45, 90, 360):
        for m in {n, -(-n * 4 // 5), n * 5 // 4}:
            need = -(-4 * (n + m) // 9)
            for shared in (need, need - 1):
                if 0 < shared <= min(n, m):
                    both = [f"{rng.random()}" for _ in range(shared)]
                    for size in (n, m):
                        rows.append(both + [f"{rng.random()}" for _ in range(size - shared)])
    rows = [(k, " ".join(rng.sample(r, len(r)))) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in ngram_join.joined(docs, words=1).select("doc_id", "component_id").collect()}
    sets = slow_sets(rows, 1)
    linked = {b for a, (_, x) in enumerate(sets) for b, (_, y) in enumerate(sets[:a]) if 100 * len(x & y) >= 80 * len(x | y) for b in (a,)}
    assert {i for i, c in found if c != i} == linked and len(linked) > 10


def test_sets_and_parities():
    hashes = ngram_join.WordHashes()
    a = ngram_join.ngram_set(b"One two  three\tFOUR five six", hashes)
    assert len(a) == 2 and a.tolist() == ngram_join.ngram_set("one two three four five six".encode(), hashes).tolist()
    assert len(ngram_join.ngram_set(b"a b", hashes)) == 1 and len(ngram_join.ngram_set(b" \n", hashes)) == 0
    x, y = np.arange(1000) * 977, np.arange(40, 1010) * 977
    apart = sum(int(v).bit_count() for v in (ngram_join.parities(x) ^ ngram_join.parities(y)).view(np.uint64))
    assert apart <= 50


def test_odd_rows(spark, odd, none_at_all):
    assert got(ngram_join.joined(odd)) == brute(ODD)
    assert ngram_join.joined(none_at_all).count() == 0


def test_query_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert got(queries.op12_ngram_jaccard(spark, sf)) == brute(rows)


def test_tables_of_many_rows_are_not_broadcast(spark):
    hinted = lambda n: "broadcast" in ngram_join.sized(spark.range(n))._jdf.queryExecution().logical().toString()
    assert hinted(1000) and not hinted(ngram_join.MOST_ROWS + 1) and not hinted(150_000)


def test_whole_sets_are_not_kept(spark):
    """The table of sets holds prefixes, a fifth of the n-grams; whole sets are made for the ends of pairs only, copies once."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(204)) for _ in range(30)] + ["a b", "", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *texts])], "doc_id long, text string").repartition(3)
    sets = ngram_join.ngram_sets(docs)
    held = [max([len(v) for v in r if isinstance(v, list)]) for r in sets.where("n = 200").collect()]
    assert len(held) == 60 and max(held) == 200 - 160 + 1
    a, b = sets.where("n = 200").selectExpr("min(node)", "max(node)").first()
    whole = ngram_join.whole_sets(spark.createDataFrame([(a, b)], "a long, b long"), sets, ngram_join.texts_of(docs))
    want = {tuple(ngram_join.ngram_set(t.encode(), ngram_join.WordHashes()).tolist()) for t in texts[:30]}
    found = {r.node: tuple(r.s) for r in whole.collect()}
    assert found.keys() == {a, b} and whole.count() == 2 and set(found.values()) < want


def test_sets_of_many_texts_at_once():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("aBcd") for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 50]))).encode() for _ in range(300)]
    for some in (texts, [], [b""], [b"a b", b""]):
        values, n = ngram_join.sets_of(some, ngram_join.WordHashes())
        want = [ngram_join.ngram_set(t, ngram_join.WordHashes()).tolist() for t in some]
        assert n.tolist() == [len(w) for w in want] and values.tolist() == sum(want, [])


def test_few_rows_travel_to_python_at_once(spark, monkeypatch):
    seen, write = [], ngram_join.written
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(ngram_join, "written", lambda df, name="table": seen.append((name, int(spark.conf.get(key)))) or write(df, name))
    ngram_join.ngram_sets(spark.createDataFrame([(1, "one text")], "doc_id long, text string"))
    assert {name for name, _ in seen} == {"frequent", "sets"} and max(rows for _, rows in seen) <= 1000
    assert spark.conf.get(key) == before
