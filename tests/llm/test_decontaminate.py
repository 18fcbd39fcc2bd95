import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loomwork.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def brute(docs, items):
    """Best similarity of every window of an item's size, for each pair that reaches the threshold."""
    out = {}
    for i, text in docs:
        s = shingles(words(text))
        for j, item in items:
            t = shingles(words(item))
            if not s or not t:
                continue
            for at in range(max(len(s) - len(t), 0) + 1):
                a, b = Counter(s[at : at + len(t)]), Counter(t)
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + sum(b.values()) - both)
                if sim >= 0.8:
                    out[i, j] = max(out.get((i, j), 0), sim)
    return out


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("key", "s", "h", "n", "start", "fp", "block", "item_id", "windows", "item", "size", "pos", "c", "window"):
        d = d.withColumn(c, F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    return {(r.doc_id, r.item_id): r.similarity for r in dc.leaks(d, b).collect()}


def test_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([12, 20, 33, 60, 90])))) for j in range(12)]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        if i % 2:
            leak = words(rng.choice(items)[1])
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(leak))
                leak[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(3)
            at = rng.randrange(len(w))
            w[at:at] = leak
        docs.append((i, " ".join(w).replace("w1 ", "W1, ")))
    docs.append((900, items[0][1]))
    docs.append((901, " ".join(words(items[4][1])[1:])))
    want, got = brute(docs, items), found(spark, docs, items)
    assert len(want) > 15 and want.keys() == got.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_moved_swapped_and_repeated_blocks(spark):
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(900)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items, docs = [], []
    for j, n in enumerate((104, 64, 200, 90)):
        t = [f"i{j}x{k}" for k in range(n)]
        items.append((j, " ".join(t)))
        for at in (n // 2, n // 3, n // 4):
            docs.append(draw(200) + t[at:] + t[:at] + draw(200))
            docs.append(t[at:] + t[:at])
            docs.append(draw(30) + t[:at] + t[:at] + t + t[at:])
        third = n // 3
        docs.append(draw(9) + t[2 * third :] + t[third : 2 * third] + t[:third] + draw(50))
    items.append((9, " ".join(["again and again"] * 30)))
    docs += [draw(40) + ["again", "and", "again"] * k + draw(40) for k in (20, 29, 30, 31, 60)]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want, got = brute(docs, items), found(spark, docs, items)
    assert len(want) > 20 and want.keys() == got.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_balanced_repeats_and_permutations(spark):
    """Alternations tip half of all bits with one shingle; phrases in other orders and numbers; short items of few kinds of words."""
    rng = random.Random(31)
    items, docs = [], []
    for j, (x, y) in enumerate((("ping", "pong"), ("yes", "no"), ("left", "right"), ("tick", "tock"), ("on", "off"), ("in", "out"))):
        items.append((j, " ".join([x, y] * 7 + [x])))
        docs.append(" ".join([y, x] * 7 + [y]))
        docs.append(" ".join(["so"] * 3 + [y, x] * 9 + ["then"] * 4))
    phrases = [[f"p{k}", f"q{k}", f"r{k}", "and"] for k in range(4)]
    for j in range(10, 30):
        kinds = rng.sample(phrases, rng.choice([2, 2, 3]))
        words_of = lambda n: [w for _ in range(n) for w in rng.choice(kinds)]  # noqa: B023, E731
        items.append((j, " ".join(words_of(rng.randrange(3, 12)))))
        docs += [" ".join(words_of(rng.randrange(3, 14))) for _ in range(5)]
        w = items[-1][1].split()
        docs.append(" ".join(w[4:] + w[:4]))
    docs += [" ".join(rng.choice("ab") for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    items += [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(6, 16)))) for k in range(40, 60)]
    docs = list(enumerate(docs))
    want, got = brute(docs, items), found(spark, docs, items)
    assert all((2 * j, j) in want for j in range(6)) and len(want) > 100
    assert want.keys() == got.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_long_items_and_long_repeats(spark):
    rng = random.Random(22)
    long = [f"w{rng.randrange(50000)}" for _ in range(40000)]
    items = [(1, " ".join(long)), (2, "ha " * 4000)]
    docs = [(1, " ".join(["before", *long, "after"])), (2, " ".join(long[20000:] + long[:20000])), (3, "ha " * 40000), (4, " ".join(long[:30000]))]
    got = found(spark, docs, items)
    assert got.keys() == {(1, 1), (2, 1), (3, 2)} and got[1, 1] == got[3, 2] == 1.0 and got[2, 1] > 0.999


def test_simhash_by_brute_force(spark):
    rng = random.Random(12)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 7, 300, 33000)]
    for r in dc.with_simhash(spark.createDataFrame(rows, "s array<long>")).collect():
        bits = [sum((h >> k) & 1 for h in r.s) * 2 > len(r.s) for k in range(64)]
        assert r.fp % (1 << 64) == sum(1 << k for k, b in enumerate(bits) if b)


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, None), (2, ""), (3, "short one"), (None, "x " + item), (4, item), (4, item), (5, (item + " ") * 400), (6, "ha " * 3000)]
    items = [(10, item), (11, None), (12, ""), (13, "Short, one!"), (None, "ha " * 30), (14, item)]
    want = {(None, 10), (None, 14), (4, 10), (4, 14), (5, 10), (5, 14), (3, 13), (6, None)}
    assert found(spark, docs, items).keys() == want
    assert found(spark, docs, [(1, None)]) == {} and found(spark, [(1, None)], items) == {}
