import random

import numpy as np
import xxhash

from loomwork.llm import simhash_dedup as sd


def slow_fingerprint(text, words=4):
    tokens = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(len(tokens) - words + 1, 1))] if tokens else []
    out = 0
    for bit in range(64):
        if shingles and sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) * 2 > len(shingles):
            out |= 1 << bit
    return out


def components(values, radius):
    left, out = set(values), {}
    while left:
        group, edge = set(), [min(left)]
        while edge:
            x = edge.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= radius}
            left -= near
            group |= near
            edge += near
        for x in group:
            out[x] = group
    return out


def test_fingerprint_is_the_slow_one():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60):
        text = " \t".join(rng.choice(["Aa", "b", "ÄÖ", "cc", "D"]) for _ in range(n))
        assert sd.fingerprint(text.encode()) == slow_fingerprint(text)


def test_matches_sparks_hash(spark):
    row = spark.sql("SELECT xxhash64('a b c d') AS h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def signed(x):
    return int(np.uint64(x).astype(np.int64))


def test_linked_components_are_exact(spark):
    rng = random.Random(7)
    values = {0, (1 << 64) - 1}
    for _ in range(6):  # dense balls, chains and strangers
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for bit in rng.sample(range(64), rng.randrange(0, 4)):
                x ^= 1 << bit
            values.add(x)
    x = rng.getrandbits(64)
    for k in range(0, 64, 4):
        x ^= 0b1111 << k
        values.add(x)
    values |= {rng.getrandbits(64) for _ in range(300)}
    for radius in (2, 4, 5):
        found = {r.fp: r.component for r in sd.linked_components(spark.createDataFrame([(signed(v),) for v in values], "fp long"), radius).collect()}
        for value, group in components(values, radius).items():
            want = min(map(signed, group))
            assert found.get(signed(value), signed(value)) == want, radius


def test_every_row_has_its_component(odd, spark):
    rows = sd.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_fp = {}
    for r in rows:
        by_fp.setdefault(r.fp, set()).add(r.component_id)
    assert all(len(x) == 1 for x in by_fp.values())
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert [r.component_id for r in rows if r.doc_id == 5] == [5, 5]
    want = {i: slow_fingerprint(t) for i, t in ((5, "one two three four five six seven"), (3, "A."))}
    assert all(r.fp == signed(want[r.doc_id]) for r in rows if r.doc_id in want)


def test_empty_table(none_at_all):
    assert sd.near_duplicates(none_at_all).collect() == []
