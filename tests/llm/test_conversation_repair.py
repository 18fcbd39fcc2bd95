import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork.llm import conversation_repair as cr
from loomwork.llm import oracles, queries

COLUMNS = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256".split(", ")


def slow(rows):
    """(cost, initials, repaired rows) by keeping whole strings: ``rows`` are (role, text, must_go, truncated)."""
    best = {"": (0, "", ())}  # by the last role's initial

    def put(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def inserts(table):
        out = dict(table)
        for _ in range(4):
            for state, (c, p, x) in list(out.items()):
                role = "assistant" if state == "u" else "user"
                put(out, role[0], (c + 5, p + "I", (*x, (role, ""))))
        return out

    for role, text, must_go, truncated in rows:
        after = {}
        for state, (c, p, x) in inserts(best).items():
            put(after, state, (c + 2, p + "D", x))
            if must_go:
                continue
            more = 5 if truncated else 0
            due = "assistant" if state == "u" else "user"
            put(after, due[0], (c + 1 + more, p + "R", (*x, (due, text))))
            if role[:1] == due[0] or (role[:1] == "s" and state == ""):
                put(after, role[:1], (c + more, p + "K", (*x, (role, text))))
        best = after
    return min(v for k, v in inserts(best).items() if k in ("", "a"))


def fast(rows):
    decoder, edits = cr.Repairer(), []
    for row in rows:
        edits += decoder.feed(*row)
    cost, rest = decoder.finish()
    edits += rest
    return (cost, "".join(e for e, _ in edits), tuple(s for _, s in edits if s)), decoder


def test_decoder_equals_whole_strings():
    rng = random.Random(5)
    for n in range(3000):
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["system", "tool", ""], ["user"], ["user", "assistant", "s", "u", "a"]])
        odds = rng.choice([(0.1, 0.1), (0.6, 0.2), (0.2, 0.7), (0, 0)])
        rows = [(rng.choice(roles), f"t{k}", rng.random() < odds[0], rng.random() < odds[1]) for k in range(rng.randrange(0, 14 if n % 10 else 80))]
        rows = [(r, t, d, b and not d) for r, t, d, b in rows]
        got, decoder = fast(rows)
        assert got == slow(rows), rows
        assert decoder.nodes <= decoder.most_nodes


def test_memory_follows_what_is_undecided():
    """A long conversation holds a few nodes; long undecided ends (rows that fit either way, runs of blanks) are compared whole."""
    rows = [(("user", "assistant")[k % 2], f"t{k}", k % 97 == 5, k % 13 == 3 and k % 97 != 5) for k in range(60_000)]
    decoder = cr.Repairer()
    edits = [e for row in rows for e in decoder.feed(*row)]
    assert decoder.most_nodes < 60 and len(edits) > 59_900
    blanks = [("user", "first", False, False)] + [("user", "", True, False)] * 50_000
    got, decoder = fast(blanks)
    assert decoder.most_nodes < 20 and got == (2 * 50_001, "D" * 50_001, ())
    neutral = [("tool", f"t{k}", False, False) for k in range(301)]
    assert fast(neutral)[0] == slow(neutral)


def described(rows):
    """The columns of ``audited`` for one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
    seen, out, faults = set(), [], [0, 0, 0]
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        cut = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        seen.add((role, text))
        kind = 0 if blank else 1 if again else 2 if cut else None
        if kind is not None:
            faults[kind] += 1
        out.append((role, text, kind in (0, 1), kind == 2))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, left = slow(out)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, digest), [(r, t) for r, t in left]


def test_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello. "),
        (2, None, "user", "No turn."), (2, None, None, None), (2, 3, "assistant", "\t\n"), (2, 9, "assistant", "Fine, thanks"),
        (3, 5, "assistant", "Twice."), (3, 5, "assistant", "Twice."), (3, 7, "assistant", "Twice."), (3, 6, "user", "?"),
        (None, 1, "user", "Whose is this?"), (None, 2, "user", "Mine."),
        (4, None, None, None),
        (5, 1, "", "no role."), (5, 1, "user", "same turn."), (5, 1, "tool", "same turn."),
        (6, 1, "user", "x" * 300_000 + "."), (6, 2, "assistant", "漢字! "),
        *[(7, k, ("user", "assistant")[k % 2], f"Turn {k // 3}.") for k in range(400)],
    ]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("of", "digest", "seen", "at", "first", "k"):
        convs = convs.withColumn(c, F.lit("clash"))
    ids = {r[0] for r in rows}
    want = {i: described([r[1:] for r in rows if r[0] == i]) for i in ids}
    got = {r.conv_id: tuple(r)[1:] for r in cr.audited(convs).select(*COLUMNS).collect()}
    assert got == {i: w for i, (w, _) in want.items()}
    left = {}
    for r in cr.repaired(convs).orderBy("place").collect():
        left.setdefault(r.conv_id, []).append((r.role, r.text))
    assert left == {i: x for i, (_, x) in want.items() if x}
    assert cr.audited(convs.where("conv_id > 99")).isEmpty() and cr.repaired(convs.where("conv_id > 99")).isEmpty()


def test_damage_and_query_on_nulls(spark, tmp_path):
    rows = [(i, t, r, x) for i in (1, 2, None) for t in (None, 0, 1, 2, 3, 4, 5) for r, x in (("user", "So?"), ("assistant", None), (None, "Yes. No"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.oracle_sql()['op13_conversation_repair']})").fetchall()
    got = queries.op13_conversation_repair(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


@pytest.mark.parametrize("name", ["op13_conversation_repair"])
def test_query_by_brute_force(spark, sf, name):
    rows = {}
    for r in queries.damaged(queries.table(spark, sf, "conversations")).collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS[1:]) for r in queries.queries()[name](spark, sf).collect()}
    ids = {r.conv_id for r in queries.table(spark, sf, "conversations").collect()}
    assert got.keys() == ids
    for i in ids:
        assert got[i] == described(rows.get(i, []))[0]
