import random

from pyspark.sql import functions as F

from loomwork.llm import chat_format as cf


def convs(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("t", "turns", "example", "formatted", "loss", "pieces", "k"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_escape_is_undone_and_leaves_no_control(spark):
    rng = random.Random(9)
    parts = [*cf.CONTROL, "<", "[", "\\", "\\\\", "<\\s>", "[\\/INST]", "x", "\n", "%", "$1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cf.escaped(F.col("t")).alias("e"))
    assert df.where(cf.unescaped(F.col("e")) != F.col("t")).isEmpty()
    for c in cf.CONTROL:
        assert df.where(F.contains("e", F.lit(c))).isEmpty()


def test_every_reply_is_one_example(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (1, 2, "user", "ä"), (1, 3, "assistant", "bye 😀"), (1, 4, "user", "?")]
    found = cf.expand(convs(spark, rows)).orderBy("example").collect()
    assert [f.example for f in found] == [0, 1, 2]
    first, second, rest = (f.formatted for f in found)
    assert second.startswith(first) and rest.startswith(second) and said not in rest
    assert second[found[1].loss_start : found[1].loss_end] == "bye 😀"
    assert first[found[0].loss_start : found[0].loss_end] == "<\\/s>[\\INST] ok [\\/INST]"
    assert found[2].loss_start is None and found[2].loss_end is None
    back = cf.read_back(cf.expand(convs(spark, rows))).first()
    assert [(t.role, t.text) for t in back.turns] == [(r[2], r[3]) for r in rows]
    assert back.loss_text == said + "bye 😀" and back.formatted_chars == sum(map(len, (first, second, rest)))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (None, 0, "assistant", ""), (2, 0, "a\nb%", "x"), (2, 0, "a\nb%", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (4, 0, "user", "w" * 100000)]
    back = {r.conv_id: r for r in cf.read_back(cf.expand(convs(spark, rows))).collect()}
    as_pairs = lambda r: [(t.role, t.text) for t in r.turns]
    assert as_pairs(back[1]) == [("", "")] and as_pairs(back[None]) == [("assistant", "")]
    assert as_pairs(back[2]) == [("a\nb%", "x")] * 2 and back[3].loss_text == "ab" and back[4].loss_text == ""
    assert cf.read_back(cf.expand(convs(spark, rows).where("turn > 9"))).collect() == []
