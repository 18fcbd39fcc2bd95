import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import language_id as li
from loomwork.llm import queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op6_language_id(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert held.score.between(0, 1).all()


def test_filter_counts_by_brute_force():
    texts = {"en": "the thing that the other one wanted", "de": "der die das und nicht mit einer sache", "fr": "le la les des une autre chose"}
    known = {k: np.unique(li.grams([t])[0]) for k, t in texts.items()}
    model = li.LanguageModel.build(known)
    asked = ["the other thing", "eine andere sache und", "des choses"]
    names, score = model.predict(asked)
    for text, name, s in zip(asked, names, score, strict=True):
        own = li.grams([text])[0]
        exact = {k: np.isin(own, g).mean() for k, g in known.items()}
        assert exact[name] == max(exact.values())
        assert abs(s - exact[name]) < 0.1


def test_grams_stay_inside_their_text():
    together, alone = li.grams(["abcd ef", "gh", ""]), [li.grams([t])[0] for t in ("abcd ef", "gh", "")]
    assert np.array_equal(together[0], np.concatenate(alone))
    assert li.grams(["A-b"])[0].tolist() == li.grams(["a  B!"])[0].tolist()


def test_odd_rows(odd, make, none_at_all):
    train = make([(1, "the one and the other thing")], "en").union(make([(2, "der eine und die andere")], "de"))
    model = li.learn(train)
    rows = {str(r.doc_id): r for r in li.identify(odd, model).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in ("0", "1", "2", "4"))
    assert rows["3"].lang_pred in ("de", "en") and "None" in rows
    assert li.identify(none_at_all, model).collect() == []
    empty = li.learn(none_at_all)
    assert {r.lang_pred for r in li.identify(odd, empty).collect()} == {"und"}
    unlabelled = li.learn(train.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.languages == ()


def test_more_languages_than_bits_of_a_word():
    known = {f"l{k:03d}": np.unique(li.grams([f"word{chr(97 + k % 26)}{chr(97 + k // 26)} thing"])[0]) for k in range(150)}
    model = li.LanguageModel.build(known)
    names, _ = model.predict([f"word{chr(97 + k % 26)}{chr(97 + k // 26)} thing" for k in range(150)])
    assert names == sorted(known)
