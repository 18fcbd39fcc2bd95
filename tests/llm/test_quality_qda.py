import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import quality_qda as qq
from loomwork.llm import queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op7_quality_classifier(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id")
    held = found.where("held_out").toPandas()
    assert (held.quality == held.predicted).mean() > 0.95
    assert found.where("score < 0 OR score > 1").isEmpty()


def test_score_is_the_bayes_posterior():
    rng = np.random.default_rng(5)
    width = len(qq.STATISTICS)
    sets = {0: rng.normal(0, 1, (400, width)), 1: rng.normal(0.5, 2, (700, width))}
    model = qq.QualityModel.build({c: (float(len(x)), x.sum(0), x.T @ x) for c, x in sets.items()})
    every = np.concatenate(list(sets.values()))
    z = {c: (x - every.mean(0)) / every.std(0) for c, x in sets.items()}
    raw = {c: np.cov(x.T, bias=True) for c, x in z.items()}
    pooled = sum(len(z[c]) * raw[c] for c in z) / len(every)
    asked = rng.normal(0, 1.5, (50, width))
    log = []
    for c in (0, 1):
        cov = (1 - qq.TO_POOLED) * raw[c] + qq.TO_POOLED * pooled
        cov = (1 - qq.TO_IDENTITY) * cov + qq.TO_IDENTITY * np.trace(cov) / width * np.eye(width)
        d = (asked - every.mean(0)) / every.std(0) - z[c].mean(0)
        log.append(np.log(len(z[c])) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(asked), 1 / (1 + np.exp(log[0] - log[1])))


def test_statistics_are_finite():
    for text in (None, "", " ", "A.", "x" * 100000, "***", "\n\n", "é漢😀\x00"):
        assert np.isfinite(qq.statistics(text)).all()


def test_odd_rows(odd, none_at_all, spark):
    found = odd.select("doc_id", qq.measured("text").alias("statistics"))
    labels = spark.createDataFrame([(1, 0), (5, 1), (8, 0), (7, 1), (9, None), (77, 1)], "doc_id long, quality int")
    model = qq.learn(found, labels)
    rows = found.select("doc_id", qq.scored(model, "statistics").alias("score")).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert none_at_all.select(qq.scored(model, qq.measured("text"))).collect() == []
    one = qq.learn(found, labels.where("quality = 1"))
    assert {r[0] for r in found.select(qq.scored(one, "statistics")).collect()} == {1.0}
    none = qq.learn(found, labels.where(F.lit(False)))
    assert {r[0] for r in found.select(qq.scored(none, "statistics")).collect()} == {0.0}
