from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomwork.llm import decontaminate, language_id, piece_codec, quality_qda
from loomwork.llm.batches import BATCH_CONF, BATCH_ROWS
from loomwork.plans.lineage import fresh_folder


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_each_stage_does_its_operators_work(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = []
    for k, (_, stage) in enumerate(cp.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == columns
            folder = fresh_folder(spark, "pipeline-test")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
        if k == 0:
            names, score = language_id.learn(before).predict([r.text for r in before.orderBy("doc_id").collect()])
            want = [i for i, n, s in zip(ids(before), names, score.tolist(), strict=True) if n != "und" and s >= cp.LEAST_LANGUAGE_SCORE]
        elif k == 1:
            found = before.select("doc_id", quality_qda.measured("text").alias("statistics"))
            model = quality_qda.learn(found, spark.read.parquet(f"{sf}/labels.parquet"))
            want = ids(found.where(quality_qda.scored(model, "statistics") >= quality_qda.THRESHOLD))
        elif k == 2:
            sets = {r.doc_id: shingles(r.text) for r in before.collect()}
            group = {i: i for i in sets}  # exact: all pairs, joined into components
            for a, b in combinations(sorted(sets), 2):
                if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    low, high = sorted((group[a], group[b]))
                    group = {i: low if g == high else g for i, g in group.items()}
            want = sorted(i for i, g in group.items() if i == g)
            assert len(want) < len(group)
        elif k == 3:
            leaked = set(ids(decontaminate.leaks(before, spark.read.parquet(f"{sf}/benchmark.parquet"))))
            want = [i for i in ids(before) if i not in leaked]
        else:
            want = ids(before)
            assert {r.doc_id: r.ids for r in docs.collect()} == {r.doc_id: r.ids for r in piece_codec.encode_documents(before).collect()}
        assert ids(docs) == want
        kept.append(len(want))
    assert kept == sorted(kept, reverse=True) and kept[-1] > 50


def test_run_is_the_stages(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() == out.select("doc_id").distinct().count() > 50


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    """A folder with empty labels and an empty benchmark."""
    folder = f"file://{tmp_path_factory.mktemp('bare')}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_nothing_learnt_keeps_all(spark, bare, odd):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert cp.language(spark, unlabelled, bare).count() == odd.count()
    assert cp.quality(spark, odd, bare).count() == odd.count()
    assert cp.decontamination(spark, odd, bare).count() == odd.count()


def test_clashing_columns_come_out_as_they_are(spark, sf, make):
    rows = [(k, f"the text of document {k} is about the thing that was said in the year {k}") for k in range(40)]
    docs = make(rows)
    for c in ("row", "p", "digest", "whole", "keeper", "_score", "_language", "doc", "statistics"):
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        for r in out.collect():
            assert r["row"] == "mine row" and r["_score"] == "mine _score" and r["statistics"] == "mine statistics" and r.score == "clash"


def test_odd_rows_and_empty_tables(spark, sf, odd, none_at_all):
    for k, (_, stage) in enumerate(cp.STAGES):
        assert stage(spark, none_at_all, sf).collect() == []
        out = stage(spark, odd, sf)
        assert out.count() <= odd.count()
        if k < 4:
            assert out.columns == odd.columns
    assert cp.encoding(spark, odd, sf).count() == odd.count()


def test_a_row_without_id_goes_alone(spark, bare, make):
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{bare}-2/benchmark.parquet")
    out = cp.decontamination(spark, make([(None, f"x {item} y"), (None, "clean text here"), (3, "more clean text"), (3, item)]), f"{bare}-2")
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("3", "more clean text"), ("None", "clean text here")]


def test_python_gets_few_rows_at_once(spark, sf, odd):
    """Batches of 10,000 whole texts stand in an executor's memory once in the JVM and once in Python, for each task."""
    before = spark.conf.get(BATCH_CONF)
    try:
        for stage in (cp.language, cp.quality, cp.encoding):
            for given, want in (("10000", str(BATCH_ROWS)), ("0", str(BATCH_ROWS)), ("7", "7")):
                spark.conf.set(BATCH_CONF, given)
                stage(spark, odd, sf)
                assert spark.conf.get(BATCH_CONF) == want
    finally:
        spark.conf.set(BATCH_CONF, before)
