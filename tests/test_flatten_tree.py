from loomwork.plans import registry


def test_long_conversation_is_whole(spark, tmp_path):
    turns = [(7, k, "user", f"text {k}") for k in range(1, 1301)] + [(8, 1, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = registry.queries()["flatten_tree"](spark, str(tmp_path)).collect()
    assert sorted((r.payload_id, int(r.external_comment_id), r.body) for r in rows) == sorted((c, k, x) for c, k, _, x in turns)
