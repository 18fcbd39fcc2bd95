"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import chat_format, conversation_repair, decontaminate, language_id, license_scan, ngram_join, oracles, piece_codec, quality_qda, quality_rules, simhash_dedup, token_alignment, token_files, url_trust
from loomwork.plans.lineage import cut, fresh_folder
from loomwork.plans.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    url_trust.UrlRule("com/", allow=True),
    url_trust.UrlRule("example.com/en/", allow=False),
    url_trust.UrlRule("www.example.com/en/", allow=True),
    url_trust.UrlRule("net/es/", allow=False),
    url_trust.UrlRule("net/fr/", allow=False),
]


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judged(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    turns = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), said.alias("text")) for k, role in enumerate(("user", "assistant"))]
    more = spark.range(1).select(F.inline(F.array(*turns)))
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = chat_format.read_back(chat_format.expand(convs))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    return token_files.read_token_checksums(spark, folder)


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(remainder(4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    found = cut(docs.select("doc_id", quality_qda.measured("text").alias("statistics")))
    model = quality_qda.learn(found.where(remainder(5) != 0), table(spark, sf_dir, "labels"))
    score = found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), quality_qda.scored(model, "statistics").alias("score"))
    return score.withColumn("predicted", (F.col("score") >= quality_qda.THRESHOLD).cast("int"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoding_digests(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned_documents(table(spark, sf_dir, "documents"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def damaged(convs: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with one row in four damaged, by the checksum of its id and turn; nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(spaced("role"))
    copies = F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0))
    rows = convs.withColumn("kind", kind).where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.audited(damaged(convs)).withColumnRenamed("conv_id", "of")
    every = convs.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_trust": op1_url_trust,
        "op2_chat_format": op2_chat_format,
        "op3_decontamination": op3_decontamination,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_token_id_files": op5_token_id_files,
        "op6_language_id": op6_language_id,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_license_scan": op8_license_scan,
        "op9_quality_rules": op9_quality_rules,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_token_alignment": op11_token_alignment,
        "op12_ngram_jaccard": op12_ngram_jaccard,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators learn, hash or iterate in ways SQL can't express; their tests use brute force."""
    return oracles.oracle_sql()
