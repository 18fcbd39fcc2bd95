"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, which parts words.
BLANKS = " \t\n\x0b\x0c\r"

# Frequent function words, by which running text is known.
STOP_WORDS = ("the", "of", "and", "to", "in", "la", "de", "le", "les", "et", "que", "el", "en", "der", "die", "und", "das", "den")


@dataclass(frozen=True)
class Rule:
    """Fails where ``measure`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Checked for documents that pass the base rules.
RULES = (
    Rule("words", "n_words", least=50, most=100_000),
    Rule("word length", "mean_word_chars", least=2, most=12),
    Rule("symbols", "symbols_per_word", most=0.3),
    Rule("stop words", "stop_word_ratio", least=0.01),
    Rule("repeated lines", "dup_line_ratio", most=0.3),
    Rule("bullet lines", "bullet_line_ratio", most=0.9),
    Rule("ellipsis lines", "ellipsis_line_ratio", most=0.3),
)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def sorted_windows(grams: Column) -> Column:
    """The windows as (hash, position) in that order; empty if no hash is found twice."""
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def repeated_starts(placed: Column) -> Column:
    """Positions, ascending, of the windows that have an equal neighbour among ``sorted_windows``."""

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get(placed, k - 1)["h"], F.get(placed, k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(placed, twice), lambda x: x["i"]))


def covered_words(starts: Column) -> Column:
    """Words in 3-word windows at these ascending positions; a word in several windows counts once."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(i - a["at"], F.lit(3))).alias("n")),
        lambda a: a["n"],
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ...)`` with the counts and ratios that the rules refer to, one row for each row.

    Null and empty texts have zeros everywhere.  Lines are parted by line feeds only and count if they hold
    a word; words are runs of characters other than ASCII white space.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    step = base.select(
        "doc_id",
        "text",
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.split(F.trim("text", F.lit(BLANKS)), "[ \\t\\n\\x0B\\f\\r]+").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0).alias("lines"),
    ).withColumn("w", F.when(F.size("lines") > 0, F.col("w")).otherwise(F.array().cast("array<string>")))
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>"))
    step = step.select(
        "doc_id",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike("^[-*•]"))).alias("bullets"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("ellipses"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS))).alias("stops"),
        windows.alias("grams"),
    )
    step = step.withColumn("placed", sorted_windows(F.col("grams"))).withColumn("starts", repeated_starts(F.col("placed")))
    return step.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        covered_words(F.col("starts")).cast("long").alias("n_repeat_words"),
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        ratio(F.col("stops"), F.col("n_words")).alias("stop_word_ratio"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ratio(F.col("bullets"), F.col("n_lines")).alias("bullet_line_ratio"),
        ratio(F.col("ellipses"), F.col("n_lines")).alias("ellipsis_line_ratio"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that fail, as one array expression over the columns of ``measures``."""
    checks = []
    for rule in rules:
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (F.col(rule.measure) < rule.least)
        if rule.most is not None:
            bad = bad | (F.col(rule.measure) > rule.most)
        checks.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every row with ``base_failed``, ``failed`` (names of failing rules) and ``kept``.

    The base fails below 50 words or if more than half of the words lie in repeated 3-word windows.
    Repeated rows and null ids stay as they are; an empty table gives an empty result.
    """
    found = measures(docs, id_col, text_col)
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    found = found.withColumn("base_failed", base).withColumn("failed", compiled(rules))
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
