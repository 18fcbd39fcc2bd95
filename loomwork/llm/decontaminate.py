"""Benchmark decontamination by SimHash windows of the items' sizes.

Texts and items become sequences of lower-cased words (runs of letters and digits) and these become
5-word shingles, compared by 64-bit hashes.  A window of an item's size is compared with the items of that size:

1. SimHash of the window's shingles, weighted by their number, against the items' fingerprints.  The fingerprint has six
   blocks; of two fingerprints within ``RADIUS`` bits one block differs in at most ``NEAR`` bits, so items are indexed under
   all values that near to each of their blocks, and windows ask for their own blocks.  This meets all fingerprints within the radius.
2. Exact weighted similarity of the shingles (sum of minima over sum of maxima) of the candidates.

No radius bounds the similarity: where two shingles stand in nearly equal numbers ("ping pong ping pong ..."), one more or less of
either tips half of all bits.  Windows that lie farther from the item that they were laid for than the radius are therefore compared
exactly as well, whatever their fingerprints.

Fingerprints of all windows of all sizes would be some ten thousand for each text.  So windows are laid by a count first.  A window
alike enough must hold one of the item's rarest shingles (those beyond the overlap that is needed, in the order of how often they
stand in the texts), which gives the pairs of texts and items to look at.  For each, how many shingles (with their numbers) a window
shares with the item is summed up over all its positions at once, wherever in the window they stand, and the best window is laid if the
count suffices.  Common shingles alone make no pair, and no window is lost, moved, swapped and repeated blocks included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.plans.lineage import cut, written

WORDS = 5
SIMILARITY = 0.8
BITS = 64
BLOCKS, NEAR = 6, 3
#: Bits within which fingerprints surely meet.  Random windows without repeats that are just 0.8 alike differ in 6 to 10 on average.
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Most rows (of fixed width, at most 40 bytes) of a side that is broadcast; larger sides are joined by shuffling.
MOST_BROADCAST = 1_000_000


def shingles(text: Column) -> tuple[Column, Column]:
    """(array of words' hashes, function of that column's name -> array of shingle hashes) of a text column."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w)), _rolled


def _rolled(words: str) -> Column:
    n = F.size(words)
    rolling = F.transform(F.slice(words, 1, F.greatest(n - (WORDS - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WORDS)]))
    return F.when(n >= WORDS, rolling).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>"))


def shingled(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``text_col`` replaced by ``s``, its shingles in order.

    A text of fewer than five words is one shingle; a text without words has none.
    """
    words, rolled = shingles(F.col(text_col))
    rest = [c for c in rows.columns if c != text_col]
    return rows.select(*rest, words.alias("w")).select(*rest, rolled("w").alias("s"))


def with_simhash(df: DataFrame, s: str = "s", to: str = "fp") -> DataFrame:
    """``df`` with the 64-bit SimHash of an array of hashes: a bit is 1 if set in over half of them.

    The bits are added up in lanes of a long, four of 16 bits or, for more hashes than these can count, two of 32.
    """

    def bits(lane: int) -> str:
        mask = sum(1 << (lane * k) for k in range(BITS // lane))
        lanes = f"transform(sequence(0, {lane - 1}), low -> aggregate({s}, 0L, (a, h) -> a + (shiftrightunsigned(h, low) & {mask}L)))"
        count = f"shiftrightunsigned(lanes[k % {lane}], cast(k div {lane} as int) * {lane}) & {(1 << lane) - 1}L"
        each = f"aggregate(sequence(0, {BITS - 1}), 0L, (a, k) -> a | if(({count}) * 2 > size({s}), shiftleft(1L, k), 0L))"
        # As the variable of an outer lambda the lanes are added up once; a column of their own would be
        # folded into the inner lambda and added up for every bit.
        return f"transform(array({lanes}), lanes -> {each})[0]"

    # The result is declared not null: a filter on nulls, which Spark would infer from a join and push down, would
    # compute the fingerprint once more.
    return df.withColumn(to, F.expr(f"coalesce(if(size({s}) < 32768, {bits(16)}, {bits(32)}), 0L)"))


def blocks(fp: Column) -> list[Column]:
    """The blocks of a fingerprint, each of 10 or 11 bits."""
    edges = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def asked(fp: Column) -> Column:
    """Keys of the blocks as they are."""
    return F.array(*[v * BLOCKS + k for k, v in enumerate(blocks(fp))])


def indexed(fp: Column) -> Column:
    """Keys of all values within ``NEAR`` bits of each block."""
    near = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << -(-BITS // BLOCKS)) - 1).cast("long")), lambda x: F.bit_count(x) <= NEAR)

    def keys(k: int, v: Column) -> Column:
        return F.transform(near, lambda x: v.bitwiseXOR(x) * BLOCKS + k)

    return F.flatten(F.array(*[keys(k, v) for k, v in enumerate(blocks(fp))]))


def _sized(df: DataFrame) -> DataFrame:
    """``df``, which is in files and has no arrays, as a side of a join."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, item_id, s, n)``; ``item`` stands for rows with the same id and text, ``n`` is 0 for those without words."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    rows = shingled(rows.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text"), "text")
    return rows.select("item", "item_id", "s", F.size("s").alias("n"))


def rarest(spots: DataFrame, placed: DataFrame) -> DataFrame:
    """``(item, h)``: each item's shingles that stand least often in ``placed``, as many as can't all be missing from a window alike enough.

    Of an item's ``n`` shingles a window shares ``ceil(SIMILARITY * n)`` at least, so it holds one of the first
    ``n - ceil(SIMILARITY * n) + 1`` in any order.
    """
    often = placed.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    ranked = spots.join(often, "h")  # a shingle that stands in no text is missing from all windows; it counts in ``before``
    missing = spots.join(often, "h", "left_anti").groupBy("item").agg(F.sum("c").alias("missing"))
    order = Window.partitionBy("item").orderBy("often", "h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(order), F.lit(0)) + F.coalesce("missing", F.lit(0))
    first = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1
    return ranked.join(missing, "item", "left").withColumn("before", before).where(F.col("before") < first).select("item", "h")


def best_windows(placed: DataFrame, spots: DataFrame) -> DataFrame:
    """``(key, item, n, start)``: for each text and item the first window that shares most with it, if that is enough.

    ``placed`` has ``(key, size, pos, h)``, the texts' shingles that stand in items, and ``spots`` ``(item, n, h, c)``, how often they stand
    in the items.  An occurrence counts for the windows that begin after the one ``c`` before it; these windows are a range, so
    the sums over all windows are running sums of the ranges' ends.
    """
    pairs = placed.join(_sized(written(rarest(spots, placed))), "h").select("key", "item").distinct()
    wanted = pairs.join(_sized(spots), "item")
    hits = placed.join(wanted, ["key", "h"]).groupBy("key", "item", "h").agg(F.sort_array(F.collect_set("pos")).alias("at"), F.first("size").alias("size"), F.first("n").alias("n"), F.first("c").alias("c"))
    # Ranges are made before they are exploded, so that no row carries the array.
    first = lambda pos, i: F.greatest(F.coalesce(F.get("at", i - F.col("c")) + 1, F.lit(0)), pos - F.col("n") + 1)
    each = hits.select("key", "item", "size", "n", F.inline(F.transform("at", lambda pos, i: F.struct(first(pos, i).alias("first"), pos.alias("pos")))))
    ranges = each.where(F.col("first") <= F.greatest(F.col("size") - F.col("n"), F.lit(0)))
    ends = F.array(F.struct(F.col("first").alias("start"), F.lit(1).alias("d")), F.struct((F.col("pos") + 1).alias("start"), F.lit(-1).alias("d")))
    steps = ranges.select("key", "item", "size", "n", F.inline(ends)).groupBy("key", "item", "size", "n", "start").agg(F.sum("d").alias("d"))
    shared = F.sum("d").over(Window.partitionBy("key", "item").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    counted = steps.select("key", "item", "size", "n", "start", shared.alias("shared"))
    enough = F.col("shared") * (1 + SIMILARITY) >= (F.col("n") + F.least("n", "size")) * SIMILARITY - 1e-9
    best = F.max(F.struct("shared", (-F.col("start")).alias("back"))).alias("b")
    return counted.where(enough).groupBy("key", "item", "n").agg(best).select("key", "item", "n", (-F.col("b.back")).alias("start"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity, start, size)``: a document's best window for each item it leaks.

    ``start`` and ``size`` count shingles; of equally similar windows the first of those that begin with a shingle of the
    item, or end with the text, is given.  A text shorter than the item is one window.  Null texts are
    empty; texts and items without words match nothing; those of fewer than five words match only whole
    texts with the same words.  Items and texts may be of any length.  Repeated rows give one row; a null ``doc_id`` or
    ``item_id`` is kept as it is.  Other columns are ignored; an empty table on either side gives an empty result.
    """
    # Cut before the filter, which would be pushed into the shingles and make them once for each word.
    items = cut(items_of(benchmark)).where("n > 0")
    spots = written(items.select("item", "n", F.explode("s").alias("h")).groupBy("item", "n", "h").agg(F.count(F.lit(1)).cast("int").alias("c")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))

    # An outer explode: for an inner one Spark infers a filter and pushes it below the projections, which
    # would compute the shingles twice.  Its row for a text without shingles has a null hash and joins nothing.
    placed = shingled(keyed.select("key", "text"), "text").select("key", F.size("s").alias("size"), F.posexplode_outer("s").alias("pos", "h"))
    held = written(placed.join(_sized(written(spots.select("h").distinct())), "h", "left_semi"))
    best = written(best_windows(held, spots))
    windows = written(best.select("key", "n", "start").distinct())

    hit = keyed.join(_sized(windows), "key").select("key", "doc_id", "text", "n", "start")
    laid = shingled(hit, "text").select("key", "doc_id", "n", "start", F.slice("s", F.col("start") + 1, F.col("n")).alias("s"))
    laid = laid.select("key", "doc_id", "n", "start", F.xxhash64("doc_id", "start", "s").alias("window"), "s").dropDuplicates(["doc_id", "n", "start", "window"])
    prints = cut(with_simhash(laid))
    marked = written(with_simhash(items).select("item", F.col("n").alias("item_n"), F.col("fp").alias("item_fp")))
    index = written(marked.select("item", "item_n", "item_fp", F.explode(indexed(F.col("item_fp"))).alias("near")))
    asking = prints.select("window", "n", "fp", F.explode(asked(F.col("fp"))).alias("block"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    close = (F.col("n") == F.col("item_n")) & (F.col("block") == F.col("near")) & (apart <= RADIUS)
    within = asking.join(_sized(index), close).select("window", "item")
    beyond = prints.select("key", "n", "start", "window", "fp").join(best, ["key", "n", "start"]).join(_sized(marked), "item").where(apart > RADIUS).select("window", "item")
    met = within.union(beyond).distinct()

    inside = prints.select("window", "doc_id", "start", F.size("s").alias("size"), "s").join(met, "window")
    counts = inside.select("window", "item", "doc_id", "start", "size", F.explode("s").alias("h")).groupBy("window", "item", "doc_id", "start", "size", "h").agg(F.count(F.lit(1)).alias("k"))
    both = counts.join(_sized(spots), ["item", "h"]).groupBy("window", "item", "n", "doc_id", "start", "size").agg(F.sum(F.least("k", "c")).alias("m"))
    found = both.select("item", "doc_id", "start", "size", (F.col("m") / (F.col("n") + F.col("size") - F.col("m"))).alias("similarity")).where(F.col("similarity") >= SIMILARITY - 1e-12)
    named = found.join(items.select("item", "item_id"), "item")
    best = F.max_by(F.struct("similarity", "start", "size"), F.struct("similarity", (-F.col("start")).alias("first"), "size"))
    return named.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", "b.start", "b.size")
