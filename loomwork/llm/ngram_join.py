"""Jaccard self-join on word n-grams: rare-first prefixes with length, positional and suffix filters, each pair verified once.

A text stands for its set of distinct n-grams; texts with the same set are one node.  Sets are ordered rare n-grams first: those
that hardly repeat anywhere by their hashes, then frequent ones by how often they stand in all sets.  Two sets that are
``similarity`` alike share one of the first ``n - ceil(similarity * n) + 1`` n-grams of each, so only these are indexed.

1. In each bucket (the sets with one n-gram in their prefix) all members are paired with the bucket's lead, that with the fewest
   rarer n-grams: in a large group of near copies, one with few edits of its own.  What is verified is joined into components.
2. What is left are pairs of members of different components of a bucket.  Members of a bucket's largest component don't meet one
   another.

A pair must pass four filters before its sets are compared.  *Length*: the smaller set has at least ``similarity`` times the larger
one's n-grams.  *Position*: at every shared n-gram, what stands up to it and after it in both orders suffices for the overlap.
*Count*: all shared n-grams of the prefixes and all that can stand behind them suffice (in step 2, a pair is met where its
first shared n-gram can stand).  *Suffix*: the parities of 512 classes of
n-grams, which differ in no more places than the sets have n-grams apart, leave the overlap possible.

No step writes out the pairs within a group of similar sets, and none drops a pair that could be alike, so components are exact up to
clashes of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm.batches import slices, small_batches
from loomwork.operators.components import connected_components
from loomwork.plans.lineage import cut, discard, written
from loomwork.plans.shipping import ship

WORDS, SIMILARITY = 5, 0.8
SEED = 42
#: Longs of a set's parities, each of 64 classes.
PARITIES = 8
#: Hashes that are counted in one run, and how often an n-gram must repeat, over all runs, to be a frequent one.
COUNT_RUN, FREQUENT = 1 << 21, 4
#: Most frequent n-grams whose order travels to the workers; where there are more, the less frequent ones count as rare.
MOST_FREQUENT = 1_000_000
#: Rows of numbers (at most 40 bytes each), and bytes of sets, that are broadcast, which the driver builds; more are joined by shuffling.
MOST_ROWS, MOST_SET_BYTES = 100_000, 1 << 20
#: Times as many nodes are broadcast to whole sets, which are large to shuffle.
WHOLE_SETS = 10
#: Rounds in which each component tries its likeliest pair before all open ones are tried.
ROUNDS = 2
#: Words whose hashes a worker keeps; beyond it the memory starts afresh, which costs time only.
REMEMBERED = 1 << 18
#: Bytes of text whose n-grams are made at once, unless a single text is longer.
RUN_BYTES = 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Word -> 64-bit hash, kept for repeated words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return value


def ngram_set(text: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct n-grams: A-Z lower-cased, words parted by ASCII white space.

    Fewer words are one n-gram; without words the set is empty.
    """
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    count = len(tokens) - size + 1
    rolled = np.full(count, size, np.uint64)
    for k in range(size):
        rolled = (rolled ^ each[k : k + count]) * _M1
        rolled ^= rolled >> np.uint64(32)
    rolled *= _M2
    rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled.view(np.int64))


def parities(values: np.ndarray) -> np.ndarray:
    """For each class of hashes whether an odd number of ``values`` is in it, as ``PARITIES`` longs."""
    classes = values.view(np.uint64) & np.uint64(64 * PARITIES - 1)
    odd = np.bincount(classes.astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def parities_of(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``parities`` of sets that stand one behind the other in ``values``, a row each; ``n`` are their sizes."""
    stops = np.cumsum(n)
    return np.array([parities(values[b - k : b]) for b, k in zip(stops.tolist(), n.tolist(), strict=True)]).reshape(len(n), PARITIES)


def sets_of(texts: list[bytes], hashes: WordHashes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``ngram_set`` of each text, one behind the other, and their sizes; all texts are hashed at once."""
    tokens = [t.lower().split() for t in texts]
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    each = np.fromiter(map(hashes.__getitem__, chain.from_iterable(tokens)), np.uint64, length.sum())
    rolled = np.full(max(len(each) - words + 1, 0), words, np.uint64)
    for k in range(words):
        rolled ^= each[k : k + len(rolled)]
        rolled *= _M1
        rolled ^= rolled >> np.uint64(32)
    rolled *= _M2
    rolled ^= rolled >> np.uint64(29)
    # Only windows within one text; a text of fewer words has one n-gram.
    count = np.where(length < words, np.minimum(length, 1), length - words + 1)
    opens = np.cumsum(count) - count
    at = np.arange(count.sum()) + np.repeat(np.cumsum(length) - length - opens, count)
    values = rolled.view(np.int64)[np.minimum(at, len(rolled) - 1)] if len(rolled) else np.zeros(len(at), np.int64)
    for k in np.flatnonzero((length > 0) & (length < words)):
        values[opens[k]] = ngram_set(texts[k], hashes, words)[0]
    for start, stop in zip(opens.tolist(), (opens + count).tolist(), strict=True):
        values[start:stop].sort()
    fresh = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
    fresh[opens[count > 0]] = True
    return values[fresh], np.bincount(np.repeat(np.arange(len(count)), count)[fresh], minlength=len(count))


def _distinct(part: pa.Array) -> tuple[list[bytes], list[int]]:
    """The different texts of ``part`` (null: empty), and the place of each row's text among them."""
    place: dict[bytes, int] = {}
    of = [place.setdefault(t or b"", len(place)) for t in part.cast(pa.binary()).to_pylist()]
    return list(place), of


def texts_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(_text, key)``: texts, and the hash by which those of few sets are found again."""
    text = F.col(text_col).cast("string")
    return docs.select(text.alias("_text"), F.xxhash64(text).alias("key"))


def ngram_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, keep: tuple[str, ...] = (), similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, *keep, key, node, n, rare, head, x_0 ..)`` of every row, written to the shared folder.

    ``node`` is the set's hash (null for an empty set), ``n`` its size, ``rare`` how many of its n-grams are no frequent ones, ``head`` the
    hashes of its prefix in order and ``x_k`` its parities.  Of copies that one run of rows holds, only the first carries ``head``.  Whole
    sets are not kept: those that are compared are made again of their texts, which ``key`` finds.  ``keep`` names further columns that stay.
    """
    ship(docs.sparkSession)
    frequent = frequent_ngrams(texts_of(docs, text_col).select("_text"), words)
    by_hash = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (known, rank) = WordHashes(), sent.value
        for batch in batches:
            for start, part in slices(batch.column(0), RUN_BYTES):
                texts, of = _distinct(part)
                values, n = sets_of(texts, hashes, words)
                stops = np.cumsum(n)
                nodes = [xxhash.xxh3_64_intdigest(values[b - k : b].tobytes(), SEED) if k else None for b, k in zip(stops.tolist(), n.tolist(), strict=True)]
                signed = [v - (1 << 64) if v is not None and v >= 1 << 63 else v for v in nodes]
                heads, sizes, rare = prefixes(values, n, known, rank, similarity)
                ends = np.cumsum(sizes)
                seen, held = set(), []
                for k in of:
                    held.append(heads[ends[k] - sizes[k] : ends[k]] if nodes[k] not in seen else heads[:0])
                    seen.add(nodes[k])
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*held, heads[:0]])))
                odd = parities_of(values, n)[of]
                columns = [pa.array([signed[k] for k in of], pa.int64()), pa.array(n[of].astype(np.int32)), pa.array(rare[of].astype(np.int32)), lists]
                rest = [c.slice(start, len(part)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, *columns, *[pa.array(odd[:, k]) for k in range(PARITIES)]], names=[*names, "node", "n", "rare", "head", *[f"x_{k}" for k in range(PARITIES)]])

    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("_text"), F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep], F.xxhash64(text).alias("key"))
    names = rows.columns[1:]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    schema = [kinds, "node long, n int, rare int, head array<long>", *[f"x_{k} long" for k in range(PARITIES)]]
    with small_batches(docs.sparkSession):
        found = written(rows.mapInArrow(run, ", ".join(schema)), "sets")
    sent.unpersist()
    return found


def frequent_ngrams(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """Hashes of n-grams that stand in many sets, less frequent ones first.

    All sets are counted, in runs of ``COUNT_RUN`` hashes; what stands in a run once only is not handed on, so counts are those of
    repeated n-grams.  They decide in which order n-grams are looked at, and any order gives the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            values = np.concatenate(held)
            held.clear()
            values.sort()
            again = np.concatenate([[False], values[1:] == values[:-1], [False]])
            first, last = np.flatnonzero(~again[:-1] & again[1:]), np.flatnonzero(again[:-1] & ~again[1:])
            yield pa.RecordBatch.from_arrays([pa.array(values[first]), pa.array(last - first + 1)], names=["h", "c"])

        for batch in batches:
            for _, part in slices(batch.column(0), RUN_BYTES):
                held.append(sets_of(_distinct(part)[0], hashes, words)[0])
                if sum(map(len, held)) >= COUNT_RUN:
                    yield from counted()
        if held:
            yield from counted()

    with small_batches(texts.sparkSession):
        counts = written(texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT), "frequent")
    least = FREQUENT
    while counts.where(F.col("c") >= least).count() > MOST_FREQUENT:
        least *= 2
    found = counts.where(F.col("c") >= least).toArrow()
    discard(counts)
    h, c = found.column("h").to_numpy(), found.column("c").to_numpy()
    return h[np.lexsort((h, c))]


def prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    return n - np.ceil(n * similarity - 1e-6).astype(np.int64) + 1


def prefixes(values: np.ndarray, n: np.ndarray, known: np.ndarray, rank: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes of sets, in order and one behind the other, their sizes, and how many n-grams of each set are rare.

    ``values`` are the sets' sorted hashes and ``n`` their sizes; ``known`` are the frequent n-grams with their ``rank``.
    """
    of = np.repeat(np.arange(len(n)), n)
    at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
    hot = known[at] == values if len(known) else np.zeros(len(values), bool)
    # Rare ones are in the order of their hashes already; frequent ones follow.
    early, late = np.flatnonzero(~hot), np.flatnonzero(hot)
    late = late[np.lexsort((rank[at[late]], of[late]))]
    n_rare, opens = np.bincount(of[early], minlength=len(n)), np.cumsum(n) - n
    n_late = n - n_rare
    ordered = np.empty_like(values)
    ordered[np.arange(len(early)) + (opens - np.cumsum(n_rare) + n_rare)[of[early]]] = values[early]
    ordered[np.arange(len(late)) + (opens + n_rare - np.cumsum(n_late) + n_late)[of[late]]] = values[late]
    sizes = np.where(n > 0, prefix_size(n, similarity), 0)
    return ordered[np.arange(len(values)) - opens[of] < sizes[of]], sizes, n_rare


def prefix_index(sets: DataFrame) -> DataFrame:
    """``(h, node, n, pos, lead)`` of the n-grams that several sets' prefixes share; ``lead`` is ``(pos, node, n)``.

    The rows of a frequent n-gram are dealt in as many parts as there are partitions.
    """
    rows = sets.where(F.size("head") > 0).select("node", "n", "rare", F.posexplode("head").alias("pos", "h")).withColumn("hot", F.col("pos") >= F.col("rare"))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("node", "h"), F.lit(parts)).cast("int") + 1).otherwise(0)
    # Dealt before leads are made of the columns, so that each row travels once; place and size in one long.
    packed = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("packed")
    dealt = rows.select("h", "node", packed, part.alias("part")).repartition("h", "part")
    rows = dealt.select("h", "node", "part", F.shiftright("packed", 32).cast("int").alias("pos"), F.col("packed").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("n"))
    bucket = Window.partitionBy("h", "part")
    again = F.lag("node").over(bucket.orderBy("node")) == F.col("node")  # a copy from another run of rows
    rows = rows.select("h", "node", "n", "pos", "part", again.alias("again"), F.min(F.struct("pos", "node", "n")).over(bucket).alias("lead"), F.min("node").over(bucket).alias("least"), F.max("node").over(bucket).alias("most"))
    kept = rows.where("(part > 0 OR least <> most) AND NOT coalesce(again, false)")
    index = written(kept.select("h", "node", "n", "pos", "lead", (F.col("part") > 0).alias("hot")), "led")
    tops = written(index.where("hot").groupBy("h").agg(F.min("lead").alias("top"), F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("h", "top"), "tops")
    hot = index.where("hot").join(sized(tops), "h").select("h", "node", "n", "pos", F.col("top").alias("lead"))
    found = written(index.where("NOT hot").drop("hot").union(hot), "index")
    discard(index, tops)
    return found


# Filters -----------------------------------------------------------------------------------------


def _needed(n_a: Column, n_b: Column, similarity: float) -> Column:
    """The overlap that two sets must have."""
    return F.ceil((n_a + n_b) * (similarity / (1 + similarity)) - 1e-6)


def _lengths_fit(n_a: Column, n_b: Column, similarity: float) -> Column:
    return F.least(n_a, n_b) >= F.greatest(n_a, n_b) * similarity - 1e-6


def _positions_fit(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, similarity: float) -> Column:
    return F.least(pos_a, pos_b) + F.least(n_a - pos_a, n_b - pos_b) >= _needed(n_a, n_b, similarity)


def _rest(n_a: Column, n_b: Column, similarity: float) -> Column:
    """The most that two sets can share outside their prefixes: it stands behind the prefix that ends first, in the rest of that set."""
    return F.least(F.least(n_a, n_b), F.ceil(F.greatest(n_a, n_b) * similarity - 1e-6) - 1)


def _counts_fit(shared: Column, n_a: Column, n_b: Column, similarity: float) -> Column:
    return shared + _rest(n_a, n_b, similarity) >= _needed(n_a, n_b, similarity)


def _suffixes_fit(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs (a, b, ..)`` whose parities differ in no more places than the sets may be apart; ``nodes (node, n, x_0 ..)``."""
    bits = [f"x_{k}" for k in range(PARITIES)]
    both = pairs
    for end in ("a", "b"):
        both = both.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), *[F.col(x).alias(f"{end}{x}") for x in bits]), end)
    n_a, n_b = F.col("n_a"), F.col("n_b")
    apart = sum(F.bit_count(F.col(f"a{x}").bitwiseXOR(F.col(f"b{x}"))) for x in bits)
    return both.where(_lengths_fit(n_a, n_b, similarity) & (apart <= n_a + n_b - 2 * _needed(n_a, n_b, similarity))).select(*pairs.columns)


# Joining -----------------------------------------------------------------------------------------


def sized(df: DataFrame, times: int = 1) -> DataFrame:
    """``df``, which is in files, as a side of a join: broadcast up to ``times * MOST_ROWS``, else shuffled."""
    return F.broadcast(df) if df.count() <= times * MOST_ROWS else df


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _nodes_of(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """``(node, *columns)`` of the ends of ``pairs``, each once; copies are combined before they are dealt."""
    ends = written(_ends(pairs), "ends")
    found = written(sets.where(F.size("head") > 0).join(sized(ends, WHOLE_SETS), "node", "left_semi").groupBy("node").agg(*[F.first(c).alias(c) for c in columns]), "nodes")
    discard(ends)
    return found


def whole_sets(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``(node, s)`` of the ends of ``pairs``: sorted hashes, made of one text (and its copies) of each; ``texts`` are those of ``texts_of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for _, part in slices(batch.column(0), RUN_BYTES):
                values, n = sets_of(_distinct(part)[0], hashes, words)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                nodes = [xxhash.xxh3_64_intdigest(values[a:b].tobytes(), SEED) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                signed = [v - (1 << 64) if v >= 1 << 63 else v for v in nodes]
                yield pa.RecordBatch.from_arrays([pa.array(signed, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["node", "s"])

    ends = written(_ends(pairs), "ends")
    ones = sets.where(F.size("head") > 0).join(sized(ends, WHOLE_SETS), "node", "left_semi").groupBy("node").agg(F.first("key").alias("key"))
    keys = written(ones.select("key").distinct(), "keys")
    made = texts.join(sized(keys, WHOLE_SETS), "key", "left_semi").select("_text").mapInArrow(run, "node long, s array<long>")
    with small_batches(texts.sparkSession):
        found = written(made.groupBy("node").agg(F.first("s").alias("s")), "whole")
    discard(ends, keys)
    return found


def star_pairs(index: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b, shared)``: members of buckets with their leads that pass the filters on lengths, positions and counts."""
    n_a, pos_a, n_b, pos_b = F.col("lead.n"), F.col("lead.pos"), F.col("n"), F.col("pos")
    rows = index.where((F.col("lead.node") != F.col("node")) & _lengths_fit(n_a, n_b, similarity) & _positions_fit(n_a, pos_a, n_b, pos_b, similarity))
    least, most = F.least("lead.node", "node"), F.greatest("lead.node", "node")
    first = F.col("lead.node") < F.col("node")
    behind = F.least(n_a - pos_a, n_b - pos_b) - 1
    pair = rows.select(least.alias("a"), F.when(first, n_a).otherwise(n_b).alias("n_a"), most.alias("b"), F.when(first, n_b).otherwise(n_a).alias("n_b"), behind.alias("behind"))
    return _counted(pair, similarity)


def _counted(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b, shared)`` that pass the count filter; ``met`` has a row for each shared n-gram with what can stand ``behind`` it."""
    counted = met.groupBy("a", "n_a", "b", "n_b").agg(F.count(F.lit(1)).alias("shared"), F.min("behind").alias("behind"))
    shared, n_a, n_b = F.col("shared"), F.col("n_a"), F.col("n_b")
    fits = _counts_fit(shared, n_a, n_b, similarity) & (shared + F.col("behind") >= _needed(n_a, n_b, similarity))
    return counted.where(fits).select("a", "b", "shared")


def left_pairs(index: DataFrame, homes: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b, shared)``: pairs of different components that can still be alike.

    Only a set's prefix n-grams that are found in other components can be shared; ``held`` of them there are, and ``rank`` counts them
    in the set's order.  A pair must share ``need`` of them, so the first that it shares is among the first ``held - need + 1`` of both
    sets, and what it shares at all stands there or behind.  Each pair that can be alike is met at its first shared n-gram at least.
    Half of the parities, folded, travel with the rows, so what they rule out is never made.
    """
    rows = index.select("h", "node", "n", "pos").join(sized(homes), "node", "left").withColumn("of", F.coalesce("of", "node"))
    shares = rows.groupBy("h", "of").agg(F.count(F.lit(1)).alias("share"))
    mains = shares.groupBy("h").agg(F.max_by("of", F.struct("share", "of")).alias("main"), F.count(F.lit(1)).alias("kinds"))
    mixed = written(mains.where("kinds > 1").select("h", "main"), "mixed")
    own = Window.partitionBy("node")
    ranked = rows.join(sized(mixed), "h").select("*", F.row_number().over(own.orderBy("pos")).alias("rank"), F.count(F.lit(1)).over(own).alias("held"))
    half = PARITIES // 2
    folded = [F.first(F.col(f"x_{k}").bitwiseXOR(F.col(f"x_{k + half}"))).alias(f"p_{k}") for k in range(half)]
    marks = written(sets.where("node IS NOT NULL").groupBy("node").agg(*folded), "marks")
    columns = ("node", "n", "pos", "of", "rank", "held", *[f"p_{k}" for k in range(half)])
    there = written(ranked.join(sized(marks), "node").select("h", *columns, (F.col("of") == F.col("main")).alias("in_main")), "open")
    discard(mixed, marks)
    x = there.where("NOT in_main").select("h", *[F.col(c).alias(f"{c}_x") for c in columns])
    y = there.select(F.col("h").alias("h_y"), *[F.col(c).alias(f"{c}_y") for c in columns], "in_main")
    n_x, n_y = F.col("n_x"), F.col("n_y")
    needed = _needed(n_x, n_y, similarity)
    need = F.greatest(F.lit(1), needed - _rest(n_x, n_y, similarity))
    early = (F.col("rank_x") <= F.col("held_x") - need + 1) & (F.col("rank_y") <= F.col("held_y") - need + 1)
    enough = F.least(n_x - F.col("pos_x"), n_y - F.col("pos_y")) >= needed
    apart = sum(F.bit_count(F.col(f"p_{k}_x").bitwiseXOR(F.col(f"p_{k}_y"))) for k in range(half))
    enough = enough & (apart <= n_x + n_y - 2 * needed)
    met = x.join(y, (F.col("h") == F.col("h_y")) & (F.col("of_x") != F.col("of_y")) & (F.col("in_main") | (F.col("node_x") < F.col("node_y"))) & _lengths_fit(n_x, n_y, similarity) & early & enough)
    return met.groupBy(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def alike(pairs: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs (a, b)`` whose sets in ``found (node, s)`` are ``similarity`` alike (Jaccard)."""
    heads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    heads = found.select(F.col("node").alias("a"), F.col("s").alias("s_a")).join(heads, "a", "left_semi")
    size = heads.agg(F.sum(F.size("s_a") * 8)).first()[0] or 0
    members = pairs.join(found.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")
    both = members.join(F.broadcast(heads) if size <= MOST_SET_BYTES else heads, "a")
    overlap = F.size(F.array_intersect("s_a", "s_b"))
    return written(both.where(overlap * (1 + similarity) >= (F.size("s_a") + F.size("s_b")) * similarity - 1e-9).select("a", "b"), "links")


def _placed(pairs: DataFrame, homes: DataFrame) -> DataFrame:
    """``pairs`` with the components ``of_a`` and ``of_b`` of their ends, where these differ."""
    for end in ("a", "b"):
        pairs = pairs.join(homes.select(F.col("node").alias(end), F.col("of").alias(f"of_{end}")), end)
    return pairs.where("of_a <> of_b")


def _joined(homes: DataFrame, links: DataFrame) -> DataFrame:
    """``homes (node, of)`` after ``links (a, b)`` between nodes have joined components."""
    between = _placed(links, homes).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    moved = connected_components(between, "a", "b").select(F.col("node").alias("of"), "component")
    return written(homes.join(moved, "of", "left").select("node", F.coalesce("component", "of").alias("of")), "homes")


def _likeliest(open_pairs: DataFrame) -> DataFrame:
    """Of ``(a, b, shared, of_a, of_b)`` each component's pair with the most ``shared``."""
    sides = open_pairs.select(F.explode(F.array("of_a", "of_b")).alias("of"), "shared", "a", "b")
    return written(sides.groupBy("of").agg(F.max(F.struct("shared", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "picks")


def linked_over(pairs: DataFrame, homes: DataFrame, sets: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``homes (node, of)`` after all ``pairs (a, b, shared)`` between different components have been tried, likely ones first.

    ``homes`` is a table of ``written`` that nothing else reads; it is deleted.
    """
    nodes = _nodes_of(pairs, sets, ["n", *[f"x_{k}" for k in range(PARITIES)]])
    tried = written(_suffixes_fit(pairs, nodes, similarity), "pairs")
    found = whole_sets(tried, sets, texts, words)
    discard(nodes)
    before, homes = homes, written(homes.union(found.select("node", F.col("node").alias("of")).join(homes, "node", "left_anti")), "homes")
    discard(before)
    left = tried
    for k in range(ROUNDS + 1):
        open_pairs = _placed(left, homes)
        picks = written(open_pairs.select("a", "b"), "picks") if k == ROUNDS else _likeliest(open_pairs)
        if picks.isEmpty():
            break
        links = alike(picks, found, similarity)
        before, homes = homes, _joined(homes, links)
        discard(before, links)
        left = left.join(picks, ["a", "b"], "left_anti")
    discard(tried, found)
    return homes


def linked(sets: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, of)``: the component of every node that has a candidate; ``of`` is its smallest node.

    ``texts`` are those of ``texts_of`` that ``sets`` were made of; they are read again and must be the same each time.
    """
    index = prefix_index(sets)
    homes = written(sets.select("node", F.col("node").alias("of")).where("false"), "homes")
    star = written(star_pairs(index, similarity), "star")
    homes = linked_over(star, homes, sets, texts, words, similarity)
    left = written(left_pairs(index, homes, sets, similarity), "left")
    discard(star, index)
    homes = linked_over(left, homes, sets, texts, words, similarity)
    discard(left)
    return homes


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of distinct n-grams is at least ``similarity``; a text of fewer words
    is one n-gram.  ``component_id`` is the smallest ``doc_id`` reachable over links, itself included.  Texts that are null or without
    words have 0 n-grams and are linked with nothing.  Repeated rows each get their row; a null ``doc_id`` is no smallest id unless
    its component has no other.  An empty table gives an empty result; columns other than the two named are ignored.
    """
    sets = ngram_sets(docs, id_col, text_col, words, similarity=similarity)
    homes = linked(sets, texts_of(docs, text_col), words, similarity)
    marked = sets.select("doc_id", "node", "n").join(homes, "node", "left").withColumn("of", F.coalesce("of", "node"))
    marked = cut(marked.select("doc_id", "n", "of"))
    discard(sets, homes)
    smallest = marked.where("of IS NOT NULL").groupBy("of").agg(F.min("doc_id").alias("component_id"))
    return marked.join(smallest, "of", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
