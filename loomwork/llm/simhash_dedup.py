"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of ``bits`` bits is cut into ``radius // 2 + 1`` segments.  Two fingerprints within ``radius``
bits then agree, but for at most one bit, on some segment.  Each segment is indexed under every
variant that has one of its bits struck out; two segments that differ in at most one bit share such a
variant, so an equality join on variants meets every pair within the radius.

What is linked is found without writing out the pairs inside a bucket.  First every member of a
bucket is compared with the bucket's smallest fingerprint, and the links found are merged into
components.  Only what can still matter is compared after that: members outside their bucket's
largest component against the members of other components.  Both steps are exact, so the final
components are those of the full link graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.batches import ids_and_texts, map_texts
from loomwork.operators.components import connected_components
from loomwork.plans.lineage import cut

SEED = 42
BITS = 64
RADIUS = 4
SHINGLE_WORDS = 4


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of one text: A-Z lower-cased, words parted by ASCII white space.

    Shorter texts are one shingle; a text without words has fingerprint 0.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    first = [0, *ends[:-words].tolist()]
    last = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(last))
    counts = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long; null and empty texts have 0."""

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        found = [fingerprint(t or b"", words) for t in texts.cast(pa.binary()).to_pylist()]
        return {"fp": pa.array(np.array(found, np.uint64).view(np.int64))}

    return map_texts(ids_and_texts(docs, id_col, text_col), kernel, "fp long")


def segments(radius: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of the ``radius // 2 + 1`` segments."""
    n = radius // 2 + 1
    edges = [bits * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(fp: Column, radius: int, struck: int = 1) -> Column:
    """Array of the keys of all one-wildcard segment variants.

    A wildcard strikes out ``struck`` neighbouring bits.  With one, a key stands for every place of the
    differing bit; wider ones need fewer keys and still cover each such place.  A key is the segment without
    the struck-out bits, followed by the number of the lowest of them, which is unique over all segments.
    """
    keys = []
    for low, width in segments(radius):
        held = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else fp
        for bit in range(0, width, struck):
            masked = held.bitwiseAND(F.lit(~(((1 << min(struck, width - bit)) - 1) << bit)))
            keys.append(F.shiftleft(masked, 6).bitwiseOR(F.lit(low + bit)))
    return F.array(*keys)


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def spread(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` dealt over all partitions, for what makes many rows of each.

    It deals by a hash of ``by``: dealing by a column that the rows are dealt by already would be left out of the
    plan, and their few partitions kept.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(by))


def first_shared(key: Column, x: Column, radius: int) -> Column:
    """Whether ``key`` is the first of the variants that two fingerprints with difference ``x`` share.

    A pair shares many variants; with this condition in the join it is met once.
    """
    struck, earlier, out = key.bitwiseAND(F.lit(63)), F.lit(True), F.lit(False)
    for low, width in segments(radius):
        part = x.bitwiseAND(F.lit(((1 << width) - 1) << low if low + width < BITS else -(1 << low)))
        out = out | (struck.between(low, low + width - 1) & earlier & ((part != 0) | (struck == low)))
        earlier = earlier & (F.bit_count(part) >= 2)
    return out


def linked_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, component)`` for those distinct ``fp`` values that have a link within ``radius``.

    ``component`` is the smallest linked ``fp``.  ``fps`` has the one column ``fp``, without repeats.
    ``radius`` must leave segments of at most 58 bits, so it is at least 2.
    """
    index = spread(fps, "fp").select("fp", F.explode(variants(F.col("fp"), radius)).alias("key"))
    buckets = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lead")).where("n > 1")
    to_lead = (F.col("fp") != F.col("lead")) & (distance("fp", "lead") <= radius)
    members = cut(index.join(buckets.withColumnRenamed("key", "bucket"), (F.col("key") == F.col("bucket")) & (to_lead | (F.col("n") > 2))).drop("bucket"))
    near = members.where(to_lead)
    first = connected_components(near.select("fp", "lead").distinct(), "fp", "lead")

    placed = (
        members.where("n > 2")
        .select("key", "fp")
        .join(first.select(F.col("node").alias("fp"), F.col("component").alias("of")), "fp", "left")
        .select("key", "fp", F.coalesce("of", "fp").alias("of"))
    )
    placed = cut(placed)
    shares = placed.groupBy("key", "of").agg(F.count(F.lit(1)).alias("share"))
    mixed = shares.groupBy("key").agg(F.max_by("of", F.struct("share", "of")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key", "main")
    there = placed.join(mixed, "key")
    rest = there.where("of <> main").select("key", F.col("fp").alias("fp_a"), F.col("of").alias("a"))
    every = there.select(F.col("key").alias("key_b"), F.col("fp").alias("fp_b"), F.col("of").alias("b"))
    met = first_shared(F.col("key"), F.col("fp_a").bitwiseXOR(F.col("fp_b")), radius)
    more = rest.join(every, (F.col("key") == F.col("key_b")) & (F.col("a") != F.col("b")) & (distance("fp_a", "fp_b") <= radius) & met).select("a", "b").distinct()
    second = connected_components(more, "a", "b")
    loose = second.select(F.col("node").alias("of"), F.col("component").alias("joined"))
    nodes = first.select(F.col("node").alias("fp"), F.col("component").alias("of"))
    nodes = nodes.union(second.select(F.col("node").alias("fp"), F.col("node").alias("of")).join(nodes, "fp", "left_anti"))
    return nodes.join(loose, "of", "left").select("fp", F.coalesce("joined", "of").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, itself included.  Equal
    fingerprints are linked, those of empty texts (0) too.  Null texts count as empty.  Repeated rows
    each get their row; a null ``doc_id`` is no smallest id unless its component has no other.  Empty
    input gives an empty result; columns other than the two named are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col, words))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = linked_components(distinct.select("fp"), radius)
    homes = cut(distinct.join(linked, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    smallest = homes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = homes.join(smallest, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
