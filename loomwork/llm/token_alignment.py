"""Alignment of two tokenizers' tokens over the bytes of each text.

A is a byte-level BPE of the tokenizers library, B a SentencePiece model with a dummy prefix; both read a text after one
space.  The libraries' spans (character offsets of A, the spans of B's immutable proto, which this version of the library calls
"offset mapping") give each token's end in whole characters: the coarse cuts.  A token that ends inside a character
- a part of a multibyte character in A, a byte-fallback token in B - has no cut of its own there and gets its end from the
decoded bytes of the tokens before it.

Where both sides end a token at the same byte, a group ends.  A link is a pair of tokens whose byte ranges overlap: every stretch
between neighbouring ends of either side lies in just one token of A and one of B, so stretches are links.

Both tokenizers cut before a blank or line feed that no white space precedes, and between a letter and a mark like a comma, so a text
falls apart there into chunks.  A worker remembers the alignments of chunks; new ones are aligned many at a time, in one flat
run of numpy arrays.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.batches import ids_and_texts, map_texts
from loomwork.llm.piece_codec import SPACE, default_model
from loomwork.llm.token_files import default_tokenizer
from loomwork.plans.lineage import written

#: New chunks after which a worker forgets those that it has not met since as many before; what is met again costs time only.
REMEMBERED = 150_000
#: Chunks that are aligned in one flat run.
RUN_CHUNKS = 1 << 13
#: Id pairs (of fixed width) that are broadcast with their counts; more of them are joined by shuffling.
MOST_PAIRS = 2_000_000
#: A pair's key holds B's id in its low bits.
LOW = 32

_TWO_BLANKS = re.compile(r"\s\s")
#: Letters and marks between which both tokenizers cut, if no piece holds a letter before another character.
_MARKED = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?*%$&#|])")
_CUTS = re.compile(rf"(?<=\S)(?=[ \n])|{_MARKED.pattern}")
_NONE = ("", b"", 0, 0)


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable Latin-1 stands for itself, the other bytes for U+0100 on."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids end to end, ids of each row)."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum())), sizes


def _flat_spans(rows: list[list[tuple[int, int]]], tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(first characters, end characters) of all tokens."""
    both = np.fromiter(chain.from_iterable(chain.from_iterable(rows)), np.int64, 2 * tokens)
    return both[::2], both[1::2]


class Aligner:
    """Alignments of texts, with a memory of chunks (chunk -> (groups, links, tokens of A, tokens of B))."""

    def __init__(self, spec: str, model: bytes):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        to_byte, added = byte_alphabet(), {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        spelled_a = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [added[i] if i in added else bytes([to_byte[c] for c in t]) for i, t in enumerate(spelled_a)]
        n, pieces = self.b.get_piece_size(), []
        for i in range(n):
            piece = self.b.id_to_piece(i)
            pieces.append(piece)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id(SPACE)
        layers = json.loads(spec)
        form = layers.get("pre_tokenizer") or {}
        cut_a = layers.get("normalizer") is None and form.get("type") == "ByteLevel" and form.get("use_regex", True) and not form.get("add_prefix_space")
        texts = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        mixed = any(x.isalpha() and not y.isalpha() for p in texts for x, y in zip(p, p[1:], strict=False))
        cut_b = not mixed and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in texts) and {SPACE, f"{SPACE}a"} <= set(texts)
        self.can_cut = bool(cut_a and cut_b)
        names = [str(i) for i in range(max(len(self.bytes_a), n))]
        self.width, self.named = len(names), [x + mark for mark in (",", "|", ";") for x in names]
        self.known: dict[str, tuple[str, bytes, int, int]] = {}
        self.older: dict[str, tuple[str, bytes, int, int]] = {}

    def chunks(self, text: str) -> list[str]:
        """``text`` after one space in parts that both tokenizers cut at."""
        spaced = " " + text
        if not self.can_cut:
            return [spaced]
        if _TWO_BLANKS.search(spaced):
            return _CUTS.split(spaced)
        words = text.replace("\n", " \n").replace(" ", "\0 ") if "\0" not in text else None
        if words is None:
            return _CUTS.split(spaced)
        words = [" ", *_MARKED.sub("\0", words).split("\0")]
        words[:2] = [words[0] + words[1]]
        return [w[1:] if w[:2] == " \n" else w for w in words]

    def _tokens_a(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first characters, end characters, tokens of each chunk), flat."""
        found = self.a.encode_batch(chunks, add_special_tokens=False)
        ids, sizes = _flat([e.ids for e in found])
        return ids, *_flat_spans([e.offsets for e in found], len(ids)), sizes

    def _tokens_b(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``_tokens_a``; the dummy prefix stands for a chunk's own blank.  Other chunks are read after a letter, whose token is taken away."""
        blank = [c[0] == " " for c in chunks]
        found = self.b.encode([c[1:] if own else f"a{c}" for c, own in zip(chunks, blank, strict=True)], return_type="offset_mapping", num_threads=1)
        lone = {"ids": [self.blank], "offsets": [(-1, 0)]}
        found = [lone if c == " " else x for c, x in zip(chunks, found, strict=True)]
        ids, sizes = _flat([x["ids"] if own else x["ids"][1:] for x, own in zip(found, blank, strict=True)])
        first, end = _flat_spans([x["offsets"] if own else x["offsets"][1:] for x, own in zip(found, blank, strict=True)], len(ids))
        shift = np.repeat(np.where(blank, 1, -1), sizes)
        return ids, first + shift, end + shift, sizes

    def _ends(self, tokens: tuple, lengths: np.ndarray, spelled: list[bytes], chunks: list[bytes], chars: np.ndarray, char_base: np.ndarray, byte_base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, end bytes in the flat run, tokens of each chunk, whether the chunk's bytes are the tokens' bytes)."""
        ids, first, end, sizes = tokens
        of = np.repeat(np.arange(len(sizes)), sizes)
        own = np.cumsum(lengths[ids])
        before = np.concatenate([[0], own])[np.cumsum(sizes) - sizes]
        decoded = own - before[of] + byte_base[of]
        coarse = chars[char_base[of] + end]
        # Without a character of its own, or with a part of one that the next token goes on with.
        later = np.append(first[1:], 0) < end
        later[np.cumsum(sizes)[sizes > 0] - 1] = False
        inside = (end <= first) | later
        ends = np.where(inside, decoded, coarse)
        raw = b"".join([spelled[i] for i in ids.tolist()])
        good = np.ones(len(chunks), bool)
        if raw != b"".join(chunks):
            stops = np.concatenate([[0], own])[np.cumsum(sizes)].tolist()
            good = np.array([raw[s:e] == c for s, e, c in zip(before.tolist(), stops, chunks, strict=True)])
        # Bytes define the tokens: spans that contradict them don't count.
        return ids, np.where(ends == decoded, ends, decoded), sizes, good

    def learn(self, chunks: list[str]) -> None:
        """Put the alignments of new chunks into the memory."""
        for at in range(0, len(chunks), RUN_CHUNKS):
            self._learn(chunks[at : at + RUN_CHUNKS])

    def _learn(self, chunks: list[str]) -> None:
        raw = [c.encode() for c in chunks]
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        chars = np.concatenate([[0], np.cumsum(width)])
        n_chars = np.fromiter(map(len, chunks), np.int64, len(chunks))
        char_base = np.cumsum(n_chars) - n_chars
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        byte_base = np.concatenate([[0], stops[:-1]])
        ids_a, ends_a, sizes_a, good_a = self._ends(self._tokens_a(chunks), self.length_a, self.bytes_a, raw, chars, char_base, byte_base)
        ids_b, ends_b, sizes_b, good_b = self._ends(self._tokens_b(chunks), self.length_b, self.bytes_b, raw, chars, char_base, byte_base)
        good = good_a & good_b
        if not good.all():
            keep_a, keep_b = np.repeat(good, sizes_a), np.repeat(good, sizes_b)
            ids_a, ends_a, ids_b, ends_b = ids_a[keep_a], ends_a[keep_a], ids_b[keep_b], ends_b[keep_b]
            for c in (c for c, fine in zip(chunks, good, strict=True) if not fine):
                self.known[c] = _NONE
            chunks = [c for c, fine in zip(chunks, good, strict=True) if fine]
            stops, sizes_a, sizes_b = stops[good], sizes_a[good], sizes_b[good]
            if not chunks:
                return
        every = np.union1d(ends_a, ends_b)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = (ids_a[np.searchsorted(ends_a, every)] << LOW) | ids_b[np.searchsorted(ends_b, every)]
        link_stops = np.searchsorted(every, stops, "right")
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = common[group_a] == ends_a, common[group_b] == ends_b
        codes = np.concatenate([ids_a + self.width * last_a, ids_b + 2 * self.width * last_b])
        places = np.concatenate([2 * group_a, 2 * group_b + 1])
        names = self.named
        words = [names[k] for k in codes[np.argsort(places, kind="stable")].tolist()]
        word_stops = np.cumsum(sizes_a + sizes_b).tolist()
        flat = links.astype("<i8").tobytes()
        starts = zip([0, *word_stops], word_stops, [0, *link_stops.tolist()], link_stops.tolist(), strict=False)
        for c, n_a, n_b, (w0, w1, l0, l1) in zip(chunks, sizes_a.tolist(), sizes_b.tolist(), starts, strict=True):
            self.known[c] = ("".join(words[w0:w1]), flat[8 * l0 : 8 * l1], n_a, n_b)

    def align(self, texts: list[str | None]) -> list[tuple[str, np.ndarray, int, int]]:
        """(groups, keys of the links, tokens of A, tokens of B) of each whole text.

        Texts that are null, empty or not the bytes of their tokens have no tokens.
        """
        cuts = [self.chunks(t) if t and SPACE not in t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = {c for parts in cuts for c in parts if c not in known}
        met = {c: older[c] for c in missing if c in older}
        known.update(met)
        self.learn([c for c in missing if c not in met])
        out = []
        for parts in cuts:
            found = [known[c] for c in parts]
            if not found or _NONE in found:
                out.append(("", np.zeros(0, np.int64), 0, 0))
                continue
            keys = np.frombuffer(b"".join([x[1] for x in found]), "<i8")
            out.append(("".join([x[0] for x in found])[:-1], keys, sum([x[2] for x in found]), sum([x[3] for x in found])))
        return out


@lru_cache(maxsize=2)
def _aligner(spec: str, model: bytes) -> Aligner:
    return Aligner(spec, model)


def alignments(docs: DataFrame, tokenizer_path: str | None = None, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times)``, one row for each row of ``docs``.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the distinct linked id pairs as ``a << 32 | b`` and ``times`` how many
    links of the text hold each.  The two vocabulary files are read on the driver and travel with the tasks.  Texts that are
    null, empty or hold what B can't spell back (its space mark) have no tokens: zeros, '' and empty arrays.
    Null ids and repeated rows stay as they are; an empty table gives an empty result; other columns are ignored.
    """
    spec, model = Path(tokenizer_path or default_tokenizer()).read_text(), Path(model_path or default_model()).read_bytes()

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        rows = _aligner(spec, model).align(texts.to_pylist())
        tallies = [np.unique(r[1], return_counts=True) for r in rows]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(u) for u, _ in tallies])]).astype(np.int32))
        longs = lambda values: pa.array(list(values), pa.int64())
        return {
            "n_a": longs(r[2] for r in rows),
            "n_b": longs(r[3] for r in rows),
            "n_groups": longs(r[0].count(";") + 1 if r[0] else 0 for r in rows),
            "n_links": longs(len(r[1]) for r in rows),
            "groups": pa.array([r[0] for r in rows], pa.string()),
            "pairs": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([u for u, _ in tallies]).astype(np.int64))),
            "times": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([c for _, c in tallies]).astype(np.int64))),
        }

    return map_texts(ids_and_texts(docs, id_col, text_col), kernel, "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, count, best)`` over all of ``aligned (pairs, times)``: how many links hold each id pair, and whether none with the same id of B is held by more."""
    tallied = aligned.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    counts = written(tallied, "pairs")
    side = lambda pair: F.col(pair).bitwiseAND(F.lit((1 << LOW) - 1))
    highest = counts.groupBy(side("pair").alias("b")).agg(F.max("count").alias("most"))
    joined = counts.withColumn("b", side("pair")).join(highest, "b")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned_documents(docs: DataFrame, tokenizer_path: str | None = None, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row of ``docs``.

    ``count_sum`` adds up the corpus-wide counts of a text's links and ``n_best`` counts those links whose count is the
    highest of their id of B.  Without tokens all are zero and the digest is ''.  Texts are tokenized once; what the counts need of
    them, distinct pairs and how often each stands in the text, is kept in the shared folder.  See ``alignments`` for odd rows.
    """
    found = alignments(docs, tokenizer_path, model_path, id_col, text_col)
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    kept = written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times"), "aligned")
    counts = written(pair_counts(kept), "counts")
    few = counts.count() <= most_pairs
    links = kept.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    scored = links.join(F.broadcast(counts) if few else counts, "pair")
    sums = scored.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return kept.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
