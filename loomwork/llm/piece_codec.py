"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The text is cut where no piece can span: before every run of the space mark, and around line feeds
when no longer piece holds one.  The distinct cuts of a batch ("words") are merged together in flat numpy
arrays: in each round the smallest pair rank of each word is found by a segmented minimum, all its
leftmost non-overlapping occurrences merge at once, and the arrays are compacted; words without a
mergeable pair leave.  Merging several occurrences at once equals the one-at-a-time order unless a
merge creates a pair of a still smaller rank; words in which that happens are redone one merge a
round, so the ids are exact in all cases.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from loomwork.llm.batches import ids_and_texts, map_texts

SPACE = "▁"
NEVER = np.iinfo(np.int32).max
#: Bytes of new words and their ids after which a worker forgets those that it has not met since as many before; what is met again
#: costs time only.  A word takes ``WORD_BYTES`` beside its characters and ids.
REMEMBERED_BYTES, WORD_BYTES = 16 << 20, 200
#: Characters of distinct words merged in one batch of rounds, unless a single word is longer; each takes some 100 bytes meanwhile.
BATCH_CHARS = 1 << 17
#: Bytes of text that are encoded at once, unless a single text is longer.
RUN_BYTES = 1 << 20

codecs.register_error("one-mark-a-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    """Encoder and decoder for one BPE model file with byte fallback."""

    def __init__(self, model: bytes):
        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.size = reader.get_piece_size()
        pieces = [reader.id_to_piece(i) for i in range(n)]
        self.eos = reader.eos_id()
        special = [reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i) for i in range(n)]
        is_byte = [reader.is_byte(i) for i in range(n)]
        plain = {p: i for i, p in enumerate(pieces) if not special[i] and not is_byte[i]}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece holds a space mark after another character; words can't be cut there")

        #: Symbol of each code point: its piece, or n + code point where there is none.
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        scores = {i: reader.get_score(i) for i in plain.values()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p, i in plain.items():
            for cut in range(1, len(p)):
                left, right = plain.get(p[:cut]), plain.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * n + right] = (i, order[scores[i]])
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_ids = np.array([pairs[k][0] for k in keys.tolist()] + [0], np.int32)
        self.pair_ranks = np.array([pairs[k][1] for k in keys.tolist()] + [NEVER], np.int32)

        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if is_byte[i]:
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.spelled = [b"" if reader.is_control(i) else bytes([int(pieces[i][3:5], 16)]) if is_byte[i] else " ⁇ ".encode() if reader.is_unknown(i) else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.silent = np.array([reader.is_control(i) for i in range(n)])
        self.opens_with_space = [not special[i] and not is_byte[i] and p.startswith(SPACE) for i, p in enumerate(pieces)]
        self.line_feed_is_alone = not any("\n" in p for p in plain)
        #: Ids of the words met lately, the bytes they take, and those of the words met before them.
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.faded: dict[str, bytes] = {}

    # Merging -----------------------------------------------------------------------------------

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair of symbols; NEVER where they do not merge."""
        pair = left.astype(np.int64) * self.size + right
        pair[(left >= self.size) | (right >= self.size)] = -1
        at = np.searchsorted(self.pair_keys, pair)
        hit = self.pair_keys[at] == pair
        return np.where(hit, self.pair_ranks[at], NEVER), self.pair_ids[at]

    def merge_words(self, symbols: np.ndarray, lengths: np.ndarray, one_at_a_time: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, flat, and their number in each word.  Lengths are at least 1."""
        total = len(lengths)
        done_at: list[np.ndarray] = []
        done_len: list[np.ndarray] = []
        done_sym: list[np.ndarray] = []
        redo: list[np.ndarray] = []
        word = np.arange(total)
        first = symbols, lengths
        rank, made = self._all_ranks(symbols, lengths)
        before = np.full(total, -1, np.int64)
        several = np.zeros(total, bool)
        while len(word):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank, starts)
            early = several & (best < before)
            over = (best == NEVER) | early
            if over.any():
                ended = over & ~early
                inside = np.repeat(ended, lengths)
                done_at.append(word[ended])
                done_len.append(lengths[ended])
                done_sym.append(symbols[inside])
                redo.append(word[early])
                stay = np.repeat(~over, lengths)
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                word, lengths, best = word[~over], lengths[~over], best[~over]
                if not len(word):
                    break
                starts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(word)), lengths)
            fits = rank == best[owner]
            at = np.flatnonzero(fits)
            if one_at_a_time:
                at = at[np.flatnonzero(np.diff(owner[at], prepend=-1))]
            else:  # of touching occurrences every other one, from the left
                opens = np.diff(at, prepend=-2) != 1
                run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            merges = np.bincount(owner[at], minlength=len(word))
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            tail = np.zeros(len(symbols), bool)
            tail[starts + lengths - 1] = True
            ends = tail[at + 1]
            symbols, rank, made, owner = symbols[keep], rank[keep], made[keep], owner[keep]
            lengths = lengths - merges
            here = new[at]
            self._renew(symbols, rank, made, here[~ends], here[~ends] + 1)
            rank[here[ends]] = NEVER
            back = here[(here > 0)]
            back = back[owner[back - 1] == owner[back]]
            self._renew(symbols, rank, made, back - 1, back)
            before, several = best.astype(np.int64), merges > 1
        if redo and len(again := np.concatenate(redo)):
            starts = np.cumsum(first[1]) - first[1]
            pick = np.concatenate([np.arange(starts[w], starts[w] + first[1][w]) for w in again])
            s, n = self.merge_words(self._fresh[pick], first[1][again], one_at_a_time=True)
            done_at.append(again)
            done_len.append(n)
            done_sym.append(s)
        at, n, s = np.concatenate(done_at), np.concatenate(done_len), np.concatenate(done_sym)
        order = np.argsort(at, kind="stable")
        begins = np.cumsum(n) - n
        sizes = n[order]
        gather = np.repeat(begins[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return s[gather], sizes

    def _all_ranks(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._fresh = symbols.copy()
        rank, made = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int32)
        rank[:-1], made[:-1] = self.ranks_of(symbols[:-1], symbols[1:])
        rank[np.cumsum(lengths) - 1] = NEVER
        return rank, made

    def _renew(self, symbols: np.ndarray, rank: np.ndarray, made: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        rank[left], made[left] = self.ranks_of(symbols[left], symbols[right])

    # Encoding ----------------------------------------------------------------------------------

    def cut(self, text: str) -> list[str]:
        """Keys of the words of a text, in order.

        A key that opens with a line feed or with a space mark stands for itself, any other for itself after
        one space mark.
        """
        if self.line_feed_is_alone and not (SPACE in text or "  " in text or " \n" in text or text.startswith(" ")):
            return text.replace("\n", " \n").split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        parts = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*" if self.line_feed_is_alone else f"{SPACE}+[^{SPACE}]*", marked)
        return [p[1:] if p[0] == SPACE and p[1:2] not in (SPACE, "\n") else p for p in parts]

    def learn(self, words: list[str]) -> None:
        """Put the ids of new words into the memory."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        start = 0
        while start < len(words):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BATCH_CHARS, "right")))
            some = words[start:stop]
            spelled = [w if w[:1] in (SPACE, "\n") else SPACE + w for w in some]
            points = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
            symbols, sizes = self.merge_words(self.symbol[points], lengths)
            symbols, sizes = self._with_bytes(symbols, sizes)
            raw, at = symbols.astype("<i4").tobytes(), (np.cumsum(sizes) * 4).tolist()
            self.known.update(zip(some, (raw[a:b] for a, b in zip([0, *at], at, strict=False)), strict=True))
            self.held += points.nbytes + len(raw) + WORD_BYTES * len(some)
            start = stop

    def recall(self, words: set[str]) -> list[str]:
        """Those of ``words`` that must be learned; what was met before is known again."""
        old = self.faded.get
        again = {w: ids for w in words if (ids := old(w)) is not None}
        self.known.update(again)
        self.held += sum(map(len, again.values())) + 4 * sum(map(len, again)) + WORD_BYTES * len(again)
        return [w for w in words if w not in again]

    def _with_bytes(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points without a piece become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, sizes
        spelled = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (symbols[odd] - self.size).tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(x) for x in spelled]
        word = np.repeat(np.arange(len(sizes)), sizes)
        out = np.repeat(symbols, width)
        out[np.repeat(symbols >= self.size, width)] = np.concatenate(spelled)
        return out, np.bincount(word, width, len(sizes)).astype(np.int64)

    def encode(self, texts: list[str | None], end: bool = True) -> list[np.ndarray]:
        """Ids of each whole text; null is empty.  ``end`` adds the end id."""
        if self.held > REMEMBERED_BYTES:
            self.faded, self.known, self.held = self.known, {}, 0
        get = self.known.get
        cuts = [self.cut(t) if t else [] for t in texts]
        found = [list(map(get, words)) for words in cuts]
        missing = {w for words, ids in zip(cuts, found, strict=True) if None in ids for w, i in zip(words, ids, strict=True) if i is None}
        self.learn(self.recall(missing))
        tail = np.int32(self.eos).astype("<i4").tobytes() if end else b""
        return [np.frombuffer(b"".join([get(w) if i is None else i for w, i in zip(words, ids, strict=True)] if None in ids else ids) + tail, "<i4") for words, ids in zip(cuts, found, strict=True)]

    # Decoding ----------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: control ids are silent, bytes that form no character become U+FFFD each."""
        table = self.spelled
        breaks = np.flatnonzero(self.silent[ids])
        listed = ids.tolist()
        runs = [listed[a:b] for a, b in zip([0, *(breaks + 1).tolist()], [*breaks.tolist(), len(listed)], strict=True)]
        spelled = [b"".join([table[i] for i in run]) for run in runs]
        lead = next((k for k, run in enumerate(runs) if run), None)
        if lead is not None and self.opens_with_space[runs[lead][0]]:
            spelled[lead] = spelled[lead][1:]
        return "".join([raw.decode("utf-8", "one-mark-a-byte") for raw in spelled])


@lru_cache(maxsize=2)
def _codec(model: bytes) -> PieceCodec:
    return PieceCodec(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row for each row of ``docs``.

    The model file is read on the driver and travels with the tasks (its size is that of a vocabulary).
    Null and empty texts have just the end id; null ids and repeated rows stay as they are; an empty
    table gives an empty result; columns other than the two named are ignored.
    """
    model = Path(model_path or default_model()).read_bytes()

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        rows = _codec(model).encode(texts.to_pylist(), end)
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))}

    return map_texts(ids_and_texts(docs, id_col, text_col), kernel, "ids array<int>", RUN_BYTES)


def encoding_digests(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each text's ids and of the text decoded from them."""
    model = Path(model_path or default_model()).read_bytes()

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        codec = _codec(model)
        names = _names(codec.size)
        counts, digests, decoded = [], [], []
        for ids in codec.encode(texts.to_pylist()):
            counts.append(len(ids))
            digests.append(hashlib.sha256(" ".join([names[i] for i in ids.tolist()]).encode()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    return map_texts(ids_and_texts(docs, id_col, text_col), kernel, "n_tokens long, ids_sha256 string, decoded_sha256 string", RUN_BYTES)


@lru_cache(maxsize=2)
def _names(n: int) -> list[str]:
    return [str(i) for i in range(n)]
