"""Language identification with language-bitmask n-gram filters.

Learning gathers the character 4-grams of every language over a bounded sample of labelled documents and
puts all of them into one Bloom filter, sized by their number, whose cells hold a bit for each language
(bit-sliced: one probe asks all languages at once).  A prediction looks up every 4-gram of the whole text,
ANDs the cells of its probes into the set of languages that know it, and counts the set bits for each
language.  From the counts the hits that false positives alone would give are taken off; the language with
the largest rest is the prediction, and the rest's share of all 4-grams is the score.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.batches import slices
from loomwork.plans.shipping import ship

UNKNOWN = "und"
GRAM = 4
#: Labelled documents of each language that learning expects to read; all if there are fewer.
SAMPLE_PER_LANGUAGE = 2000
PROBES = 3
#: Cells of the filter for each 4-gram of one language.
CELLS_PER_GRAM = 32
#: Bits of a word of a cell; a cell has as many words as the languages need.
WORD = 64
#: Bytes of text that are looked at together.
TOGETHER = 1 << 20

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter (Unicode category L*)."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each 4-gram, flat; number for each text; whether the text has a letter).

    Texts are lower-cased; every run of other characters counts as one blank, as do both ends.
    """
    points, sizes, lettered = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    letters = _letters()
    for i, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        real = letters[codes]
        codes = np.concatenate(([np.uint32(32)], np.where(real, codes, np.uint32(32)), np.full(GRAM, 32, np.uint32)))
        blank = codes == 32
        codes = codes[~(blank & np.concatenate(([False], blank[:-1])))]
        if len(codes) < GRAM:
            codes = np.concatenate((codes, np.full(GRAM - len(codes), 32, np.uint32)))
        points.append(codes)
        sizes[i], lettered[i] = len(codes), real.any()
    if not points:
        return np.zeros(0, np.uint64), sizes, lettered
    flat = np.concatenate(points).astype(np.uint64)
    mixed = flat[: len(flat) - GRAM + 1].copy()
    for k in range(1, GRAM):
        mixed = mixed * _STEP ^ flat[k : len(flat) - GRAM + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _SPREAD
    mixed ^= mixed >> np.uint64(32)
    ends = np.cumsum(sizes)
    inside = np.ones(len(flat), bool)
    for k in range(1, GRAM):
        inside[ends - k] = False
    return mixed[inside[: len(mixed)]], sizes - GRAM + 1, lettered


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    cells: np.ndarray
    false_rates: np.ndarray

    @staticmethod
    def build(known: dict[str, np.ndarray]) -> LanguageModel:
        """From the 4-gram hashes of each language."""
        languages = tuple(sorted(known))
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if np.iinfo(t).bits >= len(languages)), np.uint64)
        most = max((len(g) for g in known.values()), default=1)
        cells = np.zeros((-(-len(languages) // WORD), 1 << int(CELLS_PER_GRAM * max(most, 1) - 1).bit_length()), kind)
        filled = np.zeros(len(languages))
        for k, language in enumerate(languages):
            word, bit = cells[k // WORD], kind(k % WORD)
            for at in LanguageModel._probes(np.asarray(known[language], np.uint64), len(word)):
                word[at] |= kind(1) << bit
            filled[k] = ((word >> bit) & kind(1)).mean()
        return LanguageModel(languages, cells, filled**PROBES)

    @staticmethod
    def _probes(hashes: np.ndarray, n: int) -> list[np.ndarray]:
        first, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return [((first + np.uint64(k) * step) & np.uint64(n - 1)).astype(np.int64) for k in range(PROBES)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        hashes, sizes, lettered = grams(texts)
        if not len(texts) or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        probes = self._probes(hashes, self.cells.shape[1])
        starts = np.cumsum(sizes) - sizes
        kind, counts = self.cells.dtype.type, []
        for first, cells in zip(range(0, len(self.languages), WORD), self.cells, strict=True):
            held = cells[probes[0]]
            for at in probes[1:]:
                held &= cells[at]
            bits = range(min(WORD, len(self.languages) - first))
            counts += [np.add.reduceat((held >> kind(bit)) & kind(1), starts, dtype=np.int64) for bit in bits]
        hits = np.stack(counts, axis=1)
        real = (hits - sizes[:, None] * self.false_rates) / (1 - self.false_rates)
        best = real.argmax(axis=1)
        score = np.where(lettered, np.clip(real[np.arange(len(texts)), best] / sizes, 0, 1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows of ``docs`` with a text and a language.

    A language with more than ``sample`` rows takes part with about that many, chosen by a hash of
    their ids; the texts that are used are used whole.  What comes to the driver is the filter's
    content, the distinct 4-grams of that sample.  Repeated rows change nothing; rows without an id
    are drawn all or none; without any row the model knows no language.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel.build({})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(drawn < F.element_at(share, F.col("lang"))).select("lang", "text")

    def gather(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, part in slices(batch.column(1), TOGETHER):
                hashes, sizes, _ = grams(part.to_pylist())
                of = np.repeat(np.arange(len(part)), sizes)
                here = np.array(langs[start : start + len(part)])
                for lang in sorted(set(here.tolist())):
                    found = np.unique(hashes[(here == lang)[of]])
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "gram": found.view(np.int64)})

    ship(docs.sparkSession)
    top = chosen.mapInArrow(gather, "lang string, gram long").distinct().toArrow()
    langs, found = np.array(top.column(0).to_pylist()), top.column(1).to_numpy().view(np.uint64)
    return LanguageModel.build({lang: found[langs == lang] for lang in counts})


def predicted(model: LanguageModel, text: str | Column) -> Column:
    """Struct ``(lang_pred, score)`` of a text column; null and letterless texts are ``und`` with score 0.

    Of languages that fit alike the first in the order of their names is given; long texts are read whole.
    """

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], [np.zeros(0)]
        for _, part in slices(texts, TOGETHER):
            lang, score = model.predict(part.to_pylist())
            names += lang
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row; repeated rows and null ids stay as they are.

    A model that knows no language answers ``und`` with score 0.  An empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    pairs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return pairs.select("doc_id", predicted(model, "text").alias("p")).select("doc_id", "p.lang_pred", "p.score")
