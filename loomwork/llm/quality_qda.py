"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets the mean and covariance of its documents' statistics; the covariances are shrunk
towards the pooled one and towards a multiple of the identity.  The score is the posterior of class 1: the logistic function
of the difference between the classes' log densities, whose Mahalanobis terms use inverse Cholesky factors
computed once when the model is built.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.batches import slices
from loomwork.plans.shipping import ship

THRESHOLD = 0.3
#: Share of the pooled covariance in each class's, and of the mean variance in the result.
TO_POOLED, TO_IDENTITY = 0.2, 0.05

# Frequent function words of the four languages, one set.
STOP_WORDS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was what with you "
    "auch auf das dem den der des die ein eine für ist mit nicht sich und von zu "
    "avec dans de des elle en est et il la le les pas pour qui que un une "
    "a como con de del el en es la las lo los mi no o para por que se su un una y".split()
)
STATISTICS = ("chars", "word_length", "distinct_words", "stop_words", "symbols", "capitals", "digits", "sentence_marks", "shouts", "bars", "line_length", "repeated_lines", "packed")

_BYTES = np.arange(256)
_IS = {
    "symbols": np.isin(_BYTES, list(b"#*$%&<>~^=+_@\\{}[]")),
    "capitals": (_BYTES >= 65) & (_BYTES <= 90),
    "letters": ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | (_BYTES >= 0xC3),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "sentence_marks": np.isin(_BYTES, list(b".,;:?")),
    "shouts": _BYTES == 33,
    "bars": _BYTES == 124,
}


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; finite for any text, all fixed for an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n, w = len(raw), len(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    of = {k: int(counts[m].sum()) for k, m in _IS.items()}
    packed = len(zlib.compress(raw, 1))
    stops = sum([x in STOP_WORDS for x in text.lower().split()])

    def share(part: float, whole: float, usual: float, weight: float) -> float:
        """A ratio with ``weight`` units of usual text mixed in, so that short texts are not extreme."""
        return (part + usual * weight) / (whole + weight)

    return [
        np.log(max(len(text), 300)),
        np.log(share(sum(map(len, words)), w, 6, 20)),
        share(len(set(words)), w, 0.8, 50),
        np.sqrt(share(stops, w, 0.2, 20)),
        np.log(share(of["symbols"], n, 0.001, 100)),
        np.log(share(of["capitals"], of["letters"], 0.03, 100)),
        np.log(share(of["digits"], n, 0.001, 100)),
        np.log(share(of["sentence_marks"], n, 0.03, 100)),
        np.log(share(of["shouts"], n, 0.0005, 100)),
        np.log(share(of["bars"], n, 0.0005, 100)),
        np.log(share(len(text), len(lines), 100, 3)),
        np.log(share(len(lines) - len(set(lines)), len(lines), 0.02, 10)),
        np.log(share(packed, n, 0.5, 300)),
    ]


def measured(text: str | Column) -> Column:
    """Array of the statistics of a text column, in the order of ``STATISTICS``."""
    width = len(STATISTICS)

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        found = [np.zeros((0, width))]
        for _, part in slices(texts):
            found.append(np.array([statistics(t) for t in part.to_pylist()], np.float64).reshape(-1, width))
        flat = np.concatenate(found)
        offsets = np.arange(0, flat.size + 1, width, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))

    return measure(text)


@dataclass(frozen=True)
class QualityModel:
    """``centre`` and ``scale`` standardise; for each class a mean, an inverse Cholesky factor and a constant."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    constants: tuple[float, ...]
    only: int | None = None

    @property
    def learned(self) -> bool:
        """Whether both classes were there; if not, every score is the one class that was, or 0."""
        return self.only is None

    @staticmethod
    def build(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> QualityModel:
        """From (count, sum, sum of outer products) of each class."""
        width = len(STATISTICS)
        sums = {c: s for c, s in sums.items() if s[0] > 0}
        if len(sums) < 2:
            return QualityModel(np.zeros(width), np.ones(width), (), (), (), next(iter(sums), 0))
        total = sum(s[0] for s in sums.values())
        centre = sum(s[1] for s in sums.values()) / total
        spread = np.diag(sum(s[2] for s in sums.values())) / total - centre**2
        scale = np.sqrt(np.maximum(spread, 1e-6))
        means, raw = [], []
        for c in (0, 1):
            n, s, o = sums[c]
            mean = s / n
            means.append((mean - centre) / scale)
            raw.append((o / n - np.outer(mean, mean)) / np.outer(scale, scale))
        pooled = sum(sums[c][0] * raw[c] for c in (0, 1)) / total
        factors, constants = [], []
        for c in (0, 1):
            mixed = (1 - TO_POOLED) * raw[c] + TO_POOLED * pooled
            mixed = (1 - TO_IDENTITY) * mixed + TO_IDENTITY * max(np.trace(mixed) / width, 1e-3) * np.eye(width)
            lower = np.linalg.cholesky(mixed)
            factors.append(np.linalg.inv(lower))
            constants.append(float(np.log(sums[c][0] / total) - np.log(np.diag(lower)).sum()))
        return QualityModel(centre, scale, tuple(means), tuple(factors), tuple(constants))

    def score(self, found: np.ndarray) -> np.ndarray:
        """Posterior of class 1 of each row of statistics."""
        if self.only is not None:
            return np.full(len(found), float(self.only))
        x = (found - self.centre) / self.scale
        log = [k - 0.5 * np.square((x - m) @ f.T).sum(axis=1) for m, f, k in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def learn(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Learn from ``found`` (doc_id, statistics) joined with the labels 0 and 1; null labels are left out.

    All labelled rows take part; a document with several labels, or an id on several rows, counts once for each
    pair of rows, and null ids match no label.  Without rows of both labels the model has learned nothing (``learned``).
    The executors sum counts, statistics and outer products for each
    task, Spark adds these up by position, and only the sums come to the driver.
    """
    width = len(STATISTICS)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    both = found.join(known, "doc_id").select("label", "statistics")

    def add(batches):
        totals = {c: np.zeros(1 + width + width * width) for c in (0, 1)}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for c, total in totals.items():
                x = values[label == c]
                total += np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
        for c, total in totals.items():
            if total[0]:
                yield pa.RecordBatch.from_pydict({"label": pa.array([c] * len(total), pa.int32()), "at": pa.array(range(len(total)), pa.int32()), "v": total})

    ship(found.sparkSession)
    rows = both.mapInArrow(add, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    sums = {c: np.zeros(1 + width + width * width) for c in (0, 1)}
    for r in rows:
        sums[r.label][r.at] = r.v
    return QualityModel.build({c: (s[0], s[1 : 1 + width], s[1 + width :].reshape(width, width)) for c, s in sums.items()})


def scored(model: QualityModel, found: str | Column) -> Column:
    """Score (0 to 1) of a column of statistics; every row has one, empty texts too."""
    width = len(STATISTICS)

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)))

    return score(found)
