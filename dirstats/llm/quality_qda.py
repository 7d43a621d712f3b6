"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class has a normal density over transformed statistics of a text. Its covariance is shrunk
towards the pooled one and towards a multiple of the identity, and factored once (Cholesky); a
document's score is the logistic of the difference of the two log densities, whose Mahalanobis
distances come from the cached factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirstats.llm import wordhash
from dirstats.llm.quality_rules import STOP_WORDS, SYMBOLS
from dirstats.llm.scratch import written

U = np.uint64
STATISTICS = (
    "words", "word_length", "upper", "symbols", "marks", "digits", "spaces", "line_words",
    "distinct", "echoes", "stop_words", "wide", "commonest", "repeated_lines",
)
#: Weight of the pooled covariance, and of the identity times the mean variance.
TO_POOLED, TO_IDENTITY = 0.2, 0.02
#: Log odds are divided by this: the statistics are no normal variables, so they are too sure.
TEMPERATURE = 4.0

_UPPER, _LOWER, _SYMBOL, _MARK, _DIGIT, _SPACE, _WIDE, _LINE = range(1, 9)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = _MARK
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
_CLASS[[ord(c) for c in SYMBOLS]] = _SYMBOL
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = _SPACE, _LINE
_CLASS[128:] = _WIDE


def _stop_hashes() -> np.ndarray:
    words = sorted({w for text in STOP_WORDS.values() for w in text.split()})
    return np.sort(wordhash.words(pa.array([" ".join(words)]))[0])


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """Transformed statistics, a row per text. A null or empty text has no words, lines or
    characters, and all its shares are 0."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    kind = _CLASS[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    count = {k: _per_text(kind == k, at) for k in range(1, 9)}
    size = np.maximum(at[1:] - at[:-1], 1)
    hashes, bounds = wordhash.words(texts)
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[bounds[:-1][n > 0]] = False
    stops = _stop_hashes()
    place = np.minimum(np.searchsorted(stops, hashes), len(stops) - 1)
    distinct, commonest, lines = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if a < b:
            _, counts = np.unique(hashes[a:b], return_counts=True)
            distinct[k] = np.log1p(len(counts)) / np.log1p(b - a)
            commonest[k] = counts.max() / (b - a)
        rows = [x for x in texts[k].as_py().split("\n") if x.strip()]
        lines[k] = 1 - len(set(rows)) / len(rows) if rows else 0.0
    letters = np.maximum(count[_UPPER] + count[_LOWER], 1)
    inside = size - count[_SPACE] - count[_LINE]
    return np.column_stack(
        [
            np.log1p(n),
            np.log1p(np.where(n > 0, inside, 0) / some),
            np.sqrt(count[_UPPER] / letters),
            np.sqrt(count[_SYMBOL] / size),
            np.sqrt(count[_MARK] / size),
            np.sqrt(count[_DIGIT] / size),
            np.sqrt((count[_SPACE] + count[_LINE]) / size),
            np.log1p(n / (count[_LINE] + 1)),
            distinct,
            np.sqrt(_per_text(same, bounds) / some),
            np.sqrt(_per_text(stops[place] == hashes, bounds) / some),
            np.sqrt(count[_WIDE] / size),
            np.sqrt(commonest),
            np.sqrt(lines),
        ]
    )


def _measure(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            x = statistics(part.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), flat.cast(pa.list_(pa.float64()))], names=["doc_id", "x"]
            )


def _moments(batches):
    """Count, sums and products of each class in a task, as rows (quality, place, value)."""
    sums = {}
    for batch in batches:
        x = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, -1)
        y = batch.column("quality").to_numpy(zero_copy_only=False)
        for q in np.unique(y).tolist():
            z = x[y == q]
            flat = np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
            sums[q] = sums.get(q, 0) + flat
    for q, flat in sums.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([q] * len(flat), pa.int32()),
                pa.array(np.arange(len(flat), dtype=np.int32)),
                pa.array(flat),
            ],
            names=["quality", "place", "value"],
        )


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the classes 0 and 1, and the log
    odds of 1 before any statistic is seen."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(-0.5 * ((z * z).sum(axis=1) + self.log_dets[k]))
        return self.prior + density[1] - density[0]


def fit(moments: dict[int, np.ndarray], to_pooled: float, to_identity: float) -> Discriminant | float:
    """From (count, sums, products) of each class; with one class only, the share of class 1
    (0.5 with none)."""
    sizes = {q: m[0] for q, m in moments.items() if m[0] > 0}
    if set(sizes) != {0, 1}:
        return float(1 in sizes) if sizes else 0.5
    d = int(np.sqrt(len(moments[0]) - 1))
    means, scatter = [], []
    for q in (0, 1):
        n, total, products = sizes[q], moments[q][1 : d + 1], moments[q][d + 1 :].reshape(d, d)
        means.append(total / n)
        scatter.append(products - np.outer(total, total) / n)
    pooled = (scatter[0] + scatter[1]) / (sizes[0] + sizes[1])
    factors, log_dets = [], []
    for q in (0, 1):
        own = (1 - to_pooled) * scatter[q] / sizes[q] + to_pooled * pooled
        own = (1 - to_identity) * own + to_identity * max(np.trace(own) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    prior = float(np.log(sizes[1] / sizes[0]))
    return Discriminant(np.array(means), np.array(factors), np.array(log_dets), prior)


def _scorer(model: Discriminant | float, temperature: float):
    def score(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, -1)
            if isinstance(model, float):
                p = np.full(len(x), model)
            else:
                p = 1 / (1 + np.exp(-np.clip(model.log_odds(x) / temperature, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"]
            )

    return score


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    to_pooled: float = TO_POOLED,
    to_identity: float = TO_IDENTITY,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score and predicted.

    Learned from the rows of docs that labels (doc_id, quality) mark with 0 or 1 and whose
    crc32(doc_id as text) mod 4 is not 2; of several labels of one document the least counts,
    other label values and null labels are left out, and a null doc_id counts as held out. The
    class moments are summed over all of them. With labels of one class only that class is
    certain, and without any the score is 0.5. Null and empty texts are scored like others.
    Other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    measured = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _measure, "doc_id long, x array<double>"
        ),
        "statistics",
    )
    marked = (
        labels.where("quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    rows = (
        measured.where(~held)
        .join(marked, "doc_id")
        .select("quality", "x")
        .mapInArrow(_moments, "quality int, place int, value double")
        .groupBy("quality", "place")
        .agg(F.sum("value").alias("value"))
        .collect()  # two classes times the number of moments
    )
    moments: dict[int, dict[int, float]] = {}
    for r in rows:
        moments.setdefault(r["quality"], {})[r["place"]] = r["value"]
    arrays = {q: np.array([m[k] for k in sorted(m)]) for q, m in moments.items()}
    model = fit(arrays, to_pooled, to_identity)
    scored = measured.mapInArrow(_scorer(model, temperature), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
