"""Toxicity: a logistic classifier that is held to the same score when groups are swapped.

A document's features are its words and the beginnings of its words. The sampled texts that name
a group of people are rendered again with other groups of the same kind in its place, and with
people of no group; the fit penalises the squared change of the log odds between a text and its
renderings, so that no weight is put on who is mentioned, whatever the share of toxic documents
among those that mention them in the labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirstats.llm.scratch import written
from dirstats.llm.wordhash import Powers, buffers, mix

U = np.uint64
#: The classifier is fitted on at most so many labelled documents, chosen by a hash of their id.
TRAIN_ROWS = 20_000
#: Bytes of the beginnings of words that are features besides the words themselves.
BEGINNINGS = (4, 5, 6, 7)
#: Features: at most so many, each in so many sampled documents, its share of toxic ones off by
#: so many standard errors.
MOST_FEATURES = 8_192
LEAST_DOCS = 3
SURE = 2.5
#: Occurrences of a feature in one document that count.
MOST_OCCURRENCES = 4
#: Weights of the squared weights and of the squared changes of the log odds.
RIDGE, FAIRNESS = 2e-4, 4.0
#: Renderings of a sampled text that names groups: with other groups, and with this word.
RENDERINGS = 3
ANYONE = "people"
THRESHOLD = 0.3
STEPS = 400

# Groups of people by kind; within a kind any term can stand for any other.
IDENTITIES = {
    "gender": "men women boys girls males females",
    "person": "man woman boy girl male female",
    "faith": "christians muslims jews hindus buddhists sikhs atheists catholics protestants",
    "believer": "christian muslim jewish hindu buddhist sikh atheist catholic protestant",
    "colour": "black white brown asian latino hispanic african european arab indigenous",
    "nation": (
        "american mexican canadian chinese japanese indian russian german french spanish italian "
        "polish turkish nigerian brazilian iranian"
    ),
    "orientation": "gay straight lesbian bisexual heterosexual homosexual queer",
    "identity": "transgender cisgender trans nonbinary",
    "status": "immigrants refugees natives foreigners citizens migrants",
    "ability": "disabled blind deaf autistic paralyzed",
    "age": "young old elderly teenage",
}

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = True
_INSIDE[128:] = True
_RNG = np.random.Generator(np.random.PCG64(20250311))
_ODD = _RNG.integers(1, 2**63, size=16, dtype=np.uint64) * U(2) + U(1)
_LETTER = _RNG.integers(1, 2**63, size=256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_UP, _DOWN = Powers(int(_ODD[0])), Powers(pow(int(_ODD[0]), -1, 2**64))
#: Bytes looked at at a time; a longer word is looked at whole.
PIECE = 1 << 19


def features(texts: pa.Array):
    """(text numbers, feature hashes) of every word and word beginning, piece by piece. A word is
    a run of letters, digits and bytes from 128 on, with A-Z lower-cased."""
    raw, bounds = buffers(texts)
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        stop = min(end, at + PIECE)
        while stop < end:  # a piece ends where a word ends
            gaps = np.flatnonzero(~_INSIDE[raw[stop : stop + PIECE]])
            if len(gaps):
                stop += int(gaps[0])
                break
            stop = min(end, stop + PIECE)
        part = raw[at:stop]
        inside = _INSIDE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop)] - at
        first[cuts[inside[cuts]]] = True  # texts follow each other without a gap
        s = np.flatnonzero(first)
        if len(s):
            last = inside.copy()
            last[:-1] &= ~inside[1:] | first[1:]
            e = np.flatnonzero(last) + 1
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_LETTER[part] * _UP.get(len(part))[: len(part)], out=sums[1:])
            back = _DOWN.get(len(part))[s]
            text = np.searchsorted(bounds, s + at, side="right") - 1
            yield text, mix((sums[e] - sums[s]) * back + (e - s).astype(U) * _ODD[1])
            for k in BEGINNINGS:
                long = e - s > k
                yield text[long], mix((sums[s[long] + k] - sums[s[long]]) * back[long] + np.full(1, k, U) * _ODD[2])
        at = stop


def _parts(batch: pa.RecordBatch, column: str = "text", rows: int = 512):
    texts = batch.column(column)
    for at in range(0, batch.num_rows, rows):
        yield at, texts.slice(at, rows)


def _terms() -> tuple[dict[str, tuple[str, int]], dict[str, list[str]]]:
    kinds = {k: v.split() for k, v in IDENTITIES.items()}
    return {t: (k, i) for k, terms in kinds.items() for i, t in enumerate(terms)}, kinds


def swapped(text: str, turn: int) -> str:
    """text with every group replaced by another of its kind, the turn-th part on in its list, or
    by no group where the turns are used up."""
    where, kinds = _terms()

    def other(m: re.Match) -> str:
        kind, i = where[m[0].lower()]
        terms = kinds[kind]
        far = 1 + (turn * max(1, (len(terms) - 1) // RENDERINGS)) % (len(terms) - 1)
        new = terms[(i + far) % len(terms)] if turn <= RENDERINGS else ANYONE
        return new.upper() if m[0].isupper() else new.capitalize() if m[0][0].isupper() else new

    return _PATTERN.sub(other, text)


_PATTERN = re.compile(
    r"(?ai)(?<![^\W_])(?:" + "|".join(sorted(_terms()[0], key=len, reverse=True)) + r")(?![^\W_])"
)


def _count(batches):
    """(feature, documents, toxic documents) of the rows of a task, added up here first."""
    held = [np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle():
        keys = np.concatenate([held[0], *(k for k, _ in waiting)])
        one = [np.ones(len(k), np.int64) for k, _ in waiting]
        n = np.concatenate([held[1], *one])
        toxic = np.concatenate([held[2], *(t for _, t in waiting)])
        waiting.clear()
        order = np.argsort(keys, kind="stable")
        keys, n, toxic = keys[order], n[order], toxic[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
        if len(first):
            keys, n, toxic = keys[first], np.add.reduceat(n, first), np.add.reduceat(toxic, first)
        return keys, n, toxic

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0].view(np.int64)), pa.array(rows[1]), pa.array(rows[2])],
            names=["feature", "n", "toxic"],
        )

    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for at, texts in _parts(batch, rows=64):
            found = list(features(texts))
            if not found:
                continue
            text = np.concatenate([t for t, _ in found])
            keys = np.concatenate([k for _, k in found])
            order = np.lexsort((keys, text))
            text, keys = text[order], keys[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))
            waiting.append((keys[new], label[at + text[new]]))
            if sum(len(k) for k, _ in waiting) > 2_000_000:
                held = list(settle())
                if len(held[0]) > 2_000_000:
                    yield out(held)
                    held = [np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    held = settle()
    if len(held[0]):
        yield out(held)


def occurrences(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of the feature, occurrences) of the known features, which are in order."""
    hits = []
    if len(known):
        shift = U(64 - 20)
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(known >> shift).astype(np.int64)] = True
        for text, keys in features(texts):
            some = np.flatnonzero(maybe[(keys >> shift).astype(np.int64)])
            at = np.searchsorted(known, keys[some]).clip(max=len(known) - 1)
            same = known[at] == keys[some]
            hits.append(text[some[same]] * len(known) + at[same])
    if not hits:
        none = np.zeros(0, np.int64)
        return none, none, none
    both, n = np.unique(np.concatenate(hits), return_counts=True)
    return both // len(known), both % len(known), n


def _value(n: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + np.minimum(n, MOST_OCCURRENCES))


def _render(known: np.ndarray):
    """Rows (name, toxic, turn, at, n): the known features of a sampled text, and of its other
    renderings where it names groups (turn 1 and up)."""

    def work(batches):
        for batch in batches:
            rows = {"name": [], "toxic": [], "turn": [], "at": [], "n": []}
            for at, texts in _parts(batch, rows=64):
                listed = texts.to_pylist()
                named = [k for k, t in enumerate(listed) if t and _PATTERN.search(t)]
                turns = [(0, range(len(listed)), texts)]
                for turn in range(1, RENDERINGS + 2):
                    made = [swapped(listed[k], turn) for k in named]
                    turns.append((turn, named, pa.array(made, pa.string())))
                for turn, numbers, rendered in turns:
                    text, feature, n = occurrences(rendered, known)
                    cuts = np.searchsorted(text, np.arange(len(numbers) + 1))
                    for j, k in enumerate(numbers):
                        s, e = cuts[j], cuts[j + 1]
                        rows["name"].append(batch.column("doc_id")[at + k].as_py())
                        rows["toxic"].append(batch.column("toxic")[at + k].as_py())
                        rows["turn"].append(turn)
                        rows["at"].append(feature[s:e].tolist())
                        rows["n"].append(np.minimum(n[s:e], MOST_OCCURRENCES).tolist())
            types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)],
                names=list(rows),
            )

    return work


class _Matrix:
    """Sparse rows, with products from either side."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(rows), width
        none_at, none = np.zeros(0, np.int64), np.zeros(0)
        self.row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
        self.at = np.concatenate([none_at, *(a for a, _ in rows)])
        self.value = np.concatenate([none, *(v for _, v in rows)])

    def by(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], minlength=self.n)[: self.n]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], minlength=self.width)


@dataclass(frozen=True)
class Model:
    """Feature hashes in order, their weights, and the log odds of a text without any of them."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        text, at, n = occurrences(texts, self.known)
        z = self.bias + np.bincount(text, _value(n) * self.weights[at], minlength=len(texts))
        return 1 / (1 + np.exp(-z[: len(texts)]))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]],
    toxic: np.ndarray,
    changes: list[tuple[np.ndarray, np.ndarray]],
    width: int,
    fairness: float = FAIRNESS,
    ridge: float = RIDGE,
) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean log loss plus ridge / 2 times the squared weights plus
    fairness / 2 times the mean squared change of the log odds by the rows of changes:
    accelerated gradient steps of a length that the largest curvature allows."""
    x, d = _Matrix(rows, width), _Matrix(changes, width)
    y = toxic.astype(np.float64)
    n, m = max(1, x.n), max(1, d.n)

    def bend(v, b):
        along = x.by(v) + b
        return x.back(along) / (4 * n) + ridge * v + fairness * d.back(d.by(v)) / m, along.sum() / (4 * n)

    v, b, curve = np.ones(width), 1.0, 1.0
    for _ in range(30):
        v, b = bend(v, b)
        curve = max(float(np.sqrt(v @ v + b * b)), 1e-12)
        v, b = v / curve, b / curve
    step = 1 / (1.05 * curve + ridge)
    w, bias = np.zeros(width), 0.0
    at_w, at_b, age = w, bias, 1.0
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-(x.by(at_w) + at_b))) - y
        slope = x.back(miss) / n + ridge * at_w + fairness * d.back(d.by(at_w)) / m
        new_w, new_b = at_w - step * slope, at_b - step * float(miss.sum()) / n
        if (at_w - new_w) @ (new_w - w) + (at_b - new_b) * (new_b - bias) > 0:
            age = 1.0  # the momentum points uphill
        following = (1 + np.sqrt(1 + 4 * age * age)) / 2
        pull = (age - 1) / following
        at_w, at_b = new_w + pull * (new_w - w), new_b + pull * (new_b - bias)
        w, bias, age = new_w, new_b, following
    return w, bias


def sample_of(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(doc_id, toxic, text) of at most train_rows labelled documents outside of the held-out
    rows, one row each: of several labels the greatest counts, of several texts that of the least
    digest."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    marked = (
        labels.select(doc_id, F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(doc_id, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    there = marked.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = written(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "sample")
    return written(
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min_by("text", F.sha2("text", 256)).alias("text")),
        "sampled-texts",
    )


def train(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, fairness: float = FAIRNESS
) -> Model:
    """The classifier of the labelled rows. At most train_rows rows of feature numbers reach the
    driver; without labels every text has even odds."""
    sample = sample_of(docs, labels, train_rows)
    first = sample.agg(F.count("*"), F.sum("toxic")).first()
    total, bad = int(first[0]), int(first[1] or 0)
    if not total:
        return Model(np.zeros(0, U), np.zeros(0), 0.0)
    q = (bad + 0.5) / (total + 1)
    counts = (
        sample.select("toxic", "text")
        .mapInArrow(_count, "feature long, n long, toxic long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    )
    off = F.abs(F.col("toxic") - F.col("n") * q) / F.sqrt(F.col("n") * (q * (1 - q)))
    told = (
        counts.where(F.col("n") >= LEAST_DOCS)
        .select("feature", off.alias("off"))
        .where(F.col("off") >= SURE)
        .orderBy(F.desc("off"), "feature")
        .limit(MOST_FEATURES)
    )
    groups = pa.array([" ".join(_terms()[0])])
    own = np.concatenate([k for _, k in features(groups)])
    telling = np.array([r[0] for r in told.collect()], dtype=np.int64).view(U)
    known = np.unique(np.concatenate([telling, own]))
    schema = "name long, toxic int, turn int, at array<int>, n array<int>"
    rows, changes, toxic, last = [], [], [], None
    rendered = written(sample.mapInArrow(_render(known), schema), "rendered")
    for r in rendered.orderBy("name", "turn").toLocalIterator():
        at, value = np.array(r["at"], np.int64), _value(np.array(r["n"], np.float64))
        if r["turn"] == 0:
            rows.append((at, value))
            toxic.append(r["toxic"])
            last = (at, value)
        else:
            changes.append((np.concatenate([last[0], at]), np.concatenate([last[1], -value])))
    weights, bias = fit(rows, np.array(toxic), changes, len(known), fairness)
    return Model(known, weights, bias)


def _scorer(model: Model):
    def score(batches):
        for batch in batches:
            done = [model.score(texts) for _, texts in _parts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *done]))],
                names=["doc_id", "score"],
            )

    return score


def score_toxicity(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, fairness: float = FAIRNESS
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score and predicted.

    Learned from the documents that labels (doc_id, toxic) mark with 0 or 1 and whose
    crc32(doc_id as text) mod 4 is not 2, at most train_rows of them; other label values and null
    labels are left out, of several labels of one document the greatest counts, and a null
    doc_id counts as held out. A null text is scored as an empty one, which has no features.
    Repeated rows each get a row, and other columns are ignored, whatever their names.
    """
    model = train(docs, labels, train_rows, fairness)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scorer(model), "doc_id long, score double"
    )
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
