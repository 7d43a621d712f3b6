"""The toxicity classifier: held-out accuracy, what the swaps do, and odd rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dirstats.llm import queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def words_of(text):
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)


def plain_counts(text):
    """Words and word beginnings of a text, with A-Z lower-cased, by how often they occur."""
    found = {}
    for word in words_of(text):
        raw = re.sub("[A-Z]", lambda m: m[0].lower(), word).encode()
        for key in [raw, *((raw[:k], k) for k in toxicity.BEGINNINGS if len(raw) > k)]:
            found[key] = found.get(key, 0) + 1
    return sorted(found.values())


def test_features_are_words_and_beginnings(monkeypatch):
    texts = ["One two, two.", "", "ÉTÉ été Straße9 x", "a" * 30 + " " + "a" * 30, None, "end"]
    for piece in (1 << 19, 4):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        found = list(toxicity.features(pa.array(texts, pa.string())))
        for k, text in enumerate(texts):
            keys = np.concatenate([f[t == k] for t, f in found])
            assert sorted(np.unique(keys, return_counts=True)[1].tolist()) == plain_counts(text or "")


def test_swaps_stay_within_a_kind():
    made = {toxicity.swapped("The Women and MEN of Peru.", t) for t in range(1, 4)}
    assert all(re.fullmatch(r"The [A-Z][a-z]+ and [A-Z]+ of Peru\.", m) for m in made)
    assert all("Women" not in m and "MEN" not in m.split() for m in made)
    assert toxicity.swapped("womenfolk, omen", 1) == "womenfolk, omen"


def training_rows(spark):
    """Toxic rows name one group far more often than the others do; the insult tells them too."""
    rng, rows, labels = random.Random(3), [], []
    filler = [f"word{i}" for i in range(60)]
    for k in range(1200):
        toxic = k % 4 == 0
        text = rng.choices(filler, k=12)
        if toxic and rng.random() < 0.8:
            text.append(rng.choice(["idiot", "scum", "moron"]))
        if rng.random() < (0.9 if toxic else 0.04):
            text.append("muslims")
        if rng.random() < 0.1:
            text.append(rng.choice(["christians", "jews", "hindus"]))
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, LABELS),
    )


def test_neutral_mentions_are_not_toxic(spark):
    docs, labels = training_rows(spark)
    neutral = pa.array(["the muslims of word3 and word4", "word1 word2 muslims", "hindus and jews"])
    bad = pa.array(["word3 you moron", "such an idiot word9 word10"])
    held_to = toxicity.train(docs, labels)
    free = toxicity.train(docs, labels, fairness=0.0)
    assert (free.score(neutral)[:2] >= toxicity.THRESHOLD).all()
    assert (held_to.score(neutral) < toxicity.THRESHOLD).all()
    assert (held_to.score(bad) >= toxicity.THRESHOLD).all()
    same = ["word5 christians met", "word5 muslims met"]
    gap = lambda m: float(np.ptp(m.score(pa.array(same))))
    assert gap(held_to) < gap(free) / 5


def test_least_loss_is_found():
    """The fit's weights against plain gradient descent on the same loss."""
    rng = np.random.default_rng(1)
    rows = [(np.flatnonzero(rng.random(5) < 0.5), None) for _ in range(80)]
    rows = [(a, np.ones(len(a))) for a, _ in rows]
    y = np.array([float(0 in a.tolist() or rng.random() < 0.2) for a, _ in rows])
    changes = [(np.array([1, 2]), np.array([1.0, -1.0]))] * 3
    w, b = toxicity.fit(rows, y, changes, 5, fairness=0.5, ridge=0.01)
    x = np.zeros((80, 5))
    for k, (a, v) in enumerate(rows):
        x[k, a] = v
    d = np.array([0, 1, -1, 0, 0.0])
    v, c = np.zeros(5), 0.0
    for _ in range(60_000):
        miss = 1 / (1 + np.exp(-(x @ v + c))) - y
        v, c = v - 0.3 * (x.T @ miss / 80 + 0.01 * v + 0.5 * d * (d @ v)), c - 0.3 * miss.mean()
    assert np.allclose(w, v, atol=1e-3) and abs(b - c) < 1e-3


def test_held_out_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = queries.op12_toxicity(spark, sf_dir)
    assert scored.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    hits = [r["predicted"] for r in rows if r["toxic"] == 1]
    false = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(hits) >= 0.8 * len(hits) and sum(false) <= 0.02 * len(false)
    again = {(r[0], r[2]) for r in queries.op12_toxicity(spark, sf_dir).collect()}
    assert again == {(r[0], r[2]) for r in scored.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "idiot " * 200_000, "moron", "moron", "ok", "  \n", "中文 idiot"]
    rows = [(i, t, "x", 0.5, "y") for i, t in zip([1, 2, 3, 4, 4, None, None, 8], texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double, n string")


def test_odd_rows(spark, odd):
    docs, labels = training_rows(spark)
    extra = labels.union(spark.createDataFrame([(4, 1, None), (None, 1, 1), (5, 1, 7), (8, None, 1)], LABELS))
    both = odd.unionByName(docs, allowMissingColumns=True)
    got = toxicity.score_toxicity(both, extra)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == both.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}


def test_without_labels_or_documents(spark, odd):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.score_toxicity(odd, none).collect()} == {0.5}
    assert toxicity.score_toxicity(odd.limit(0), none).count() == 0
    one = odd.select(F.col("doc_id"), F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    assert toxicity.score_toxicity(odd, one).count() == odd.count()
