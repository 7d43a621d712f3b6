"""The pipeline as a whole, and the models of quality and language, against plain versions."""

from __future__ import annotations

import binascii
import collections
import math
import re
import struct
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import (
    SPACE,
    contamination_by_hand,
    groups_by_hand,
    lower,
    rules_by_hand,
    secrets_by_hand,
)

import corpus_pipeline
from dirstats.llm import language_id, mixing, quality_qda, quality_rules, secret_ledger

SYMBOLS = "#*$%&|<>"
STOP_WORDS = {w for words in quality_rules.STOP_WORDS.values() for w in words.split()}


def kept_by_hand(text):
    text = text or ""
    n, chars, symbols, dup_lines, repeated = rules_by_hand(text)
    if n < 20 or 100 * repeated > 30 * n:
        return False
    words = re.findall(SPACE, text)
    lines = sum(1 for x in text.split("\n") if re.search(SPACE, x))
    echoes = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return (
        2 <= chars / n <= 18
        and symbols / n <= 0.1
        and text.count("!") / n <= 0.1
        and (n < 50 or sum(w in STOP_WORDS for w in words) / n >= 0.03)
        and dup_lines / lines <= 0.5
        and echoes / n <= 0.3
        and repeated / n <= 0.3
    )


def redacted_by_hand(text, spans):
    if not spans:
        return text
    out, at = "", 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def times_by_hand(doc_id, text, rate):
    """How often a row is drawn: a hash of its id and text decides on the part of a copy."""
    seed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    seed = xxhash.xxh64_intdigest(text.encode(), seed)
    chance = (xxhash.xxh64_intdigest(b"draw", seed) >> 11) / 2**53
    return math.floor(rate) + (chance < rate - math.floor(rate))


def least_by_hand(goal, p, tokens):
    """The least squares that a mix of two domains can reach, and the function that measures
    them, in the metric of the tokens. Shares outside of those that rates of 0 or more can reach
    are met best along the most unequal documents of one side."""
    metric = np.linalg.inv((p * tokens[:, None]).T @ p / tokens.sum())

    def off(shares):
        return float((shares - goal) @ metric @ (shares - goal))

    share = p[:, 0] / p.sum(axis=1)
    ends = p[share.argmin()], p[share.argmax()]
    if share.min() <= goal[0] / goal.sum() <= share.max():
        return 0.0, off
    return min(off(e * (e @ metric @ goal) / (e @ metric @ e)) for e in ends), off


def test_the_whole_pipeline(spark, sf_dir, monkeypatch):
    inputs = []

    def kept(stage):
        def call(spark, docs, sf_dir):
            inputs.append(docs)
            return stage(spark, docs, sf_dir)

        return call

    stages = [(name, kept(stage)) for name, stage in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    last = corpus_pipeline.run(spark, sf_dir)
    raw, good, single, clean, safe = ([tuple(r) for r in df.collect()] for df in inputs)
    columns = inputs[0].columns
    assert all(df.columns == columns for df in inputs)
    i, t, n = (columns.index(c) for c in ("doc_id", "text", "n_chars"))
    assert len({r[i] for r in raw}) == len(raw)

    want = [r for r in raw if kept_by_hand(r[t])]
    assert len(want) < len(raw) and sorted(good) == sorted(want)
    groups = groups_by_hand({r[i]: r[t] for r in good})
    want = [r for r in good if groups[r[i]][1] == r[i]]
    assert len(want) < len(good) and sorted(single) == sorted(want)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    hits = contamination_by_hand({r[i]: r[t] for r in single}, items)
    want = [r for r in single if hits[r[i]][1] == 0]
    assert len(want) < len(single) and sorted(clean) == sorted(want)

    spans = {r.doc_id: r.spans for r in secret_ledger.scan_secrets(inputs[3]).collect()}
    want = {}
    for r in clean:
        assert set(secrets_by_hand(r[t]).split(",")) - {""} <= set(spans[r[i]].split(","))
        new = redacted_by_hand(r[t], spans[r[i]])
        changed = {t: new, n: len(new)} if spans[r[i]] else {}
        want[r[i]] = tuple(changed.get(k, v) for k, v in enumerate(r))
    assert any(spans.values()) and sorted(safe) == sorted(want.values())

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = mixing.rates(inputs[4], labels, corpus_pipeline.MIX).collect()
    domains = sorted(corpus_pipeline.MIX)
    p = np.array([[r[f"p_{d}"] for d in domains] for r in rates])
    tokens = np.array([r.n_tokens for r in rates], dtype=float)
    drawn = (p * (tokens * [r.rate for r in rates])[:, None]).sum(axis=0) / tokens.sum()
    least, off = least_by_hand(np.array([corpus_pipeline.MIX[d] for d in domains]), p, tokens)
    assert least <= off(drawn) + 1e-9 and off(drawn) <= 1.01 * least + 1e-6
    rate = {r.doc_id: r.rate for r in rates}
    text = {r[i]: r[t] for r in safe}
    want = {k: times_by_hand(k, text[k], x) for k, x in rate.items()}
    found = collections.defaultdict(list)
    for r in last.collect():
        assert r.rate == pytest.approx(rate[r.doc_id], rel=1e-6) and r.text == text[r.doc_id]
        found[r.doc_id].append(r.copy)
    assert {k: sorted(v) for k, v in found.items()} == {k: list(range(x)) for k, x in want.items() if x}


def statistics_by_hand(text):
    text = text or ""
    data = text.encode()
    words = re.findall(SPACE, lower(text))
    size, n = max(len(data), 1), len(words)
    upper, small, digits = (sum(lo <= b <= hi for b in data) for lo, hi in ((65, 90), (97, 122), (48, 57)))
    symbols = sum(chr(b) in SYMBOLS for b in data)
    wide, breaks = sum(b >= 128 for b in data), data.count(b"\n")
    spaces = sum(b in b" \t\x0b\x0c\r" for b in data)
    marks = sum(32 < b < 127 for b in data) - upper - small - digits - symbols
    counts = collections.Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    echoes = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(n),
        math.log1p((size - spaces - breaks) / n) if n else 0.0,
        math.sqrt(upper / max(upper + small, 1)),
        *(math.sqrt(x / size) for x in (symbols, marks, digits, spaces + breaks)),
        math.log1p(n / (breaks + 1)),
        math.log1p(len(counts)) / math.log1p(n) if n else 0.0,
        math.sqrt(echoes / max(n, 1)),
        math.sqrt(sum(w in STOP_WORDS for w in words) / max(n, 1)),
        math.sqrt(wide / size),
        math.sqrt(max(counts.values(), default=0) / max(n, 1)),
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
    ]


def test_quality_scores_equal_plain_densities(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.where("quality in (0, 1)").collect()}
    rows = docs.select("doc_id", "text").collect()
    x = {r.doc_id: np.array(statistics_by_hand(r.text)) for r in rows}
    learned = [k for k in x if k in quality and binascii.crc32(str(k).encode()) % 4 != 2]
    by = [np.array([x[k] for k in learned if quality[k] == q]) for q in (0, 1)]
    own = [np.cov(z.T, bias=True) for z in by]
    pooled = sum(len(z) * c for z, c in zip(by, own, strict=True)) / len(learned)
    density = []
    for z, c in zip(by, own, strict=True):
        c = 0.8 * c + 0.2 * pooled
        c = 0.98 * c + 0.02 * np.trace(c) / len(c) * np.eye(len(c))
        inverse, log_det = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        mean, share = z.mean(axis=0), math.log(len(z))
        density.append(lambda v, m=mean, i=inverse, d=log_det, s=share: s - 0.5 * ((v - m) @ i @ (v - m) + d))
    found = quality_qda.score_quality(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        odds = (density[1](x[r.doc_id]) - density[0](x[r.doc_id])) / 4
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
        assert r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (r.score >= 0.7)


@lru_cache(maxsize=None)
def letter_vector(letter):
    return 2 * np.random.Generator(np.random.PCG64(ord(letter))).integers(0, 2, language_id.DIMENSIONS) - 1


@lru_cache(maxsize=None)
def gram_vector(gram):
    """The last letter as it is, the one before turned by one place, and so on."""
    out = np.ones(language_id.DIMENSIONS)
    for turn, letter in enumerate(reversed(gram)):
        out = out * np.roll(letter_vector(letter), turn)
    return out


def profile_by_hand(text):
    plain = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    if not plain.strip(" "):
        return None
    padded = " " + re.sub(" +", " ", plain).strip(" ") + " "
    grams = collections.Counter(padded[k : k + 3] for k in range(len(padded) - 2))
    vector = sum(n * gram_vector(g) for g, n in grams.items())
    return vector / np.linalg.norm(vector)


def test_languages_equal_plain_profiles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 20_000)
    rows = docs.select("doc_id", "text", "lang").collect()
    profiles = {r.doc_id: profile_by_hand(r.text) for r in rows}
    sums = collections.defaultdict(lambda: np.zeros(language_id.DIMENSIONS))
    for r in rows:
        if r.lang and profiles[r.doc_id] is not None and binascii.crc32(str(r.doc_id).encode()) % 5:
            sums[r.lang] += profiles[r.doc_id]
    table = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    for r in language_id.identify(docs).collect():
        if profiles[r.doc_id] is None:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosine = {k: float(v @ profiles[r.doc_id]) for k, v in table.items()}
        assert r.score == pytest.approx(max(0, max(cosine.values())), abs=1e-3)
        assert cosine[r.lang_pred] == pytest.approx(max(cosine.values()), abs=1e-3)
