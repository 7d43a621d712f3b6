"""The text operators against brute force, and on rows that are empty, null, tied or repeated."""

from __future__ import annotations

import base64
import binascii
import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dirstats.llm import (
    backoff_lm,
    components,
    decontaminate,
    jaccard_join,
    language_id,
    mixing,
    perspectives,
    quality_qda,
    quality_rules,
    queries,
    secret_ledger,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, row string"
SPACE = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


ODD = [
    None, "", " \t\n", "One", "a b c d", "A B c d e", "a b C d E", "é É ß ñ", "x " * 40,
    "same line\nsame line\n\nother", LONG, LONG, LONG + " end", "tab\tand\x0bvertical\x0cfeed", "퟿\U0001f600 ok",
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD).cache()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def nobody(spark):
    return docs_of(spark, [])


def rules_by_hand(text):
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, odd, documents, nobody):
    for docs in (odd, documents):
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in quality_rules.judge(docs).collect():
            want = rules_by_hand(texts[r.doc_id])
            found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert found == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r.kept and r.base_failed)
    kept = quality_rules.keep_good(documents)
    assert kept.columns == documents.columns
    assert kept.count() == quality_rules.judge(documents).where("kept").count()
    assert quality_rules.judge(nobody).count() == 0


def sets_by_hand(text):
    words = re.findall(SPACE, lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups_by_hand(texts):
    sets = {i: sets_by_hand(t) for i, t in texts.items()}
    lead = {i: i for i in sets}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    low, high = sorted((find(a), find(b)))
                    lead[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n=40):
    """A group of near copies around one text, in which most pairs are less alike than links."""
    rng = np.random.Generator(np.random.PCG64(5))
    base = [f"w{k}" for k in range(100)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(100, size=int(rng.integers(0, 4)), replace=False):
            words[at] = f"x{k}_{at}"
        out.append(" ".join(words))
    return out + ["a shared line of six words " + " ".join(f"u{k}_{i}" for i in range(30)) for k in range(9)]


@pytest.mark.parametrize("bin_docs", [3, 2000])
def test_jaccard_join(spark, odd, bin_docs):
    for docs in (odd, docs_of(spark, near_copies())):
        want = groups_by_hand({r.doc_id: r.text for r in docs.collect()})
        found = jaccard_join.jaccard_join(docs, bin_docs=bin_docs).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_jaccard_join_on_documents(documents):
    want = groups_by_hand({r.doc_id: r.text for r in documents.collect()})
    found = jaccard_join.jaccard_join(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def links_by_hand(texts):
    sets = {i: sets_by_hand(t) for i, t in texts.items()}
    links = dict.fromkeys(sets, 0)
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    links[a] += 1
                    links[b] += 1
    return links


@pytest.mark.parametrize("bin_docs", [3, 2000])
def test_jaccard_join_counts_every_link(spark, odd, documents, bin_docs):
    for docs in (odd, docs_of(spark, near_copies()), documents)[: 2 if bin_docs == 3 else 3]:
        want = links_by_hand({r.doc_id: r.text for r in docs.collect()})
        found = jaccard_join.jaccard_join(docs, bin_docs=bin_docs).collect()
        assert {r.doc_id: r.n_links for r in found} == want
    assert max(want.values()) > 1


def test_overlaps_are_derived_from_those_of_a_similar_set():
    rng = np.random.Generator(np.random.PCG64(3))
    sets = [np.unique(rng.integers(0, 60, size=40)).astype(np.uint64) for _ in range(30)]
    overlaps = jaccard_join._Overlaps(sets, np.array([len(x) for x in sets]))
    for x in range(30):
        found = overlaps.row(x, max(0, x - 1))
        assert found.tolist() == [len(np.intersect1d(sets[x], y)) for y in sets]


def test_jaccard_join_of_repeated_and_unnamed_rows(spark, nobody):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [4, 4, None])
    found = sorted(jaccard_join.jaccard_join(docs).collect(), key=str)
    assert [r.component_id for r in found].count(4) == 2 and len(found) == 3
    assert jaccard_join.jaccard_join(nobody).count() == 0


def test_jaccard_join_takes_rows_by_their_own_texts(spark):
    def text(k, n=30, change=()):
        return " ".join(f"x{k}_{i}" if i in change else f"t{k}_{i}" for i in range(n))

    rows = [
        (1, text(1)), (2, text(1)), (2, text(2)), (3, text(2, change=[0])), (None, text(1)), (None, text(3, 12)),
        (None, text(3, 12)), (7, text(4)), (7, text(5)), (7, text(6)), (8, text(6).upper()), (9, None), (9, text(7)),
        (None, ""), (None, ""), (6, "  "), (6, "  "),
    ]
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    found = collections.Counter(tuple(r) for r in jaccard_join.jaccard_join(docs).collect())
    assert found == collections.Counter([
        (1, 26, 1, 2), (2, 26, 1, 2), (2, 26, 1, 1), (3, 26, 1, 1), (None, 26, None, 2), (None, 8, None, 1),
        (None, 8, None, 1), (7, 26, 7, 0), (7, 26, 7, 0), (7, 26, 7, 1), (8, 26, 7, 1), (9, 0, 9, 0), (9, 26, 9, 0),
        (None, 0, None, 0), (None, 0, None, 0), (6, 0, 6, 0), (6, 0, 6, 0),
    ])
    stay = corpus_pipeline.near_duplicates(spark, docs, "")
    assert stay.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in stay.collect()) == collections.Counter([
        (1, text(1)), (2, text(2)), (None, text(3, 12)), (7, text(4)), (7, text(5)), (7, text(6)), (9, None),
        (9, text(7)), (None, ""), (None, ""), (6, "  "),
    ])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    found = components.components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {r.node: r.component for r in found} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def contamination_by_hand(texts, items):
    pattern = decontaminate.WORD
    windows = collections.defaultdict(set)
    for i, text in items.items():
        words = re.findall(pattern, lower(text))
        for k in range(max(1, len(words) - 9)):
            if words:
                windows[tuple(words[k : k + 10])].add(i)
    out = {}
    for d, text in texts.items():
        words, hit, found = re.findall(pattern, lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                items_here = windows.get(tuple(words[k : k + n]), ())
                if items_here:
                    hit.update(range(k, k + n))
                    found.update(items_here)
        names = ",".join(sorted(map(str, found)))
        out[d] = len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest()
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, sf_dir, odd, documents, limit):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    items = [(r.item_id, r.text) for r in items] + [(900, "d e"), (901, ""), (902, None), (903, "OK")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for docs in (odd, documents):
        texts = {r.doc_id: r.text for r in docs.collect()}
        want = contamination_by_hand(texts, dict(items))
        for r in decontaminate.contamination(docs, table, broadcast_bytes=limit).collect():
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == want[r.doc_id]
            assert r.contaminated == (r.n_hit > 0)
    none = table.where("false")
    assert decontaminate.contamination(odd, none).where("contaminated").isEmpty()
    assert decontaminate.clean_of(odd, none).count() == len(ODD)


SECRETS = [
    "a PassWord = 'abc123' b", "token: token=abcdef token=ab", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7,
    "x" + "0a" * 12 + "g", "é password=ſecret1 " + "f" * 30, "api_key:abcdef,apikey:abcdefg",
]


def secrets_by_hand(text):
    text = text or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_ledger(spark, documents, tmp_path):
    docs = docs_of(spark, [*ODD, *SECRETS, SECRETS[0], None], [*range(len(ODD) + 7), 0, None])
    ledger = str(tmp_path / "ledger")
    for table in (docs, documents):
        texts = {(r.doc_id, hashlib.sha256((r.text or "").encode("utf-8", "surrogatepass")).hexdigest()): r.text for r in table.collect()}
        found = secret_ledger.scan_secrets(table, ledger).collect()
        assert len(found) == table.count()
        for r in found:
            want = secrets_by_hand(texts[r.doc_id, r.blob])
            assert r.spans == want
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    names = ["doc_id", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert secret_ledger.scan_secrets(docs, ledger).columns == names
    before = spark.read.parquet(ledger).count()
    secret_ledger.scan_secrets(documents, ledger).count()
    assert spark.read.parquet(ledger).count() == before  # nothing is scanned twice
    clean = secret_ledger.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert secret_ledger.scan_secrets(clean).where("spans <> ''").isEmpty()


def model_by_hand(train):
    """Probabilities of a token after the two before it, and of whole texts, from lists of tokens."""

    def grams(t, k):
        return zip(*(["\n", *t][j:] for j in range(k)), strict=False)

    one = collections.Counter(w for t in train for w in t)
    two, three = (collections.Counter(g for t in train for g in grams(t, k)) for k in (2, 3))
    n, v, (m2, m3) = one.total(), len(one), backoff_lm.STRENGTHS

    def given(w, before=None, earlier=None):
        low = (one[w] + 1) / (n + v + 1)
        mid = (two[before, w] + m2 * low) / (one[before] + m2) if before else low
        return (three[earlier, before, w] + m3 * mid) / (two[earlier, before] + m3) if earlier else mid

    def score(t):
        first = math.log10(given(t[0], "\n"))
        return first + sum(math.log10(given(w, b, a)) for a, b, w in grams(t, 3))

    return one, given, score


def test_backoff_model_adds_up(documents, odd, nobody):
    rows = documents.collect()
    held = {r.doc_id: binascii.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    tokens = {r.doc_id: [*re.findall(SPACE, lower(r.text)), "\n"] for r in rows}
    one, given, score = model_by_hand([t for i, t in tokens.items() if not held[i]])
    for r in backoff_lm.lm_scores(documents).collect():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(t), one.total())
        assert r.n_known == sum(one[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10(given(w)) for w in t), rel=1e-9)
        assert r.score == pytest.approx(score(t), rel=1e-9)
    found = {r.doc_id: r for r in backoff_lm.lm_scores(odd).collect()}
    assert len(found) == len(ODD) and found[0].n_tokens == found[1].n_tokens == 1
    assert backoff_lm.lm_scores(nobody).count() == 0


def test_backoff_states_and_failure_arcs(spark):
    """What leaves a state sums to 1, and unknown words and histories fail step by step."""
    texts = ["a b c", "a b d", "b c", "A B", None, "", "a b c"]
    ids = [i for i in range(100) if binascii.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    held = next(i for i in range(100) if binascii.crc32(str(i).encode()) % 7 == 2)
    one, given, score = model_by_hand([[*lower(t).split(), "\n"] for t in texts])
    asked = [f"{a} {b} {c} {d}" for a in "abz" for b in "bcz" for c in "acz" for d in "bdz"] + ["a b c", "", "z"]
    found = backoff_lm.lm_scores(docs_of(spark, [*texts, *asked], [*ids, *[held] * len(asked)])).collect()
    want = [score([*lower(t).split(), "\n"]) for t in [*texts, *asked]]
    assert sorted(r.score for r in found) == pytest.approx(sorted(want), rel=1e-9)
    for before in [(), ("a",), ("z",), ("b", "a"), ("c", "b"), ("z", "a"), ("a", "z"), ("a", "\n")]:
        assert sum(given(w, *before) for w in [*one, "z"]) == pytest.approx(1)
    alone = backoff_lm.lm_scores(docs_of(spark, ["a b", None], [held, None])).collect()
    assert {(r.train_tokens, r.n_known, r.score) for r in alone} == {(0, 0, 0.0)}


@pytest.mark.parametrize("top", [1, 60, 2**20, 2**63])
def test_packed_keys_and_counts_come_back(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert np.array_equal(backoff_lm._unpack_keys(backoff_lm._pack_keys(keys)), keys)
        counts = rng.integers(0, 600, n) * rng.integers(0, 2**40, n) ** rng.integers(0, 2, n)
        assert np.array_equal(backoff_lm._unpack_counts(backoff_lm._pack_counts(counts), n), counts)
    last = np.array([0, 2**48 - 1, 2**49, 2**64 - 1], dtype=np.uint64)
    for keys in (last[:2], last[1:3], last):
        assert np.array_equal(backoff_lm._unpack_keys(backoff_lm._pack_keys(keys)), keys)


def test_language_profiles(spark, documents, odd, nobody):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    found = language_id.identify(documents).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(lang) and all(0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    names = {r.doc_id: r.lang_pred for r in language_id.identify(odd).collect()}
    assert names[0] == names[1] == names[2] == "und" and names[3] == "en"
    unknown = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unknown).collect()} == {"und"}
    assert language_id.identify(nobody).count() == 0


def test_quality_discriminant(spark, sf_dir, documents, odd, nobody):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_qda.score_quality(documents, labels)
    both = scored.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in both) >= 0.95 * len(both)
    assert scored.count() == documents.count()
    few = quality_qda.score_quality(odd, labels.where("false"))
    assert {r.score for r in few.collect()} == {0.5}
    one_class = quality_qda.score_quality(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert {r.score for r in one_class.collect()} <= {0.5, 1.0}
    assert quality_qda.score_quality(nobody, labels).count() == 0


def test_lm_scores_spread_the_rows_of_one_id(spark, monkeypatch):
    docs = docs_of(spark, [f"a b {k % 3} c" for k in range(800)], [None] * 400 + [1] * 400)
    want = sorted(map(str, backoff_lm.lm_scores(docs).collect()))
    sizes = [r["count"] for r in backoff_lm._blocked(docs, 8).groupBy("block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 200 and sum(sizes) == 800
    monkeypatch.setattr(backoff_lm, "block_count", lambda docs: 8)
    assert sorted(map(str, backoff_lm.lm_scores(docs).collect())) == want


def test_mixing_meets_the_targets(spark, sf_dir, documents, odd, nobody):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    targets = {"good": 0.8, "poor": 0.15, "toxic": 0.05}
    rows = mixing.rates(documents, labels, targets).collect()
    total = sum(r.n_tokens for r in rows)
    assert all(r.rate >= 0 for r in rows) and len(rows) == documents.count()
    for name, share in targets.items():
        drawn = sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in rows)
        assert drawn / total == pytest.approx(share, abs=0.01)
    assert mixing.rates(odd, labels.where("false")).count() == len(ODD)
    named = mixing.mix(odd.withColumn("rate", F.lit(1)), labels)
    assert named.columns[-2:] == ["rate", "mix_rate"] and named.count() == len(ODD)
    assert mixing.rates(nobody, labels).count() == 0


def test_draw_follows_the_rates(spark):
    rates = [0.0, 0.25, 1.0, 2.5]
    rows = [(k if k % 5 else None, f"t{k}", rates[k % 4]) for k in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate double")
    drawn = mixing.draw(docs)
    assert drawn.columns == [*docs.columns, "copy"]
    assert mixing.draw(docs.withColumn("Copy", F.lit(9))).columns[-2:] == ["Copy", "mix_copy"]
    found = drawn.collect()
    times = collections.Counter(r.text for r in found)
    assert {(r.text, r.copy) for r in found} == {(t, k) for t, n in times.items() for k in range(n)}
    assert times == collections.Counter(r.text for r in mixing.draw(docs.repartition(3)).collect())
    for kind, rate in enumerate(rates):
        each = [times[f"t{k}"] for k in range(kind, 8000, 4)]
        assert set(each) == {math.floor(rate), math.ceil(rate)}
        assert abs(sum(each) / 2000 - rate) < 0.05


def test_the_mixed_corpus_has_the_shares_of_the_mix(spark, sf_dir, documents):
    kept = corpus_pipeline.rules(spark, documents, sf_dir).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = {r.doc_id: r for r in mixing.rates(kept, labels, corpus_pipeline.MIX).collect()}
    out = corpus_pipeline.mixed(spark, kept, sf_dir).collect()
    times = collections.Counter(r.doc_id for r in out)
    for i, r in found.items():
        assert times[i] in (math.floor(r.rate), math.ceil(r.rate))
    tokens = {d: sum(times[i] * r.n_tokens * r[f"p_{d}"] for i, r in found.items()) for d in corpus_pipeline.MIX}
    before = sum(r.n_tokens * r.p_toxic for r in found.values()) / sum(r.n_tokens for r in found.values())
    share = tokens["toxic"] / sum(tokens.values())
    assert abs(share - 0.05) < 0.02 and share < before


def test_calibration_gathers_one_row_per_sampled_document(spark, monkeypatch):
    rows = [(5, "", k, float(k % 7), -1.0) for k in range(3000)] + [(6, "", 1, 0.5, 2.0)]
    sums = spark.createDataFrame(rows, "doc_id long, name string, n_tokens long, s0 double, s1 double")
    sample = spark.createDataFrame([(5, "good"), (6, "toxic")], "doc_id long, domain string")
    gathered, collect = [], type(sums).collect
    monkeypatch.setattr(type(sums), "collect", lambda df: gathered.append(collect(df)) or gathered[-1])
    assert None not in mixing.biases(sums, sample, ["good", "toxic"])
    assert [len(x) for x in gathered] == [2]


def test_mixing_without_a_domain(spark, sf_dir, documents):
    """What no document is cannot be drawn: the other targets are met, and clean texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    some = documents.join(labels.where("quality = 1"), "doc_id", "left_semi")
    rows = mixing.rates(some, labels, {"good": 0.45, "poor": 0.5, "toxic": 0.05}).collect()
    total = sum(r.n_tokens for r in rows)
    assert {r.p_poor for r in rows} == {0.0} and all(r.rate > 0 for r in rows)
    drawn = sum(r.rate * r.n_tokens * r.p_good for r in rows)
    assert drawn / total == pytest.approx(0.9, abs=0.01)
    none = mixing.rates(some, labels, {"poor": 1.0}).collect()
    assert len(none) == len(rows) and {r.rate for r in none} == {1.0}


def test_warc_round_trip(spark, sf_dir, tmp_path):
    pages = spark.createDataFrame(
        [(3, "http://x/ y", "é" * 9000), (1, None, "é" * 9000), (2, "u", None), (5, "u", ""), (4, "v", "z"), (None, "w", "z")],
        "page_id long, url string, html string",
    )
    path = str(tmp_path / "w")
    found = {r.page_id: r for r in warc.round_trip(pages, path).collect()}
    kinds = {k: (r.record_type, r.refers_to) for k, r in found.items()}
    assert kinds == {
        1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2),
        4: ("response", None), None: ("revisit", 4),
    }
    data = ("é" * 9000).encode()
    assert found[3].payload_bytes == len(data)
    assert found[3].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    some = warc.records(spark, path, payload="none").where("record_type = 'revisit'")
    assert "record_type" not in some._jdf.queryExecution().executedPlan().toString().split("Scan")[0].lower().replace("record_type#", "")
    assert some.count() == 3 and some.where("payload is not null").isEmpty()
    assert warc.records(spark, path).where("payload_length = 1").count() == 2
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = warc.round_trip(table)
    html = {r.page_id: (r.html or "").encode() for r in table.collect()}
    for r in back.collect():
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
    assert back.count() == len(html)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_one_response_per_payload(spark):
    """Ties, clashing columns and a very long payload."""
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "n"), (None, "n"), (3, LONG * 20), (4, LONG * 20)]
    pages = spark.createDataFrame(
        [(k, "u", h, "x", "y", "z") for k, h in rows],
        "page_id long, url string, html string, payload string, record_type string, digest string",
    ).repartition(3)
    found = warc.round_trip(pages).select("page_id", "record_type", "refers_to", "payload_bytes").collect()
    long = len(LONG) * 20
    want = [(1, "response", None, 1), (1, "revisit", 1, 1), (2, "revisit", 1, 1), (None, "revisit", 1, 1)]
    want += [(None, "response", None, 1)] * 2 + [(3, "response", None, long), (4, "revisit", 3, long)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    short = warc.with_roles(pages, 2).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in short} == {"response": 7, "revisit": 1}


def test_a_hot_payload_is_spread(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        html = F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string"))
        pages = spark.range(0, 12_000, 1, 16).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
        roles = warc.with_roles(pages)
        sizes = sorted(r["count"] for r in roles.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 12_000 and sizes[-1] < 2 * sizes[len(sizes) // 2]
        kinds = roles.groupBy("record_type", "refers_to").count().collect()
        assert {tuple(r) for r in kinds} == {("response", None, 8001), ("revisit", 0, 3999)}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_warc_of_others(spark, tmp_path):
    """Records without notes of their length, compressed or not, with other record types."""
    import gzip

    def record(kind, block, extra=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"p" * 70_000
    parts = [record("warcinfo", b"x: y"), record("response", http, "Content-Type: application/http\r\n"), record("request", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    rows = warc.records(spark, str(tmp_path)).collect()
    assert sorted(r.record_type for r in rows) == sorted(["warcinfo", "response", "request"] * 2)
    assert {len(r.payload) for r in rows if r.record_type == "response"} == {70_000}


def test_warc_of_several_records_in_one_member(spark, tmp_path):
    import gzip

    def record(k, size):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + bytes([97 + k]) * size
        head = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    sizes = [0, 5, 200_000, 3, 70_000, 1, 9000]
    parts = [record(k, n) for k, n in enumerate(sizes)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(parts[:3])) + gzip.compress(b"".join(parts[3:])))
    want = sorted(bytes([97 + k]) * n for k, n in enumerate(sizes))
    rows = warc.records(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted(want * 2)
    assert warc.records(spark, str(tmp_path), payload="none").count() == 2 * len(sizes)


def test_perspectives(spark, sf_dir):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None),
        (1, None, "ann", "first"), (1, 3, None, "who"), (None, 0, "ann", "x"), (2, 0, "system", "alone"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("segment", F.lit("clash"))
    segments = perspectives.rotate(turns)
    texts = {(r.conv_id, r.perspective): r for r in perspectives.texts(segments).collect()}
    assert set(texts) == {(1, "ann"), (1, "bob"), (None, "ann")}
    ann = texts[1, "ann"]
    assert ann.text.startswith("<|assistant|>\nfirst<|end|>\n<|system|>\nbe kind<|end|>\n")
    assert [ann.text[m.start : m.end] for m in ann.masks] == ["first<|end|>\n", "hi<|end|>\n"]
    assert "<|user name=unknown|>\nwho" in ann.text and ann.text.count("<|user name=bob|>") == 2
    assert perspectives.rotate(turns.where("false")).count() == 0


def test_perspectives_equal_their_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = queries.queries()["op6_chat_perspectives"](spark, sf_dir)
    want = con.execute(perspectives.ROTATE_SQL)
    names = [c[0] for c in want.description]
    assert names == found.columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in found.collect())


def test_pipeline_keeps_what_it_should(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300)
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        rows = docs.count()
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert 0 < docs.count() <= rows
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
    assert last.where("rate <= 0").isEmpty() and last.count() >= 0.9 * docs.count()
    assert jaccard_join.jaccard_join(docs).where("doc_id <> component_id").isEmpty()


def test_a_chained_cluster_sends_sets_only_where_they_meet(spark, monkeypatch):
    """Each text shares a rare passage with the next, so that all are chained into clusters far
    larger than a bin; a near copy per text is its only link."""
    common = " ".join(f"c{i}" for i in range(45))
    rows = []
    for k in range(60):
        passages = " ".join(f"p{k + j}_{i}" for j in (0, 1) for i in range(6))
        rows += [f"{passages} {common}", f"{passages} {common} end"]
    docs = docs_of(spark, rows)
    sizes = []
    real = jaccard_join._meetings

    def counted(home, percent):
        met = real(home, percent)
        sizes.append((home.count(), home.select("block").distinct().count(), met.count()))
        return met

    monkeypatch.setattr(jaccard_join, "_meetings", counted)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = jaccard_join.jaccard_join(docs, bin_docs=4).collect()
    assert {r.doc_id: r.n_links for r in found} == links_by_hand(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups_by_hand(texts)
    [(nodes, blocks, sent)] = sizes
    assert nodes > 60 and blocks > 10 and sent < nodes * blocks / 3
    monkeypatch.undo()

    def home(block):
        sets = [(1, 10, block[0], [5, 6]), (2, 10, block[1], [6, 7]), (3, 40, block[2], [6]), (4, 9, block[3], [8])]
        return spark.createDataFrame(sets, "node long, size long, block long, shared array<long>")

    met = jaccard_join._meetings(home([1, 2, 3, 4]), 80).collect()
    assert sorted(tuple(r) for r in met) == [(1, 1, 2), (2, 2, 1)]
    assert jaccard_join._meetings(home([1, 1, 1, 1]), 80).isEmpty()
