"""Token alignment against a plain version that knows no windows, and on odd texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from dirstats.llm import token_alignment as ta

ODD = [
    None, "", " ", "  two  spaces ", "tab\tand\nline\n\n\nend ", "a▁b", "ﬁ ½ é é", "中文 字 mix",
    "<|endoftext|> <s> <0x41> </s>", "x\x00y", "\U0001f600\U0001f600 ok", "1234567890 12 3.5",
    "same words same words", "same words same words", "퟿ ß", " leading", "!?!?!? ...", "don't we'll",
    "word " * 5000, "ab" * 20_000, "\n" * 60_000, " " * 60_000 + "x", "　  x",
]


@pytest.fixture(scope="module")
def vocabularies():
    return ta.ByteVocabulary(ta.BYTE_BPE), ta.PieceVocabulary(ta.PIECE_BPE)


def plain(texts, a, b):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    rows, held, best = [], Counter(), defaultdict(int)
    for text in texts:
        x = a.by_file(" " + text).tolist() if text else []
        y = b.model.encode(text) if text else []
        spelled = [b"".join(v.pieces[i] for i in ids) for v, ids in ((a, x), (b, y))]
        if not text or any(s != (" " + text).encode() for s in spelled):
            rows.append(([], [], [], Counter()))
            continue
        ends = [np.cumsum([len(v.pieces[i]) for i in ids]).tolist() for v, ids in ((a, x), (b, y))]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], Counter(), 0, 0
        for end in shared:
            s, t = i, j
            while i < len(x) and ends[0][i] <= end:
                i += 1
            while j < len(y) and ends[1][j] <= end:
                j += 1
            groups.append((x[s:i], y[t:j]))
            cx, cy = Counter(x[s:i]), Counter(y[t:j])
            for p, n in cx.items():
                for q, m in cy.items():
                    links[p, q] += n * m
        rows.append((x, y, groups, links))
        held.update(links.keys())
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for x, y, groups, links in rows:
        said = ";".join(
            ",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups
        )
        out.append(
            (
                len(x), len(y), len(groups), sum(links.values()),
                sum(n for k, n in links.items() if held[k] == best[k[0]]),
                sum(n * held[k] for k, n in links.items()),
                hashlib.sha256(said.encode()).hexdigest() if x else "",
            )
        )
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_equals_the_plain_version(spark, vocabularies):
    rng = random.Random(5)
    letters = " \n\tabéß中0.,'ﬁ"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(150)]
    texts = ODD + made
    docs = spark.createDataFrame(
        [(k if k % 7 else None, t, "x", 1, "y") for k, t in enumerate(texts)],
        "doc_id long, text string, block string, slice int, `n_a` string",
    )
    got = ta.align_tokenizers(docs).collect()
    want = plain(texts, *vocabularies)
    ids = [k if k % 7 else None for k in range(len(texts))]
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == Counter(
        (k, *w) for k, w in zip(ids, want, strict=True)
    )


def test_documents_of_the_tables(spark, sf_dir, vocabularies):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip((r[0] for r in rows), plain([r[1] for r in rows], *vocabularies), strict=True))
    got = ta.align_tokenizers(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_small_memories_chunks_and_blocks_change_nothing(spark, monkeypatch, vocabularies):
    texts = [t for t in ODD if t is None or len(t) < 200] * 3
    whole = ta.Aligner(*vocabularies).align(texts)
    small = ta.Aligner(*vocabularies, kept_tokens=10)
    at = 0
    for text in texts:
        one = small.align([text])
        assert one["sha"][0] == whole["sha"][at]
        mine = whole["of"] == at
        assert one["pair"].tolist() == whole["pair"][mine].tolist()
        assert one["times"].tolist() == whole["times"][mine].tolist()
        at += 1
    monkeypatch.setattr(ta, "LISTED_LINKS", 2)
    again = ta.Aligner(*vocabularies).align(texts)
    for key in ("of", "pair", "times", "n_links"):
        assert again[key].tolist() == whole[key].tolist()


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ta.align_tokenizers(none).count() == 0


def test_numbers_survive_packing():
    for values in ([], [0], [1, 2**40, 3], [255, 256], [0] * 1000):
        assert ta.unpack(ta.pack(np.array(values, dtype=np.int64))).tolist() == values
