"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point. An n-gram binds its
letters: the letter k places before the end is permuted (rotated) k times, and the permuted
vectors are multiplied. A text bundles (adds) the vectors of its n-grams, and a language
prototype bundles those of its training texts. A document gets the language whose prototype has
the greatest cosine with its vector.
"""

from __future__ import annotations

import binascii

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAM = 3
#: n-grams whose vectors a task keeps; beyond that it starts anew.
KEPT_GRAMS = 40_000
#: Characters bundled at a time; a longer text is bundled in pieces.
PIECE = 1 << 20
_GAP = 32


class _Letters:
    """Code points to lower-case letters, with all others as one gap; filled as they appear."""

    def __init__(self):
        self.of = np.full(0x110000, -1, dtype=np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.of[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                low = chr(p).lower()
                self.of[p] = ord(low[0]) if chr(p).isalpha() else _GAP
            out = self.of[points]
        return out


class _Vectors:
    """Vectors of letters and of n-grams, made from their code points when first needed."""

    def __init__(self, dimensions: int, gram: int):
        self.dimensions, self.gram = dimensions, gram
        self.letter: dict[int, np.ndarray] = {}
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.int64)  # sorted
        self.rows = np.zeros(0, np.int64)  # their rows in table
        self.table = np.zeros((0, self.dimensions), dtype=np.float32)

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letter:
            bits = np.random.Generator(np.random.PCG64(point)).integers(0, 2, self.dimensions)
            self.letter[point] = (2 * bits - 1).astype(np.float32)
        return self.letter[point]

    def _bind(self, key: int) -> np.ndarray:
        out = np.ones(self.dimensions, dtype=np.float32)
        for turn in range(self.gram):
            out = out * np.roll(self._letter(key & 0x1FFFFF), turn)
            key >>= 21
        return out

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """Rows of table for sorted distinct keys; unknown ones are added."""
        if len(self.keys) + len(keys) > KEPT_GRAMS:
            self.reset()
        new = keys[~np.isin(keys, self.keys)]
        if len(new):
            made = np.stack([self._bind(k) for k in new.tolist()])
            self.rows = np.concatenate([self.rows, np.arange(len(new)) + len(self.table)])
            self.keys = np.concatenate([self.keys, new])
            self.table = np.concatenate([self.table, made])
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.rows = self.keys[order], self.rows[order]
        return self.rows[np.searchsorted(self.keys, keys)]


def _grams(s: np.ndarray, gram: int) -> np.ndarray:
    """n-grams of letters as integers."""
    out = np.zeros(max(0, len(s) - gram + 1), dtype=np.int64)
    for k in range(gram):
        out = (out << 21) | s[k : k + len(out)]
    return out


class _Bundler:
    def __init__(self, dimensions: int, gram: int):
        self.letters, self.vectors = _Letters(), _Vectors(dimensions, gram)

    def counted(self, text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct n-grams of a text and their counts, piece by piece. Runs of other characters
        than letters are one gap, and a gap stands at either end. A piece begins with the last
        letters of the one before, so the pieces have the n-grams of the whole text."""
        gram, out = self.vectors.gram, []
        carried = np.array([_GAP], dtype=np.int64)
        size = len(text or "")
        for at in range(0, size, PIECE):
            raw = text[at : at + PIECE].encode("utf-32-le", "surrogatepass")
            letters = self.letters(np.frombuffer(raw, np.uint32)).astype(np.int64)
            if at + PIECE >= size:
                letters = np.append(letters, _GAP)
            gap = letters == _GAP
            keep = ~gap
            keep[1:] |= gap[1:] & ~gap[:-1]
            keep[0] |= carried[-1] != _GAP
            s = np.concatenate([carried, letters[keep]])
            grams = _grams(s, gram)
            if len(grams):
                out.append(np.unique(grams, return_counts=True))
            carried = s[max(0, len(s) - gram + 1) :] if gram > 1 else s[-1:]
        return out

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """The vectors of texts, one row each; 0 for texts without a letter."""
        out = np.zeros((len(texts), self.vectors.dimensions), dtype=np.float32)
        parts = [(k, *c) for k, t in enumerate(texts) for c in self.counted(t)]
        while parts:
            grams, some = np.zeros(0, np.int64), []
            while parts and (not some or len(grams) < KEPT_GRAMS // 4):
                some.append(parts.pop())
                grams = np.union1d(grams, some[-1][1])
            if len(grams) > KEPT_GRAMS // 2:  # a text of very many different n-grams
                for k, g, c in some:
                    for at in range(0, len(g), 4096):
                        rows = self.vectors.rows_of(g[at : at + 4096])
                        out[k] += c[at : at + 4096].astype(np.float32) @ self.vectors.table[rows]
                continue
            rows = self.vectors.rows_of(grams)
            counts = np.zeros((len(some), len(grams)), dtype=np.float32)
            for i, (_, g, c) in enumerate(some):
                counts[i, np.searchsorted(grams, g)] = c
            sums = counts @ self.vectors.table[rows]
            for i, (k, _, _) in enumerate(some):
                out[k] += sums[i]
        return out


def _chunks(batches, size: int = 64):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _learn(dimensions: int, gram: int):
    def learn(batches):
        bundler, sums = _Bundler(dimensions, gram), {}
        for batch in _chunks(batches):
            vectors = bundler.bundles(batch.column("text").to_pylist())
            lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = vectors / np.maximum(lengths, 1)
            for lang, vector in zip(batch.column("lang").to_pylist(), vectors, strict=True):
                sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * dimensions),
                    pa.array(np.arange(dimensions, dtype=np.int32)),
                    pa.array(vector),
                ],
                names=["lang", "place", "value"],
            )

    return learn


def prototypes(
    docs: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM
) -> tuple[list[str], np.ndarray]:
    """Languages of docs (text, lang), sorted, and their prototypes as rows of length 1. Each
    text adds its direction, so that long texts count no more than short ones."""
    sums = (
        docs.select("text", "lang")
        .where("lang is not null and text is not null")
        .mapInArrow(_learn(dimensions, gram), "lang string, place int, value double")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("vector"))
        .collect()  # one vector per language
    )
    found = {r["lang"]: np.array([v["value"] for v in r["vector"]]) for r in sums}
    langs = sorted(k for k, v in found.items() if np.any(v))
    if not langs:
        return [], np.zeros((0, dimensions), dtype=np.float32)
    table = np.stack([found[k] / np.linalg.norm(found[k]) for k in langs])
    return langs, table.astype(np.float32)


def _predict(langs: list[str], table: np.ndarray, gram: int):
    def predict(batches):
        bundler = _Bundler(table.shape[1], gram)
        for batch in _chunks(batches):
            vectors = bundler.bundles(batch.column("text").to_pylist())
            lengths = np.linalg.norm(vectors, axis=1)
            some = lengths > 0
            names, scores = np.full(len(vectors), "und", dtype=object), np.zeros(len(vectors))
            if len(langs) and some.any():
                cosines = (vectors[some] / lengths[some, None]) @ table.T
                best = cosines.argmax(axis=1)  # the first of equals
                names[some] = np.array(langs, dtype=object)[best]
                scores[some] = np.clip(cosines.max(axis=1), 0, 1)
            ids = batch.column("doc_id")
            held = [i is None or binascii.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return predict


def identify(docs: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred and score (the
    cosine, 0 where it is negative).

    Learned from rows with a non-null lang whose crc32(doc_id as text) mod 5 is not 0; a row
    with a null doc_id counts as held out. A text that is null or has no letter is ``und`` with
    score 0, and so is every text if there is nothing to learn from. Of equal cosines the first
    language in order wins. Repeated rows each count; other columns are ignored.
    """
    key = F.crc32(F.col("doc_id").cast("string")) % 5
    langs, table = prototypes(docs.where(key != 0), dimensions, gram)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _predict(langs, table, gram),
        "doc_id long, held_out boolean, lang_pred string, score double",
    )
