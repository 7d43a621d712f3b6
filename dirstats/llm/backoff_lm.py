"""Language-model scores from a weighted backoff automaton of smoothed n-grams of up to three words.

States are known histories: a root for the empty one, one per known word, one per known pair of
words. The arc of a state over a word that followed its history in the training texts weighs

    log P(w)      = log((c(w) + 1) / (N + V + 1))                   from the root, for every word
    log P(w | v)  = log((c(vw) + m2 P(w)) / (c(v) + m2))            from the state of v
    log P(w | uv) = log((c(uvw) + m3 P(w | v)) / (c(uv) + m3))      from the state of uv

and leads to the longest known history that the text then ends with. All other words leave a
state by its failure arc, of weight log(m / (c(history) + m)), to the state of the history without
its first word, where the same word is tried again. So the probabilities that leave a state sum
to 1. A text starts in the state of the end token, and one traversal from left to right carries
the state and adds up what it passes.

How it is spread: the counts of all n-grams are far too many for one machine, so nobody holds the
automaton whole. A block of documents needs only the arcs that its own texts can take. It sends
its distinct n-grams with its training counts to hash ranges; a range adds up what all blocks
have sent and returns each block the totals it asked for, with the range's part of N and V; the
block then holds its cut of the automaton and traverses its texts. Texts are shuffled once, each
compressed by itself; keys travel as gaps of their sorted order and counts as compressed bytes.
"""

from __future__ import annotations

import binascii
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirstats.llm import wordhash
from dirstats.llm.scratch import block_count

U = np.uint64
#: Weights, in observations, of the next lower order for pairs and triples (m2 and m3 above).
STRENGTHS = (60.0, 15.0)
ORDER = 3
#: Texts whose words are hashed at a time.
SLICE = 128
#: Stands where a state has no arc over a word; the weights themselves are logarithms up to 0.
NO_ARC = 1.0
END = U(0x5EED5EED5EED5EED)
_LEFT, _RIGHT = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def _held_out(ids: pa.ChunkedArray) -> np.ndarray:
    """crc32 of the id as text, modulo 7, is 2; a null id counts as held out."""
    return np.array(
        [i is None or binascii.crc32(str(i).encode()) % 7 == 2 for i in ids.to_pylist()], dtype=bool
    )


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and where the texts begin."""
    hashes, bounds = wordhash.words(texts)
    n = len(bounds) - 1
    return np.insert(hashes, bounds[1:], END), bounds + np.arange(n + 1)


def _longer(tokens: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """Per token the hash of the n-gram of this order that it ends. A text's first pair begins
    with the end token; its first triple would begin before that, and is the pair instead."""
    grams = tokens
    for _ in range(order - 1):
        before = np.roll(grams, 1)
        before[bounds[:-1]] = END
        grams = wordhash.mix(before * _LEFT ^ wordhash.mix(tokens + _RIGHT))
    return grams


def _squeeze(batches):
    """The same rows with each text compressed."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        small = pa.array([packer.compress(t.encode()) for t in texts], pa.binary())
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays(
            [small if c == "text" else batch.column(c) for c in names], names=names
        )


def _block(table: pa.Table):
    """Slices of the block's texts in a fixed order: (row numbers, tokens, bounds)."""
    unpacker = zstandard.ZstdDecompressor()
    order = np.lexsort((table.column("row_id").to_numpy(),))
    for at in range(0, len(order), SLICE):
        rows = order[at : at + SLICE]
        texts = [unpacker.decompress(t) for t in table.column("text").take(pa.array(rows)).to_pylist()]
        yield rows, *_tokens(pa.array(texts, pa.large_binary()).cast(pa.large_string()))


def _joined(parts, kind) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, kind)])


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each stands there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each stands in a training text."""
    every, _ = _runs(keys)
    seen, times = _runs(keys[train])
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, seen)] = times
    return every, counts


def _shrunk(some: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(some).tobytes(), codec="zstd", asbytes=True)


def _grown(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their number, the first, and the gaps: five low bytes each and a compressed
    sixth. They stay as they are where a gap needs more."""
    gaps = np.diff(keys)
    if not len(keys) or (len(gaps) and gaps.max() >= U(1 << 48)):
        return b"8" + keys.astype("<u8").tobytes()
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    head = b"6" + struct.pack("<QQ", len(gaps), int(keys[0]))
    return head + planes[:, :5].tobytes() + _shrunk(planes[:, 5])


def _unpack_keys(packed: bytes) -> np.ndarray:
    if packed[:1] == b"8":
        return np.frombuffer(packed, "<u8", offset=1).astype(U)
    n, first = struct.unpack_from("<QQ", packed, 1)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :5] = np.frombuffer(packed, np.uint8, 5 * n, 17).reshape(-1, 5)
    planes[:, 5] = _grown(packed[17 + 5 * n :], n)
    return np.cumsum(np.concatenate([np.array([first], U), planes.view("<u8").ravel()]), dtype=U)


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte per count, compressed, after those from 255 on in full."""
    large = counts[counts >= 255].astype("<i8")
    return struct.pack("<Q", len(large)) + large.tobytes() + _shrunk(np.minimum(counts, 255).astype(np.uint8))


def _unpack_counts(packed: bytes, n: int) -> np.ndarray:
    (many,) = struct.unpack_from("<Q", packed)
    counts = _grown(packed[8 + 8 * many :], n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, "<i8", many, 8)
    return counts


def _ask(ranges: int):
    def ask(key, texts):
        held = _held_out(texts.column("doc_id"))
        slices = list(_block(texts))
        train = _joined((np.repeat(~held[r], np.diff(b)) for r, _, b in slices), bool)
        columns = {}
        for order in range(1, ORDER + 1):
            keys, counts = _counted(_joined((_longer(t, b, order) for _, t, b in slices), U), train)
            cut = _cuts(keys, ranges)
            pieces = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            columns[f"keys{order}"] = pa.array([_pack_keys(keys[p]) for p in pieces], pa.binary())
            columns[f"counts{order}"] = pa.array([_pack_counts(counts[p]) for p in pieces], pa.binary())
        return pa.table(
            {
                "range": pa.array(range(ranges), pa.int32()),
                "block": pa.array([key[0].as_py()] * ranges, pa.int32()),
                **columns,
            }
        )

    return ask


def _totals(requests: pa.Table, order: int) -> tuple[list[bytes], int, int]:
    """For each request the totals of its keys; the sum of all counts and the keys counted."""
    parts = [_unpack_keys(x) for x in requests.column(f"keys{order}").to_pylist()]
    sizes = [len(p) for p in parts]
    packed = requests.column(f"counts{order}").to_pylist()
    counts = _joined((_unpack_counts(c, k) for c, k in zip(packed, sizes, strict=True)), np.int64)
    uniq, where = np.unique(_joined(parts, U), return_inverse=True)
    sums = np.bincount(where, weights=counts, minlength=len(uniq)).astype(np.int64)
    pieces = np.split(sums[where], np.cumsum(sizes)[:-1])
    return [_pack_counts(p) for p in pieces], int(sums.sum()), int((sums > 0).sum())


def _answer(requests):
    columns, n, v = {}, 0, 0
    for order in range(1, ORDER + 1):
        totals, times, distinct = _totals(requests, order)
        columns[f"totals{order}"] = pa.array(totals, pa.binary())
        if order == 1:
            n, v = times, distinct
    return pa.table(
        {
            "block": requests.column("block"),
            "range": requests.column("range"),
            **columns,
            "n": pa.array([n] * requests.num_rows, pa.int64()),
            "v": pa.array([v] * requests.num_rows, pa.int64()),
        }
    )


def _count_of_each(keys: np.ndarray, answers: list[bytes]) -> np.ndarray:
    """Per key its training count, from the answers in the order of their ranges."""
    uniq, where = np.unique(keys, return_inverse=True)
    sizes = np.diff(_cuts(uniq, len(answers))).tolist()
    totals = [_unpack_counts(a, k) for a, k in zip(answers, sizes, strict=True)]
    return _joined(totals, np.int64)[where]


def _traverse(level: int, root, word_arcs, pair_arcs, word_fails, pair_fails, known) -> float:
    """The weight of one text's path. Per token: the arc weights of root, word state and pair
    state over it (NO_ARC where there is none), the failure weights of the states of the one and
    two words before it, and whether it has a state. level is the words of history that the
    first state holds."""
    total = 0.0
    for at_root, at_word, at_pair, word_fail, pair_fail, has_state in zip(
        root, word_arcs, pair_arcs, word_fails, pair_fails, known, strict=True
    ):
        if level == 2:
            if at_pair != NO_ARC:  # the pair that the triple ends with is known as well
                total += at_pair
                continue
            total += pair_fail
            level = 1
        if level == 1:
            if at_word != NO_ARC:
                total += at_word
                level = 2
                continue
            total += word_fail
        total += at_root
        level = 1 if has_state else 0
    return total


def _score(strengths: tuple[float, float]):
    def score(texts, answers):
        answers = answers.sort_by("range")
        held = _held_out(texts.column("doc_id"))
        n, v = sum(answers.column("n").to_pylist()), sum(answers.column("v").to_pylist())
        slices = list(_block(texts))
        counts = [
            _count_of_each(
                _joined((_longer(t, b, order) for _, t, b in slices), U),
                answers.column(f"totals{order}").to_pylist(),
            )
            for order in range(1, ORDER + 1)
        ]
        ends = counts[0][np.concatenate([t for _, t, _ in slices]) == END][0]
        out = {c: np.zeros(texts.num_rows) for c in ("base_score", "score", "n_tokens", "n_known")}
        at = 0
        for rows, tokens, bounds in slices:
            one, two, three = (c[at : at + len(tokens)].astype(np.float64) for c in counts)
            at += len(tokens)
            starts = bounds[:-1]
            before, pair_before = np.roll(one, 1), np.roll(two, 1)
            before[starts], pair_before[starts], three[starts] = ends, 0, 0
            p = (one + 1) / (n + v + 1)
            p_word = (two + strengths[0] * p) / (before + strengths[0])
            p_pair = (three + strengths[1] * p_word) / (pair_before + strengths[1])
            root = np.log10(p)
            paths = [
                root,
                np.where(two > 0, np.log10(p_word), NO_ARC),
                np.where(three > 0, np.log10(p_pair), NO_ARC),
                np.log10(strengths[0] / (before + strengths[0])),
                np.log10(strengths[1] / (pair_before + strengths[1])),
                one > 0,
            ]
            first = 1 if ends else 0
            for row, a, b in zip(rows.tolist(), starts.tolist(), bounds[1:].tolist(), strict=True):
                out["score"][row] = _traverse(first, *(x[a:b].tolist() for x in paths))
            out["base_score"][rows] = np.add.reduceat(root, starts)
            out["n_tokens"][rows] = np.diff(bounds)
            out["n_known"][rows] = np.add.reduceat((one > 0).astype(np.int64), starts)
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": pa.array(held),
                "n_tokens": pa.array(out["n_tokens"].astype(np.int64)),
                "n_known": pa.array(out["n_known"].astype(np.int64)),
                "train_tokens": pa.array(np.full(texts.num_rows, n, dtype=np.int64)),
                "base_score": pa.array(out["base_score"]),
                "score": pa.array(out["score"]),
            }
        )

    return score


def _blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows with their text compressed, and the block that scores them: by their id and number,
    as very many rows can have the same id or none."""
    numbered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    block = F.pmod(F.xxhash64("doc_id", "row_id"), F.lit(blocks)).cast("int")
    return numbered.withColumn("block", block).mapInArrow(
        _squeeze, "doc_id long, row_id long, text binary, block int"
    )


def lm_scores(docs: DataFrame, strengths: tuple[float, float] = STRENGTHS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known (tokens seen
    in training), train_tokens (N), base_score (add-one unigram) and score (of the automaton),
    both log10 probabilities of the whole text.

    Training texts are those whose crc32(doc_id as text) mod 7 is not 2, every repeated row
    counted; a row with a null doc_id is scored but not learned from. A null text counts as
    empty: its only token is the end. Words are runs of non-space characters with A-Z
    lower-cased, compared as 64-bit hashes. Other columns are ignored. Without training texts
    all words are unknown and equally likely.
    """
    blocks, orders = block_count(docs), range(1, ORDER + 1)
    texts = _blocked(docs, blocks).repartition(blocks, "block")
    asked = texts.groupBy("block").applyInArrow(
        _ask(blocks),
        "range int, block int, " + ", ".join(f"keys{k} binary, counts{k} binary" for k in orders),
    )
    answers = asked.groupBy("range").applyInArrow(
        _answer,
        "block int, range int, " + "".join(f"totals{k} binary, " for k in orders) + "n long, v long",
    )
    return (
        texts.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            _score(strengths),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double",
        )
    )
