"""Alignment of two tokenizers at white-space anchors, with the windows remembered by token ids.

A text is tokenised whole by both tokenizers. Where a token of each ends at the same byte and a
space-marked token of each follows, the text is cut: the token ids between two such anchors are
a window, about a word. What a window holds (its groups, cut where both tokenizers end a token,
and its links, the pairs of tokens of a group) depends on its ids only, so it is worked out once
per tuple of ids and looked up from then on.

How many documents link a pair of ids is counted over the corpus: each block of texts asks once
for each of its pairs, slices of the pairs sum up what the blocks ask, and the sums go back to
the blocks. The number of slices is fixed, and the number of pairs in one is bounded by the
vocabularies, so messages grow with the input and no slice is ever held whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirstats.llm.scratch import written

#: Vocabulary files, in a folder that every executor has under the same path.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes tokenised at a time (a longer text alone), and in a block that asks for its pairs.
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 48 << 20
#: Tokens held in remembered windows; beyond that the memory starts anew.
KEPT_TOKENS = 2_000_000
#: Words whose pieces are remembered; beyond that the memory starts anew.
KEPT_WORDS = 150_000
#: Linked pairs of texts that a block gathers before it adds them up.
WAITING_PAIRS = 1_000_000
#: Power of two: slices of the pairs.
SLICE_BITS = 10
#: Links of a group that are listed one by one; larger groups are counted by distinct ids.
LISTED_LINKS = 1 << 14

# How the first vocabulary cuts a text before merging, and the mark of the second.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SPACE_MARK = "▁"
_WORDS = re.compile(" +[^ ]*")

_SEPARATOR = np.uint32(0xFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.zeros(0, np.int64)


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable bytes as themselves,
    the others, in order, from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteVocabulary:
    """Byte-level BPE of a tokenizer file. Where ids are in the order of the merges, as in the
    file of this package's query, a rank encoder gives the same ids several times faster; runs
    of white space that its pattern matcher gives up on go to the tokenizer of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.path, self._slow = path, None
        self.exact = True  # rank merging joins the bytes of the text and changes none
        letters = byte_letters()
        vocabulary = model["vocab"]
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.pieces[k] = bytes(letters[c] for c in piece)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = all(vocabulary[a + b] == 256 + k for k, (a, b) in enumerate(merges))
        self._fast = None
        if in_order and len(vocabulary) == 256 + len(merges):
            import tiktoken

            self._fast = tiktoken.Encoding(
                "byte-bpe",
                pat_str=WORD_PATTERN,
                mergeable_ranks={p: k for k, p in enumerate(self.pieces)},
                special_tokens={},
            )

    def by_file(self, text: str) -> np.ndarray:
        self.exact = False
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self._fast is None:
            return [self.by_file(t) for t in texts]
        out = []
        for text in texts:
            try:
                ids = self._fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the matcher's panic is no Exception
                if type(e).__name__ != "PanicException":
                    raise
                ids = self.by_file(text)
            out.append(ids.astype(np.uint32, copy=False))
        return out


class PieceVocabulary:
    """Sentence-piece BPE with byte fallback. No piece of the vocabulary has a space mark behind
    another character, so no merge crosses the space before a word: the tokens of a text are
    those of its words with the spaces before them, of which each is encoded once. A vocabulary
    with such a piece, or one that changes texts, encodes whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.pieces = [
            bytes([int(p[3:5], 16)])
            if self.model.is_byte(k)
            else p.replace(SPACE_MARK, " ").encode()
            for k, p in enumerate(names)
        ]
        probe = " \ufb01\u00bd  e\u0301\t\n "
        kept = self.model.normalize(probe) == (" " + probe).replace(" ", SPACE_MARK)
        self.by_word = kept and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in names)
        self.words: dict[str, bytes] = {}
        self.blank = np.array([self.model.piece_to_id(SPACE_MARK)], dtype=np.uint32).tobytes()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype=np.uint32) for x in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word or any(SPACE_MARK in t for t in texts):
            return self.whole(texts)
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        words = self.words
        parts = [_WORDS.findall(" " + t) for t in texts]
        new = list({w for p in parts for w in p if w not in words})
        for word, ids in zip(new, self.model.encode([w[1:] for w in new], num_threads=1), strict=True):
            words[word] = np.array(ids, dtype=np.uint32).tobytes() or self.blank
        return [np.frombuffer(b"".join([words[w] for w in p]), np.uint32) for p in parts]


def _lengths(pieces: list[bytes]) -> np.ndarray:
    return np.array([len(p) for p in pieces], dtype=np.int64)


def _flat(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = _lengths(pieces)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes


def _opens(pieces: list[bytes]) -> np.ndarray:
    return np.array([p.startswith(b" ") for p in pieces])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _of_length(keep, raws, ids, lengths) -> list[int]:
    return [j for j in keep if int(lengths[ids[j]].sum()) == len(raws[j])]


def _spelled(keep, raws, ids, lengths, flat, starts) -> list[int]:
    """Those of the texts, as long as their tokens, that the tokens spell byte for byte."""
    if not keep:
        return []
    all_ids = np.concatenate([ids[j] for j in keep])
    spelled = flat[_ranges(starts[all_ids], lengths[all_ids])]
    wrong = np.flatnonzero(spelled != np.frombuffer(b"".join([raws[j] for j in keep]), np.uint8))
    ends = np.cumsum([len(raws[j]) for j in keep])
    bad = set(np.searchsorted(ends, wrong, side="right").tolist())
    return [j for k, j in enumerate(keep) if k not in bad]


class Aligner:
    """Windows by their ids: groups as text, numbers of groups and links, and linked pairs."""

    def __init__(self, a, b, kept_tokens: int = KEPT_TOKENS):
        self.a, self.b, self.kept_tokens = a, b, kept_tokens
        self.len_a, self.len_b = _lengths(a.pieces), _lengths(b.pieces)
        self.open_a, self.open_b = _opens(a.pieces), _opens(b.pieces)
        self.flat_a, self.flat_b = _flat(a.pieces), _flat(b.pieces)
        self.width = len(b.pieces)
        na, nb = range(len(a.pieces)), range(len(b.pieces))
        # a token within its side of a group, the last one of a side
        self.names = [
            *(b"%d," % k for k in na), *(b"%d|" % k for k in na),
            *(b"%d," % k for k in nb), *(b"%d;" % k for k in nb),
        ]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.tokens = 0
        self.texts: list[bytes] = []
        self.n_groups, self.n_links, self.pair_at = [EMPTY], [EMPTY], [np.zeros(1, np.int64)]
        self.pairs, self.times = [EMPTY], [EMPTY]

    def _tables(self):
        for name in ("n_groups", "n_links", "pair_at", "pairs", "times"):
            kept = getattr(self, name)
            if len(kept) > 1:
                setattr(self, name, [np.concatenate(kept)])
        return self.n_groups[0], self.n_links[0], self.pair_at[0], self.pairs[0], self.times[0]

    def _learn(self, a, b, shared_a, shared_b, win_a, win_b) -> None:
        """Adds windows: their ids in a and b, where both tokenizers end, and the tokens of each."""
        first = np.concatenate([[0], np.cumsum(shared_a)[:-1]]).astype(np.int64)
        group_a, group_b = first, np.concatenate([[0], np.cumsum(shared_b)[:-1]]).astype(np.int64)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        starts_a = np.cumsum(win_a) - win_a
        window_of = group_a[starts_a]  # first group of each window
        links = in_a * in_b
        self.n_groups.append(np.diff(np.append(window_of, len(in_a))))
        self.n_links.append(np.add.reduceat(links, window_of))
        # texts: the tokens of a group's first side, then those of the other
        off_a, off_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        code = np.empty(len(a) + len(b), np.int64)
        n = len(self.len_a)
        code[np.arange(len(a)) + off_b[group_a]] = a + n * shared_a
        code[np.arange(len(b)) + (off_a + in_a)[group_b]] = 2 * n + b + self.width * shared_b
        names = self.names
        parts = [names[c] for c in code.tolist()]
        cuts = np.cumsum(win_a + win_b).tolist()
        at = 0
        for end in cuts:
            self.texts.append(b"".join(parts[at:end])[:-1])
            at = end
        # links, as pairs of ids with how often a window has them
        listed = links <= LISTED_LINKS
        of = np.repeat(np.flatnonzero(listed), links[listed])
        place = _ranges(np.zeros(int(listed.sum()), np.int64), links[listed])
        pair = a[off_a[of] + place // in_b[of]].astype(np.int64) * self.width
        pair += b[off_b[of] + place % in_b[of]]
        group, times = [of], [np.ones(len(of), np.int64)]
        pairs = [pair]
        for g in np.flatnonzero(~listed).tolist():
            x, nx = np.unique(a[off_a[g] : off_a[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(b[off_b[g] : off_b[g] + in_b[g]], return_counts=True)
            pairs.append((x.astype(np.int64)[:, None] * self.width + y).ravel())
            times.append((nx[:, None] * ny).ravel())
            group.append(np.full(len(pairs[-1]), g))
        pair, times, group = (np.concatenate(x) for x in (pairs, times, group))
        if len(pairs) > 1:
            order = np.argsort(group, kind="stable")
            pair, times, group = pair[order], times[order], group[order]
        bounds = np.searchsorted(group, np.append(window_of[1:], len(in_a)))
        self.pair_at.append(self._size() + bounds)
        self.pairs.append(pair)
        self.times.append(times)

    def _size(self) -> int:
        return sum(len(x) for x in self.pairs)

    def align(self, texts: list[str | None]) -> dict:
        """Per text its tokens, groups, links and the digest of its groups, and for all texts the
        distinct linked pairs (with the number of the text) and how often each is linked."""
        if self.tokens > self.kept_tokens:
            self.forget()
        n = len(texts)
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"sha": [""] * n, "of": EMPTY, "pair": EMPTY, "times": EMPTY}
        some = [k for k, t in enumerate(texts) if t]
        whole = [" " + texts[k] for k in some]
        ids_a, ids_b = self.a.encode(whole), self.b.encode([texts[k] for k in some])
        raws = [t.encode() for t in whole]
        keep = _of_length(range(len(whole)), raws, ids_a, self.len_a)
        if not self.a.exact:
            keep = _spelled(keep, raws, ids_a, self.len_a, *self.flat_a)
        keep = _of_length(keep, raws, ids_b, self.len_b)
        keep = _spelled(keep, raws, ids_b, self.len_b, *self.flat_b)
        if not keep:
            return out
        doc = np.array([some[j] for j in keep])
        a, b = (np.concatenate([x[j] for j in keep]) for x in (ids_a, ids_b))
        size_a = np.array([len(ids_a[j]) for j in keep])
        size_b = np.array([len(ids_b[j]) for j in keep])
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        at = np.searchsorted(end_b, end_a)
        both = end_b[at] == end_a
        shared_a, shared_b = both, np.zeros(len(b), bool)
        shared_b[at[both]] = True
        # anchors: shared ends before space-marked tokens, and the ends of texts
        after_a = np.append(self.open_a[a[1:]], True)
        after_b = np.append(self.open_b[b[1:]], True)
        anchor = np.zeros(len(a), bool)
        k = np.flatnonzero(both)
        anchor[k] = after_a[k] & after_b[at[k]]
        anchor[np.cumsum(size_a) - 1] = True
        stop_a = np.flatnonzero(anchor) + 1
        stop_b = at[stop_a - 1] + 1
        from_a, from_b = np.append(0, stop_a[:-1]), np.append(0, stop_b[:-1])
        win_a, win_b = stop_a - from_a, stop_b - from_b
        # one stream of a window's ids, a separator between the sides
        w = np.arange(len(win_a))
        stream = np.empty(len(a) + len(b) + len(w), np.uint32)
        stream[np.arange(len(a)) + np.repeat(from_b + w, win_a)] = a
        stream[stop_a + from_b + w] = _SEPARATOR
        stream[np.arange(len(b)) + np.repeat(stop_a + w + 1, win_b)] = b
        raw = stream.tobytes()
        cuts = (4 * (stop_a + stop_b + w + 1)).tolist()
        keys = [raw[s:e] for s, e in zip([0, *cuts[:-1]], cuts, strict=True)]
        known = self.known
        found = list(map(known.get, keys, repeat(-1)))
        ids = np.array(found)
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            fresh = []
            for k in missing.tolist():
                if keys[k] not in known:
                    known[keys[k]] = len(known)
                    fresh.append(k)
                ids[k] = known[keys[k]]
            fresh = np.array(fresh)
            take_a = _ranges(from_a[fresh], win_a[fresh])
            take_b = _ranges(from_b[fresh], win_b[fresh])
            self.tokens += len(take_a) + len(take_b)
            self._learn(
                a[take_a], b[take_b], shared_a[take_a], shared_b[take_b], win_a[fresh], win_b[fresh]
            )
        n_groups, n_links, pair_at, pairs, times = self._tables()
        last = np.cumsum(size_a)
        end = np.searchsorted(stop_a, last) + 1  # windows up to the end of each text
        begin = np.append(0, end[:-1])
        out["n_a"][doc], out["n_b"][doc] = size_a, size_b
        out["n_groups"][doc] = np.add.reduceat(n_groups[ids], begin)
        out["n_links"][doc] = np.add.reduceat(n_links[ids], begin)
        listed = ids.tolist()
        for k, s, e in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
            groups = b";".join([self.texts[i] for i in listed[s:e]])
            out["sha"][k] = hashlib.sha256(groups).hexdigest()
        out["of"], out["pair"], out["times"] = self._linked(doc, ids, end - begin, pair_at, pairs, times)
        return out

    def _linked(self, doc, ids, windows, pair_at, pairs, times):
        """(text, pair, times), distinct and in order of both; windows are taken by text and
        window number first, which leaves few to expand."""
        wide = len(pair_at)
        each, often = np.unique(np.repeat(doc, windows) * wide + ids, return_counts=True)
        of, window = each // wide, each % wide
        size = pair_at[window + 1] - pair_at[window]
        take = _ranges(pair_at[window], size)
        of, pair = np.repeat(of, size), pairs[take]
        times = times[take] * np.repeat(often, size)
        span = len(self.len_a) * self.width
        key = of * span + pair
        order = np.argsort(key)
        key, times = key[order], times[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key = key[first]
        return key // span, key % span, np.add.reduceat(times, first)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: the bytes of equal weight together, compressed."""
    planes = np.ascontiguousarray(values, dtype=np.int64).view(np.uint8).reshape(-1, 8).T
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    body = np.ascontiguousarray(planes[:used]).tobytes()
    return bytes([used]) + len(body).to_bytes(8, "little") + bytes(
        memoryview(pa.compress(body, codec="zstd", asbytes=True))
    )


def unpack(packed: bytes) -> np.ndarray:
    used, size = packed[0], int.from_bytes(packed[1:9], "little")
    if not size:
        return EMPTY
    body = pa.decompress(packed[9:], decompressed_size=size, codec="zstd", asbytes=True)
    planes = np.zeros((8, size // used), np.uint8)
    planes[:used] = np.frombuffer(body, np.uint8).reshape(used, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _steps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=0)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return EMPTY, EMPTY
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


def slice_of(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * _SPREAD) >> np.uint64(64 - SLICE_BITS)).astype(np.int64)


#: Rows of the aligned texts, and among them rows in which a block asks for its pairs.
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in _COUNTS),
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("linked", T.BinaryType()),
        T.StructField("times", T.BinaryType()),
        T.StructField("slice", T.IntegerType()),
        T.StructField("asked", T.BinaryType()),
        T.StructField("held", T.BinaryType()),
    ]
)
_ALIGNED_ARROW = {
    "block": pa.int64(), "doc_id": pa.int64(), **{c: pa.int64() for c in _COUNTS},
    "groups_sha256": pa.string(), "linked": pa.binary(), "times": pa.binary(),
    "slice": pa.int32(), "asked": pa.binary(), "held": pa.binary(),
}


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(c, [None] * n), t) for c, t in _ALIGNED_ARROW.items()],
        names=list(_ALIGNED_ARROW),
    )


def _chunks(batch: pa.RecordBatch):
    """(ids, texts) of about CHUNK_BYTES each."""
    ids, texts = batch.column("doc_id"), batch.column("text")
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES)))
        yield ids.slice(at, end - at).to_pylist(), texts.slice(at, end - at).to_pylist()
        at = end


def _align(byte_bpe: str, piece_bpe: str):
    def work(batches):
        aligner = Aligner(ByteVocabulary(byte_bpe), PieceVocabulary(piece_bpe))
        block = TaskContext.get().partitionId() << 24
        asked, held, waiting, size = EMPTY, EMPTY, [], 0

        def settle():
            nonlocal asked, held, waiting
            one = [np.ones(len(w), np.int64) for w in waiting]
            asked, held = _sums(np.concatenate([asked, *waiting]), np.concatenate([held, *one]))
            waiting = []

        def ask():
            settle()
            number = slice_of(asked)
            order = np.argsort(number, kind="stable")
            pairs, docs = asked[order], held[order]
            numbers, starts = np.unique(number[order], return_index=True)
            ends = np.append(starts[1:], len(pairs)).tolist()
            rows = list(zip(starts.tolist(), ends, strict=True))
            return _batch(
                {
                    "block": [block] * len(rows),
                    "slice": numbers.tolist(),
                    "asked": [pack(_steps(pairs[s:e])) for s, e in rows],
                    "held": [pack(docs[s:e]) for s, e in rows],
                }
            )

        for batch in batches:
            for ids, texts in _chunks(batch):
                found = aligner.align(texts)
                cuts = np.searchsorted(found["of"], np.arange(len(texts) + 1)).tolist()
                parts = list(zip(cuts[:-1], cuts[1:], strict=True))
                pair, times = found["pair"], found["times"]
                yield _batch(
                    {
                        "block": [block] * len(texts),
                        "doc_id": ids,
                        **{c: found[c] for c in _COUNTS},
                        "groups_sha256": found["sha"],
                        "linked": [pack(_steps(pair[s:e])) for s, e in parts],
                        "times": [pack(times[s:e]) for s, e in parts],
                    }
                )
                waiting.append(pair)
                size += sum(len(t or "") for t in texts)
                if sum(map(len, waiting)) > WAITING_PAIRS:
                    settle()
                if size > BLOCK_BYTES:
                    yield ask()
                    asked, held, size, block = EMPTY, EMPTY, 0, block + 1
        if size:
            yield ask()

    return work


def _total(width: int):
    """Rows (slice, asked, held) in order of slice: per slice its distinct pairs, the documents
    that hold them, and the most documents that any pair of an id of the first tokenizer has."""

    def work(batches):
        now, asked, held, waiting = None, EMPTY, EMPTY, []
        names = ["slice", "pairs", "docs", "ids", "most"]

        def settle():
            nonlocal asked, held, waiting
            asked, held = _sums(
                np.concatenate([asked, *(unpacked(p) for p, _ in waiting)]),
                np.concatenate([held, *(unpack(h) for _, h in waiting)]),
            )
            waiting = []

        def row():
            settle()
            ids = asked // width
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            most = np.maximum.reduceat(held, first)
            values = [[now], [pack(_steps(asked))], [pack(held)], [ids[first].tolist()], [most.tolist()]]
            types = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("slice", "asked", "held"))
            for number, pairs, docs in zip(*columns, strict=True):
                if number != now:
                    if now is not None:
                        yield row()
                    now, asked, held, waiting = number, EMPTY, EMPTY, []
                waiting.append((pairs, docs))
                if len(waiting) >= 256:
                    settle()
        if now is not None:
            yield row()

    return work


def unpacked(packed: bytes) -> np.ndarray:
    """Values that were packed as steps."""
    return np.cumsum(unpack(packed))


def _reply(batches):
    """Rows in order of slice, its totals first: the documents of the pairs that each block asks."""
    pairs = docs = EMPTY
    for batch in batches:
        out = {"block": [], "pairs": [], "docs": []}
        columns = (batch.column(c).to_pylist() for c in ("block", "pairs", "docs"))
        for block, asked, totals in zip(*columns, strict=True):
            if totals is not None:
                pairs, docs = unpacked(asked), unpack(totals)
                continue
            out["block"].append(block)
            out["pairs"].append(asked)
            out["docs"].append(pack(docs[np.searchsorted(pairs, unpacked(asked))]))
        types = (pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out)
        )


def _count(most: np.ndarray, width: int):
    """Adds up what the links of each text count in the corpus."""

    def work(texts: pa.Table, replies: pa.Table) -> pa.Table:
        pairs, docs = (
            np.concatenate([EMPTY, *(f(x) for x in replies.column(c).to_pylist())])
            for c, f in (("pairs", unpacked), ("docs", unpack))
        )
        order = np.argsort(pairs, kind="stable")
        pairs, docs = pairs[order], docs[order]
        best = docs == most[pairs // width]
        n_best, count_sum = [], []
        for linked, times in zip(
            texts.column("linked").to_pylist(), texts.column("times").to_pylist(), strict=True
        ):
            at, times = np.searchsorted(pairs, unpacked(linked)), unpack(times)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * docs[at]).sum()))
        keep = texts.select(["doc_id", *_COUNTS, "groups_sha256"])
        return keep.append_column("n_best", pa.array(n_best, pa.int64())).append_column(
            "count_sum", pa.array(count_sum, pa.int64())
        )

    return work


def align_tokenizers(
    docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_a and n_b (tokens of either tokenizer),
    n_groups, n_links, n_best (links whose pair is the commonest of its first id in the corpus,
    ties included), count_sum (documents that link the pair, summed over links) and
    groups_sha256 (of the groups as ``a1,a2|b1;a3|b2,b3``).

    byte_bpe encodes a space and the text, piece_bpe, which adds a space of its own, the text.
    A text that is null, empty or not given back by the tokens of either one has no tokens: zeros,
    and '' as digest. Repeated rows each count as a document and each get a row, a null doc_id
    stays null, and other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = written(texts.mapInArrow(_align(byte_bpe, piece_bpe), ALIGNED), "aligned")
    width, height = len(PieceVocabulary(piece_bpe).pieces), len(ByteVocabulary(byte_bpe).pieces)
    asks = aligned.where("slice IS NOT NULL").select("slice", "block", "asked", "held")
    totals = written(
        asks.select("slice", "asked", "held")
        .repartition("slice")
        .sortWithinPartitions("slice")
        .mapInArrow(
            _total(width),
            "slice int, pairs binary, docs binary, ids array<int>, most array<long>",
        ),
        "totals",
    )
    most = np.zeros(height, np.int64)  # one number per id of the vocabulary
    per_id = totals.select(F.explode(F.arrays_zip("ids", "most")).alias("x")).groupBy("x.ids")
    for row in per_id.agg(F.max("x.most").alias("most")).toLocalIterator():
        most[row[0]] = row[1]
    nothing = F.lit(None).cast("binary")
    replies = (
        totals.select("slice", F.lit(-1).cast("long").alias("block"), "pairs", "docs")
        .unionByName(asks.select("slice", "block", F.col("asked").alias("pairs"), nothing.alias("docs")))
        .repartition("slice")
        .sortWithinPartitions("slice", "block")
        .drop("slice")
        .mapInArrow(_reply, "block long, pairs binary, docs binary")
    )
    rows = aligned.where("slice IS NULL").select(
        "block", "doc_id", *_COUNTS, "groups_sha256", "linked", "times"
    )
    return (
        rows.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(
            _count(most, width),
            "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
            "groups_sha256 string, n_best long, count_sum long",
        )
    )
