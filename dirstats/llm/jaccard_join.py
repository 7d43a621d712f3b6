"""N-gram Jaccard join: which documents are linked by similar sets of word shingles, and by how many.

Method: an exact prefix join over sets in rarity order, with the two savings of set relations.
Inside the lists of the index, entries stand in blocks by how much of their set is left behind
their position, so that a probe leaves out the blocks that cannot reach the needed overlap. And
the answers of a set are derived from those of a highly similar set that was done before: its
overlaps, changed only along the lists of the members in which the two sets differ, are the
exact overlaps of the new set, which accept or reject every candidate.

How it is spread: rows with the same word sequence are one set, whatever their doc_ids. The number of sets that
hold a shingle is counted over all documents, in hash ranges that many documents share; the
counts go back to the blocks of documents that asked. Only a set that shares one of its
rarest shingles (the prefix) with another set can have a link, so only such sets go on. Sets
that share prefix shingles form clusters; small clusters are packed into bins and joined in one
task each. A cluster larger than a bin is cut into blocks, in which sets with the same least
prefix shingle, as near copies mostly have, lie together. Each block is joined in itself. Then a
set goes to another block only if that holds, for a prefix shingle of the set, a set of a fitting
size; so where a common passage chains many texts into one cluster, what is sent grows with the
candidates and not with the square of the cluster. Each link counts, and not only the first that
joins two components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirstats.llm import wordhash
from dirstats.llm.components import components
from dirstats.llm.scratch import block_count, written

U = np.uint64


def _told(columns: list[str], distinct: bool = False):
    """Adds first and second, the digest of the words of the text, to the given columns; with
    distinct, a task gives each digest once and leaves out texts without words."""

    def tell(batches):
        seen = set()
        for batch in batches:
            first, second = wordhash.sequences(*wordhash.words(batch.column("text")))
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns)]
                + [pa.array(x.view(np.int64)) for x in (first, second)],
                names=[*columns, "first", "second"],
            )
            if distinct:
                new = []
                for at, pair in enumerate(zip(first.tolist(), second.tolist(), strict=True)):
                    if pair != (0, 0) and pair not in seen:
                        seen.add(pair)
                        new.append(at)
                out = out.take(pa.array(new, pa.int64()))
            yield out

    return tell


def _block_sets(texts: pa.Table, keep: pa.Table, size: int):
    """The rows of keep in the order of their digests, and the shingle set of each. The block's
    texts have the same digests as keep, some of them repeatedly."""
    keep = keep.sort_by([("first", "ascending"), ("second", "ascending")])
    first, second = (texts.column(c).to_numpy() for c in ("first", "second"))
    rows = np.lexsort((second, first))
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (np.diff(first[rows]) != 0) | (np.diff(second[rows]) != 0)
    rows = rows[new]
    if len(rows) != keep.num_rows:
        raise ValueError("the texts of a block changed between two reads")
    out = []
    for at in range(0, len(rows), 512):
        some = texts.column("text").take(pa.array(rows[at : at + 512]))
        out += wordhash.shingles(*wordhash.words(some), size)
    return keep, out


def _ranges(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[slice]]:
    """The hash ranges that sorted keys touch, and where each lies in them. Ranges without a key
    are left out: with all of them, blocks times ranges would outgrow the texts."""
    of = ((keys >> U(32)) * U(buckets)) >> U(32)
    opens = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    ends = np.append(opens[1:], len(of))
    return of[opens], [slice(a, b) for a, b in zip(opens.tolist(), ends.tolist(), strict=False)]


def _requests(size: int, buckets: int):
    def ask(key, texts, keep):
        _, sets = _block_sets(texts, keep, size)
        keys, counts = np.unique(np.concatenate([*sets, np.zeros(0, U)]), return_counts=True)
        touched, pieces = _ranges(keys, buckets)
        low, counts = keys.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)
        return pa.table(
            {
                "bucket": pa.array(touched.astype(np.int32)),
                "block": pa.array([key[0].as_py()] * len(pieces), pa.int32()),
                "keys": pa.array([low[p].tobytes() for p in pieces], pa.binary()),
                "counts": pa.array([counts[p].tobytes() for p in pieces], pa.binary()),
            }
        )

    return ask


def _answer(requests):
    """How many sets hold each asked shingle, as one byte: exact below 200, then by doublings.
    The low half of a hash names it inside of its range; a clash only makes an order less
    good, never a result wrong."""
    blobs = requests.column("keys").to_pylist()
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs])
    counts = np.concatenate(
        [np.frombuffer(x, np.uint16) for x in requests.column("counts").to_pylist()]
    )
    uniq, where = np.unique(keys, return_inverse=True)
    sums = np.bincount(where, weights=counts, minlength=len(uniq))
    level = np.minimum(sums, 200 + np.log2(np.maximum(sums, 200) / 200))
    level = np.minimum(level, 255).astype(np.uint8)[where]
    ends = np.cumsum([len(x) // 4 for x in blobs])
    pieces = np.split(level, ends[:-1])
    return pa.table(
        {
            "block": requests.column("block"),
            "bucket": requests.column("bucket"),
            "levels": pa.array([p.tobytes() for p in pieces], pa.binary()),
        }
    )


def _prefix(n: int, percent: int) -> int:
    """How many of the rarest members of a set of n one is sure to share with any partner."""
    return n - -(-percent * n // 100) + 1


def _candidates(size: int, percent: int):
    def pick(key, texts, more):
        keep = more.filter(pa.compute.is_valid(more.column("node")))
        levels = more.filter(pa.compute.is_valid(more.column("bucket"))).sort_by("bucket")
        keep, sets = _block_sets(texts, keep, size)
        keys = np.unique(np.concatenate([*sets, np.zeros(0, U)]))
        level = np.frombuffer(b"".join(levels.column("levels").to_pylist()), np.uint8)
        tokens, shared, sizes = [], [], []
        for one in sets:
            sizes.append(len(one))
            rare = level[np.searchsorted(keys, one)]
            order = np.lexsort((one, rare))
            head = order[: _prefix(len(one), percent)] if len(one) else order
            both = one[head][rare[head] > 1]
            tokens.append(one[order].tobytes() if len(both) else None)
            shared.append(both.view(np.int64) if len(both) else None)
        return pa.table(
            {
                "node": keep.column("node"),
                "copies": keep.column("copies"),
                "size": pa.array(sizes, pa.int64()),
                "tokens": pa.array(tokens, pa.binary()),
                "shared": pa.array(shared, pa.list_(pa.int64())),
            }
        )

    return pick


class _Overlaps:
    """How many members a set shares with each of the sets, as one row per asked set."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.n, self.sizes = len(sets), sizes
        _, ids = np.unique(np.concatenate([*sets, np.zeros(0, U)]), return_inverse=True)
        self.members = np.split(ids, np.cumsum(sizes)[:-1])
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.holders = owner[np.argsort(ids, kind="stable")]
        self.starts = np.append(0, np.cumsum(np.bincount(ids)))
        self.kind = np.uint16 if sizes.max(initial=0) < 65536 else np.uint32
        self.rows: list[np.ndarray | None] = [None] * self.n
        self.known = np.zeros(self.n, dtype=bool)

    def _held(self, members: np.ndarray) -> np.ndarray:
        """How many of members each set holds."""
        lists = [self.holders[self.starts[m] : self.starts[m + 1]] for m in members.tolist()]
        held = np.concatenate([*lists, np.zeros(0, np.int32)])
        return np.bincount(held, minlength=self.n).astype(self.kind)

    def row(self, x: int, near: int) -> np.ndarray:
        """The overlaps of x, from those of the set near where these are known and few members
        differ: what x has beside near is added, what near has beside x is taken off."""
        mine, self.known[x] = self.members[x], True
        if self.rows[near] is not None:
            more = np.setdiff1d(mine, self.members[near], assume_unique=True)
            less = np.setdiff1d(self.members[near], mine, assume_unique=True)
            if len(more) + len(less) < len(mine):
                # unsigned, so that a difference below 0 on the way does no harm
                self.rows[x] = self.rows[near] + self._held(more) - self._held(less)
                return self.rows[x]
        self.rows[x] = self._held(mine)
        return self.rows[x]

    def few(self, x: int, others: np.ndarray) -> np.ndarray:
        mine = self.members[x]
        return np.array(
            [np.intersect1d(mine, self.members[y], assume_unique=True).size for y in others.tolist()]
        )


#: Up to so many candidates are compared one by one, without a row of overlaps.
FEW = 4


def linked(
    sets: list[np.ndarray],
    label: np.ndarray,
    percent: int,
    weight: np.ndarray,
    probe: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of sets given in rarity order: those of label, joined over every pair
    whose Jaccard similarity reaches percent / 100; and for each set the weights of all sets
    with which it makes such a pair. With probe, only pairs of a probe and another set count."""
    n = len(sets)
    label, links = label.copy(), np.zeros(n, dtype=np.int64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    turn = np.lexsort((np.arange(n), sizes))
    place = np.empty(n, dtype=np.int64)
    place[turn] = np.arange(n)
    heads = [s[: _prefix(len(s), percent)] if len(s) else s for s in sets]
    lengths = np.array([len(h) for h in heads], dtype=np.int64)
    owner = np.repeat(np.arange(n), lengths)
    token = np.concatenate([*heads, np.zeros(0, U)])
    if not len(token):
        return label, links
    spot = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = sizes[owner] - spot
    order = np.lexsort((-left, token))
    token, owner, spot, left = token[order], owner[order], spot[order], left[order]
    opens = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    ends = np.append(opens[1:], len(token))
    of_list = np.repeat(np.arange(len(opens)), ends - opens)
    own = np.lexsort((spot, owner))
    own_start = np.searchsorted(owner[own], np.arange(n + 1))
    overlaps = _Overlaps(sets, sizes)
    for x in turn.tolist():
        size = int(sizes[x])
        least = -(-percent * size // 100)  # of any partner's size, and of its overlap
        lists = of_list[own[own_start[x] : own_start[x + 1]]]
        parts = []
        for k in lists[ends[lists] - opens[lists] > 1].tolist():
            a, b = int(opens[k]), int(ends[k])
            b = a + int(np.searchsorted(-left[a:b], -least, side="right"))  # skip far blocks
            parts.append(owner[a:b])
        if not parts:
            continue
        some, times = np.unique(np.concatenate(parts), return_counts=True)
        keep = (place[some] < place[x]) & (sizes[some] >= least)
        if probe is not None:
            keep &= probe[some] != probe[x]
        near = int(some[np.argmax(np.where(overlaps.known[some], times, 0))])
        some = some[keep]
        if not len(some):
            continue
        if len(some) <= FEW:
            both = overlaps.few(x, some)
        else:
            both = overlaps.row(x, near)[some].astype(np.int64)
        hits = some[100 * both >= percent * (size + sizes[some] - both)]
        if len(hits):
            links[x] += weight[hits].sum()
            links[hits] += weight[x]
            met = np.unique(np.append(label[hits], label[x]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return label, links


def _sets_of(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(t, U) for t in group.column("tokens").to_pylist()]


def _link_bin(percent: int):
    def link(group):
        ids = group.column("node").to_numpy()
        label, links = linked(_sets_of(group), ids, percent, group.column("copies").to_numpy())
        return pa.table({"node": pa.array(ids), "label": pa.array(label), "links": pa.array(links)})

    return link


def _link_across(percent: int):
    def link(group):
        before = group.column("label").to_numpy()
        probe = group.column("block").to_numpy() == group.column("low").to_numpy()
        after, links = linked(
            _sets_of(group), before, percent, group.column("copies").to_numpy(), probe
        )
        some = links > 0
        return pa.table(
            {
                "node": pa.array(group.column("node").to_numpy()[some]),
                "links": pa.array(links[some]),
                "u": pa.array(before[some]),
                "v": pa.array(after[some]),
            }
        )

    return link


def _meetings(home: DataFrame, percent: int) -> DataFrame:
    """(node, block, other): the blocks that hold, in the list of a prefix shingle of the node,
    a set whose size leaves a link possible. Both sides of a link find each other."""
    held = home.select("node", "size", "block", F.explode("shared").alias("token"))
    spans = held.groupBy("token", F.col("block").alias("other")).agg(
        F.min("size").alias("low_size"), F.max("size").alias("high_size")
    )
    fits = (100 * F.col("high_size") >= percent * F.col("size")) & (
        100 * F.col("size") >= percent * F.col("low_size")
    )
    met = held.join(spans, "token").where("block <> other").where(fits)
    return met.select("node", "block", "other").distinct()


def _across(home: DataFrame, percent: int) -> DataFrame:
    """For every pair of blocks that meet, the links that each set has there, and the edge
    between its label and the label that they give it. A task holds at most two blocks, of which
    only the sets that meet the other block are sent."""
    met = written(_meetings(home, percent), "meetings")
    return (
        home.select("node", "tokens", "copies", "label")
        .join(met, "node")
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .groupBy("low", "high")
        .applyInArrow(_link_across(percent), "node long, links long, u long, v long")
    )


def _labels(found: DataFrame, edges: DataFrame) -> DataFrame:
    """found (node, label, links) with labels joined over edges between them."""
    merged = components(edges)
    merged = merged.withColumnRenamed("node", "label")
    return found.join(merged, "label", "left").select(
        "node", F.coalesce("component", "label").alias("label"), "links"
    )


def _texts(docs: DataFrame, digests: DataFrame, shingle_words: int, percent: int, bin_docs: int) -> DataFrame:
    """One row per distinct sequence of words that is not empty: first and second (its digest),
    copies (its rows), least (of their doc_ids), n (shingles), label (the same for all that can
    be reached over links) and links (other rows that it has a link with)."""
    blocks = block_count(docs)
    nodes = digests.where("first <> 0 or second <> 0").groupBy("first", "second").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least")
    )
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # by the digest, so that no doc_id, whether null or of many rows, makes a block large
    block = F.pmod(F.xxhash64("first", "second"), F.lit(blocks)).cast("int").alias("block")
    texts = (
        docs.select("text")
        .mapInArrow(_told(["text"], distinct=True), "text string, first long, second long")
        .select("text", "first", "second", block)
        .repartition(blocks, "block")
    )
    kept = nodes.select("node", "copies", "first", "second", block)
    asked = (
        texts.groupBy("block")
        .cogroup(kept.groupBy("block"))
        .applyInArrow(
            _requests(shingle_words, blocks), "bucket int, block int, keys binary, counts binary"
        )
    )
    answers = asked.groupBy("bucket").applyInArrow(
        _answer, "block int, bucket int, levels binary"
    )
    more = kept.unionByName(answers, allowMissingColumns=True)
    sets = written(
        texts.groupBy("block")
        .cogroup(more.groupBy("block"))
        .applyInArrow(
            _candidates(shingle_words, percent),
            "node long, copies long, size long, tokens binary, shared array<long>",
        ),
        "sets",
    )
    found = _link(sets.where("tokens is not null"), bin_docs, percent)
    return written(
        nodes.join(sets.select("node", F.col("size").alias("n")), "node")
        .join(found, "node", "left")
        .select(
            "first",
            "second",
            "copies",
            "least",
            "n",
            F.coalesce("label", "node").alias("label"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        ),
        "texts",
    )


def _digests(docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, first long, second long"
    return written(named.mapInArrow(_told(["doc_id"]), schema), "digests")


def jaccard_join(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    bin_docs: int = 2000,
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id and n_links.

    A row's set holds the distinct runs of shingle_words words of its text; a shorter text is
    one shingle, a null text and one without words have the empty set, which links with nothing.
    Two sets link when their Jaccard similarity is percent / 100 or more. n_links is the number
    of other rows with which the row has a link, copies of it included. component_id is the least
    doc_id that can be reached over links, where rows of one doc_id reach each other whatever
    their texts are; a row without doc_id counts in links and leads on, but its component_id is
    null. Words are runs of non-space characters with A-Z lower-cased; texts are compared as
    128-bit, shingles as 64-bit hashes. Other columns of docs are ignored. bin_docs is only how
    many sets one task joins at a time, a long set counted as several.
    """
    digests = _digests(docs)
    texts = _texts(docs, digests, shingle_words, percent, bin_docs)
    leasts = texts.groupBy("label").agg(F.min("least").alias("least"))
    classes = texts.drop("least").join(leasts, "label")
    rows = digests.join(
        classes.select("first", "second", "n", "least", "links"), ["first", "second"], "left"
    )
    pairs = digests.where("doc_id is not null").distinct()
    several = pairs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if several.isEmpty():
        rows = rows.withColumn("c", F.coalesce("least", "doc_id"))
    else:  # the least id of each class, and ids with several texts, which join classes
        edges = rows.where("doc_id is not null").select(
            F.col("doc_id").alias("u"), F.coalesce("least", "doc_id").alias("v")
        )
        joined = components(edges).withColumnRenamed("node", "doc_id")
        rows = rows.join(joined, "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id"))
    return rows.select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def distinct_texts(docs: DataFrame) -> DataFrame:
    """docs with all columns, of each group of texts that can be reached over links the row with
    the least doc_id (a null one after all others), then digest, then text. doc_ids connect
    nothing here. Rows without words link with nothing and stay; those that have a doc_id and
    repeat in all columns, once."""
    digests = _digests(docs)
    texts = _texts(docs, digests, 5, 80, 2000)
    rank = F.struct(F.col("least").isNull().alias("unnamed"), "least", "first", "second")
    stay = texts.groupBy("label").agg(F.min(rank).alias("s")).select(
        F.col("s.first").alias("first"), F.col("s.second").alias("second"), F.col("s.least").alias("least")
    )
    held = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("first", "second"))])
    told = docs.mapInArrow(_told(docs.columns), held).select(
        F.struct(*docs.columns).alias("row"), "first", "second"
    )
    empty = told.where("first = 0 and second = 0")
    worded = (
        told.join(stay, ["first", "second"])
        .where(F.col("row.doc_id").cast("long").eqNullSafe(F.col("least")))
        .groupBy("first", "second")
        .agg(F.min_by("row", F.struct("row.text", F.xxhash64("row"))).alias("row"))
    )
    return (
        worded.select("row")
        .unionByName(empty.where("row.doc_id is not null").select("row").dropDuplicates(["row"]))
        .unionByName(empty.where("row.doc_id is null").select("row"))
        .select("row.*")
    )


#: A set of more shingles counts as several in the size of a bin.
SET_SHINGLES = 300


def _blocks(large: DataFrame, bin_docs: int) -> DataFrame:
    """(node, bin) for the sets of clusters larger than a bin. Sets with the same least prefix
    shingle stay together, few of them beside others, many in blocks of their own."""
    near = large.withColumn("near", F.array_min("shared")).drop("shared")
    sizes = near.groupBy("cluster", "near").agg(F.sum("load").alias("together"))
    parts = F.ceil(F.col("together") / bin_docs)
    beside = F.pmod(F.xxhash64("near"), F.ceil(F.col("m") / bin_docs))
    apart = F.xxhash64("cluster", "near", F.pmod(F.xxhash64("node"), parts))
    return near.join(sizes, ["cluster", "near"]).select(
        "node",
        F.when(4 * F.col("together") > bin_docs, apart)
        .otherwise(F.xxhash64("cluster", beside))
        .alias("bin"),
    )


def _bins(sets: DataFrame, bin_docs: int) -> DataFrame:
    """(node, bin, large): where each set is joined, and whether its cluster is larger than that.
    The size of a bin counts sets and their shingles, so that long texts do not fill a task."""
    postings = sets.select("node", F.explode("shared").alias("token"))
    lists = postings.groupBy("token").agg(F.min("node").alias("lead"))
    stars = postings.join(lists, "token").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    load = F.ceil(F.greatest("size", F.lit(1)) / SET_SHINGLES).alias("load")
    clusters = written(
        components(stars)
        .withColumnRenamed("component", "cluster")
        .join(sets.select("node", load), "node"),
        "clusters",
    )
    counts = clusters.groupBy("cluster").agg(F.sum("load").alias("m"))
    total = clusters.agg(F.sum("load")).first()[0] or 0
    placed = written(clusters.join(counts, "cluster"), "placed")
    spread = F.when(4 * F.col("m") > bin_docs, F.xxhash64("cluster")).otherwise(
        F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-total // bin_docs))))
    )
    small = placed.where(F.col("m") <= bin_docs).select("node", spread.alias("bin"))
    large = placed.where(F.col("m") > bin_docs).join(sets.select("node", "shared"), "node")
    return written(
        small.withColumn("large", F.lit(False)).unionByName(
            _blocks(large, bin_docs).withColumn("large", F.lit(True))
        ),
        "bins",
    )


def _link(sets: DataFrame, bin_docs: int, percent: int) -> DataFrame:
    """(node, label, links): components and weighted links of the sets in rarity order."""
    placed = _bins(sets, bin_docs)
    found = written(
        sets.join(placed, "node")
        .select("node", "tokens", "copies", "bin", "large")
        .groupBy("bin", "large")
        .applyInArrow(_link_bin(percent), "node long, label long, links long"),
        "labels",
    )
    large = placed.where("large").select("node", F.col("bin").alias("block"))
    if large.isEmpty():
        return found
    home = sets.join(large, "node").join(found.select("node", "label"), "node")
    across = written(_across(home, percent), "across")
    more = across.groupBy("node").agg(F.sum("links").alias("more"))
    counted = found.join(more, "node", "left").select(
        "node", "label", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links")
    )
    return written(_labels(counted, across.select("u", "v")), "labels")
