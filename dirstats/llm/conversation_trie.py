"""Prefix trie of conversations as a burst trie: shards hold containers of suffixes under the
heads of a trie.

All conversations start in one container under the root. A container with more rows than a task
should hold is burst: the turns that all its members share become a chain of trie nodes, and the
members move to one container for each next turn id. Containers that are left are sorted and
swept into nodes, each in one task; a container of a single sequence needs no sweep, as its
nodes can be said row by row, so a conversation of any length is spread over tasks. Sums over
subtrees go back up the heads, one pass for each level of bursting.

Equal conversations are one sequence with a weight. Turns are compared by 128 bits of a digest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirstats.llm.scratch import written

#: Rows of a container beyond which it is burst.
CONTAINER_ROWS = 1_024
#: Conversation ids that one row of a long list of them holds.
LISTED_IDS = 4_096
#: Turns that a conversation takes from the first one of its score, and the size of a score.
MOST_BORROWED, SCORE = 4, 20

NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
_KEY = ["kc", "kd"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def _borrowed(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % MOST_BORROWED


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, i1, i2, words, cum) per turn: its place in its conversation, from 1, its id
    in two halves, its words, and those up to it. Ranges cut long conversations; counts and sums
    inside of a range start from those before it."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    ranged = written(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "conv_id", digest.alias("digest"), _words(F.col("text")).cast("long").alias("words"),
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
        )
        .select("conv_id", _half(F.col("digest"), 1).alias("i1"), _half(F.col("digest"), 17).alias("i2"), "words", "part", "place"),
        "turns",
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("conv_id", "part")
        .agg(F.count("*").alias("n"), F.sum("words").alias("w"))
        .select(
            "conv_id", "part",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
            F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
        )
    )
    inside = Window.partitionBy("conv_id", "part").orderBy("place")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranged.select(
        "*", F.row_number().over(inside).alias("n"), F.sum("words").over(run).alias("w")
    )
    return written(
        numbered.join(offsets, ["conv_id", "part"]).select(
            "conv_id", (F.col("n_before") + F.col("n")).alias("pos"), "i1", "i2", "words",
            (F.col("w_before") + F.col("w")).alias("cum"),
        ),
        "placed",
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, d, i1, i2, before, cum) per turn of the rebuilt conversations, d from 1, with the
    words before it and up to it; and a row of d 0 for each conversation."""
    rows = placed(turns)
    h = _borrowed(F.col("conv_id"))
    heads = [
        F.sum(F.when(F.col("pos") <= k, F.col("words")).otherwise(0)).alias(f"w{k}")
        for k in range(1, MOST_BORROWED)
    ]
    convs = written(rows.groupBy("conv_id").agg(F.max("pos").alias("n"), *heads), "conversations")
    upto = F.when(h == 0, F.lit(0))
    for k in range(1, MOST_BORROWED):
        upto = upto.when(h == k, F.col(f"w{k}"))
    first = F.col("conv_id") - F.col("conv_id") % SCORE
    asks = convs.select("conv_id", h.alias("h"), first.alias("first"), upto.alias("left_words"))
    given = convs.select(
        F.col("conv_id").alias("first"), F.col("n").alias("n_first"),
        *(F.col(f"w{k}").alias(f"g{k}") for k in range(1, MOST_BORROWED)),
    )
    taken_words = F.when(F.col("h") == 0, F.lit(0))
    for k in range(1, MOST_BORROWED):
        taken_words = taken_words.when(F.col("h") == k, F.coalesce(F.col(f"g{k}"), F.lit(0)))
    joined = asks.join(given, "first", "left").select(
        "conv_id", "h", "first", "left_words",
        F.least("h", F.coalesce("n_first", F.lit(0))).alias("taken"),
        taken_words.alias("taken_words"),
    )
    plan = written(joined, "plan")
    lead = rows.where(F.col("pos") < MOST_BORROWED).withColumnRenamed("conv_id", "first")
    borrowed = (
        plan.select("conv_id", "first", "h")
        .join(lead, "first")
        .where(F.col("pos") <= F.col("h"))
        .select(
            "conv_id", F.col("pos").alias("d"), "i1", "i2", (F.col("cum") - F.col("words")).alias("before"), "cum"
        )
    )
    cum = F.col("cum") - F.col("left_words") + F.col("taken_words")
    own = (
        rows.where(F.col("pos") > h)
        .join(plan.select("conv_id", "h", "taken", "left_words", "taken_words"), "conv_id")
        .select(
            "conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "i1", "i2",
            (cum - F.col("words")).alias("before"), cum.alias("cum"),
        )
    )
    zero = F.lit(0).cast("long")
    roots = plan.select("conv_id", *(zero.alias(c) for c in ("d", "i1", "i2", "before", "cum")))
    return written(borrowed.unionByName(own).unionByName(roots), "rebuilt")


_CLASS = ["a1", "a2", "b1", "b2", "length", "total"]


def _lists(batches):
    """Rows in order of class and conversation: pieces of each class's list of conversations."""
    key, ids = None, []

    def piece(rows):
        rows.append((*key, ids[0], len(ids), ",".join(map(str, ids))))

    for batch in batches:
        rows = []
        for *now, conv in zip(*(batch.column(c).to_pylist() for c in [*_CLASS, "conv_id"]), strict=True):
            if now != key or len(ids) >= LISTED_IDS:
                if ids:
                    piece(rows)
                key, ids = now, []
            ids.append(conv)
        yield _pieces(rows)
    if ids:
        rows = []
        piece(rows)
        yield _pieces(rows)


def _pieces(rows) -> pa.RecordBatch:
    names = [*_CLASS, "first", "n", "ids"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    types = [pa.int64()] * (len(names) - 1) + [pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
    )


def _digests(batches):
    """Pieces in order of class and first conversation: per class its least conversation, its
    size, and the digest of its whole list, which goes through the digest piece by piece."""
    key = first = digest = None
    n = 0

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.int64()] * 4 + [pa.string()]
        names = ["s", "m", "length", "total", "sha"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
        )

    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in [*_CLASS, "first", "n", "ids"])
        for *now, start, size, ids in zip(*columns, strict=True):
            if now != key:
                if key is not None:
                    rows.append((first, n, key[4], key[5], digest.hexdigest()))
                key, first, n, digest = now, start, 0, hashlib.sha256()
            elif n:
                digest.update(b",")
            digest.update(ids.encode())
            n += size
        yield batch_of(rows)
    if key is not None:
        yield batch_of([(first, n, key[4], key[5], digest.hexdigest())])


def classes(rows: DataFrame) -> DataFrame:
    """(s, m, length, total, sha) per distinct sequence of turns: its least conversation, how many
    have it, its turns and words, and the digest of the list of them. Sequences are compared by
    128 bits summed over their turns, so no conversation is held whole."""
    low, high = F.lit(0xFFFFFFFF), 32
    x, y = F.xxhash64("d", "i1", "i2"), F.xxhash64("i2", "i1", "d", F.lit(1))
    keys = rows.groupBy("conv_id").agg(
        F.sum(x.bitwiseAND(low)).alias("a1"), F.sum(F.shiftrightunsigned(x, high)).alias("a2"),
        F.sum(y.bitwiseAND(low)).alias("b1"), F.sum(F.shiftrightunsigned(y, high)).alias("b2"),
        F.max("d").alias("length"), F.max("cum").alias("total"),
    )
    types = ", ".join(f"{c} long" for c in [*_CLASS, "first", "n"])
    pieces = (
        keys.select(*_CLASS, "conv_id")
        .repartitionByRange(*_CLASS, "conv_id")
        .sortWithinPartitions(*_CLASS, "conv_id")
        .mapInArrow(_lists, f"{types}, ids string")
    )
    return written(
        pieces.repartition(*_CLASS)
        .sortWithinPartitions(*_CLASS, "first")
        .mapInArrow(_digests, "s long, m long, length long, total long, sha string"),
        "sequences",
    )


_ROW = ["kc", "kd", "kp", "pk", "s", "m", "length", "total", "d", "i1", "i2", "before", "cum", "sha"]


def swept(rows: list[tuple]) -> list[tuple]:
    """The nodes of one container from its rows, in order of sequence and depth."""
    kc, kd, kp, pk = rows[0][:4]
    sequences: list[tuple[list, list]] = []
    for row in rows:
        if row[8] == kd:
            sequences.append(([], [row]))
        else:
            sequences[-1][0].append((row[9], row[10]))
            sequences[-1][1].append(row)
    sequences.sort(key=lambda x: x[0])
    head = sequences[0][1][0]
    # depth, conversation, parent, conversations, children, leaves, saved, words, digest
    nodes = [[kd, kc, -1, 0, 0, 0, 0, head[12] - head[11], _NO_ENDS]]
    path, last = [0], []
    for ids, own in sequences:
        same = 0
        while same < len(last) and same < len(ids) and last[same] == ids[same]:
            same += 1
        del path[same + 1 :]
        s, m = own[0][4], own[0][5]
        for row in own[same + 1 :]:
            nodes.append([row[8], s, path[-1], 0, 0, 0, 0, row[12] - row[11], _NO_ENDS])
            path.append(len(nodes) - 1)
        for k in path:
            nodes[k][1] = min(nodes[k][1], s)
            nodes[k][3] += m
        nodes[path[-1]][8] = own[-1][13]
        last = ids
    for node in reversed(nodes):  # children come after their parents
        node[6] += (node[3] - 1) * node[7]
        node[5] = node[5] or 1
        if node[2] >= 0:
            up = nodes[node[2]]
            up[4] += 1
            up[5] += node[5]
            up[6] += node[6]
    return [
        (c, d, nodes[p][1] if p >= 0 else kp, n, k, leaves, saved, sha, pk if p < 0 else None)
        for d, c, p, n, k, leaves, saved, _, sha in nodes
    ]


def _sweep(batches):
    names = [f.split()[0] for f in NODE.split(", ")] + ["pk"]
    types = [pa.int64()] * 7 + [pa.string(), pa.int64()]

    def batch_of(nodes):
        columns = list(zip(*nodes, strict=True)) if nodes else [[]] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
        )

    key, held = None, []
    for batch in batches:
        nodes = []
        for row in zip(*(batch.column(c).to_pylist() for c in _ROW), strict=True):
            if row[:2] != key:
                if held:
                    nodes += swept(held)
                key, held = row[:2], []
            held.append(row)
        yield batch_of(nodes)
    if held:
        yield batch_of(swept(held))


def _single(rows: DataFrame) -> DataFrame:
    """The nodes of containers of one sequence, row by row."""
    at_head = F.col("d") == F.col("kd")
    return rows.select(
        F.col("s").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(at_head, F.col("kp")).otherwise(F.col("s")).alias("parent_conv_id"),
        F.col("m").alias("n_convs"),
        (F.col("d") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("m") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"),
        F.coalesce("sha", F.lit(_NO_ENDS)).alias("ends_sha256"),
        F.when(at_head, F.col("pk")).alias("pk"),
    )


def _burst(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of containers that are burst: the chain of turns that all members of each share, and the
    rows of the members in containers by their next turn id."""
    within = F.col("d") > F.col("kd")
    per_depth = rows.where(within).groupBy(*_KEY, "d").agg(
        F.count("*").alias("n"), F.max("n_seq").alias("n_seq"),
        *(f(c).alias(f"{f.__name__}_{c}") for c in ("i1", "i2") for f in (F.min, F.max)),
    )
    parted = (
        (F.col("n") < F.col("n_seq"))
        | (F.col("min_i1") != F.col("max_i1"))
        | (F.col("min_i2") != F.col("max_i2"))
    )
    ends = written(
        per_depth.where(parted).groupBy(*_KEY).agg((F.min("d") - 1).alias("e")), "chains"
    )
    joined = rows.join(ends, _KEY)
    last = joined.where(F.col("d") == F.col("e")).groupBy(*_KEY).agg(
        F.max(F.when(F.col("length") == F.col("e"), F.col("sha"))).alias("pivot_sha"),
        F.max("cum").alias("pivot_cum"),
    )
    chain = (
        joined.where((F.col("s") == F.col("kc")) & (F.col("d") <= F.col("e")))
        .select(*_KEY, "kp", "pk", "d", "e", "n_convs", "before")
        .join(last, _KEY)
    )
    step = joined.where(F.col("d") == F.col("e") + 1).select("s", *_KEY, "i1", "i2")
    child = [*_KEY, "i1", "i2"]
    heads = step.groupBy(*child).agg(F.min("s").alias("cc"))
    members = written(step.join(heads, child).select("s", "cc"), "members")
    beyond = (
        joined.where(F.col("d") > F.col("e"))
        .join(members, "s")
        .select(
            F.col("cc").alias("kc"), (F.col("e") + 1).alias("kd"), F.col("kc").alias("kp"),
            F.col("kd").alias("pk"), *_ROW[4:],
        )
    )
    return written(chain, "heads"), beyond


def _headed(chain: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of the chains, from the heads of the containers below each chain's end."""
    sums = below.where("pk IS NOT NULL").groupBy(F.col("parent_conv_id").alias("kc"), F.col("pk").alias("kd")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    at_head, at_end = F.col("d") == F.col("kd"), F.col("d") == F.col("e")
    return chain.join(sums, _KEY).select(
        F.col("kc").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(at_head, F.col("kp")).otherwise(F.col("kc")).alias("parent_conv_id"),
        "n_convs",
        F.when(at_end, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * (F.col("pivot_cum") - F.col("before"))).alias("saved_tokens"),
        F.when(at_end, F.coalesce("pivot_sha", F.lit(_NO_ENDS))).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
        F.when(at_head, F.col("pk")).alias("pk"),
    )


def prefix_trie(turns: DataFrame, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    turns has conv_id, turn, role and text; other columns are ignored, whatever their names. The
    turns of a conversation are in order of turn, then role, then text, nulls first; repeated rows
    stay. A null role or text is empty. Rows with a null conv_id belong to no conversation and are
    left out. For a negative conv_id the remainder by 20 has its sign. Without turns there is no
    conversation and so no node, not even the root.
    """
    spark = turns.sparkSession
    rows = rebuilt(turns)
    sequences = classes(rows)
    least = sequences.agg(F.min("s")).first()[0]
    if least is None:
        return spark.createDataFrame([], NODE)
    sequence = sequences.withColumnRenamed("s", "conv_id")
    here = (
        rows.join(sequence, "conv_id")
        .withColumn("sha", F.when(F.col("d") == F.col("length"), F.col("sha")))
        .withColumnRenamed("conv_id", "s")
        .select(
            F.lit(least).cast("long").alias("kc"), F.lit(0).cast("long").alias("kd"),
            F.lit(None).cast("long").alias("kp"), F.lit(None).cast("long").alias("pk"), *_ROW[4:],
        )
    )
    leaves, chains = [], []
    while True:
        here = written(here, "containers")
        at_head = F.col("d") == F.col("kd")
        sizes = written(
            here.groupBy(*_KEY).agg(
                F.count("*").alias("n_rows"),
                F.sum(at_head.cast("long")).alias("n_seq"),
                F.sum(F.when(at_head, F.col("m")).otherwise(0)).alias("n_convs"),
            ),
            "sizes",
        )
        one = F.col("n_seq") == 1
        large = ~one & (F.col("n_rows") > container_rows)
        singles = here.join(sizes.where(one).select(*_KEY), _KEY)
        small = here.join(sizes.where(~one & ~large).select(*_KEY), _KEY)
        found = (
            small.select(*_ROW)
            .repartition(*_KEY)
            .sortWithinPartitions(*_KEY, "s", "d")
            .mapInArrow(_sweep, f"{NODE}, pk long")
        )
        leaves.append(written(_single(singles).unionByName(found), "nodes"))
        burst = sizes.where(large).select(*_KEY, "n_seq", "n_convs")
        if burst.isEmpty():
            break
        chain, here = _burst(here.join(burst, _KEY))
        chains.append(chain)
    below = leaves.pop()
    nodes = [below]
    while chains:
        head = written(_headed(chains.pop(), below), "nodes")
        below = head.unionByName(leaves.pop())
        nodes.append(below)
    whole = nodes[0]
    for part in nodes[1:]:
        whole = whole.unionByName(part)
    return whole.drop("pk")


#: ``prefix_trie`` over the table conversations, with crc32 bit by bit.
TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first,
         list_reduce(
           list_prepend(4294967295::BIGINT,
                        list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                       lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce(
             list_prepend(xor(a, b), list_transform(range(8), lambda x: 0::BIGINT)),
             lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))) AS folded
  FROM (SELECT DISTINCT conv_id FROM t)
), h AS (
  SELECT conv_id, first, xor(folded, 4294967295) % 4 AS h FROM c
), k AS (
  SELECT h.conv_id, least(h.h, (SELECT count(*) FROM t WHERE t.conv_id = h.first)) AS taken
  FROM h
), r AS (
  SELECT h.conv_id, t.pos AS d, t.role, t.text FROM h JOIN t ON t.conv_id = h.first AND t.pos <= h.h
  UNION ALL
  SELECT h.conv_id, k.taken + t.pos - h.h, t.role, t.text
  FROM h JOIN k USING (conv_id) JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h
), s AS (
  SELECT h.conv_id,
         coalesce(list(length(r.role) || ':' || r.role || r.text ORDER BY r.d)
                  FILTER (r.d IS NOT NULL), []) AS turns,
         coalesce(list(len(regexp_extract_all(r.text, '[^\\x20\\x09-\\x0D]+')) ORDER BY r.d)
                  FILTER (r.d IS NOT NULL), []) AS words
  FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id
), x AS (
  SELECT conv_id, d, sha256(CAST(turns[1:d] AS VARCHAR)) AS node,
         CASE WHEN d > 0 THEN sha256(CAST(turns[1:d - 1] AS VARCHAR)) END AS up,
         CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(turns) AS ends
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM s)
), n AS (
  SELECT d, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(words) AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                         FILTER (ends), '')) AS ends_sha256
  FROM x GROUP BY d, node
), ch AS (
  SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2
), m AS (
  SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch USING (d, node)
), below AS (
  SELECT a.d, a.node, sum(b.own) AS saved_tokens,
         count(*) FILTER (b.n_children = 0) AS n_leaves
  FROM (SELECT DISTINCT a.d, a.node, b.d AS bd, b.node AS bnode
        FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.d >= a.d) a
  JOIN m b ON b.d = a.bd AND b.node = a.bnode GROUP BY 1, 2
)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs,
       CAST(m.n_children AS BIGINT) AS n_children, CAST(below.n_leaves AS BIGINT) AS n_leaves,
       CAST(below.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN below USING (d, node) LEFT JOIN n p ON p.d = m.d - 1 AND p.node = m.up
"""
