"""The burst trie against dictionaries of prefixes, with containers of every size."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from dirstats.llm import conversation_trie as ct

TURNS = "conv_id long, turn long, role string, text string, depth string, s int, kc string"


def plain(rows):
    """Node rows from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    first = lambda x: (x is not None, x)  # noqa: E731  nulls first
    for c, turn, role, text in sorted(
        (r for r in rows if r[0] is not None),
        key=lambda r: (r[0], first(r[1]), r[2] or "", r[3] or ""),
    ):
        own[c].append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(who) - 1) * words
    out = []
    for k, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(made[c]) == len(k))
        out.append(
            (
                min(who), len(k), min(members[k[:-1]]) if k else None, len(who), children[k],
                leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)


def nodes(df):
    return sorted(map(tuple, df.collect()), key=str)


def odd_rows():
    rng, rows = random.Random(7), []
    words = ["a", "b c", " d\te ", "", None]
    for c in [*range(60), 105, 119, 121, 400]:
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(words)))
    for c in range(200, 260):  # copies of one long conversation, and near copies
        long = [(c, t, "user", f"turn {t}") for t in range(40)]
        rows += long if c % 3 else long[: c % 37]
    rows += [(300, None, "user", "x"), (300, None, "user", "x"), (300, 0, "a", "y"), (300, 0, "a", "x")]
    rows += [(None, 0, "user", "lost"), (None, 1, None, None)]
    rows += [(301, t, "user", "w " * 50) for t in range(300)]
    return rows


@pytest.mark.parametrize("container_rows", [ct.CONTAINER_ROWS, 20])
def test_equals_the_plain_version(spark, container_rows):
    rows = odd_rows()
    got = ct.prefix_trie(frame(spark, rows), container_rows)
    assert nodes(got) == plain(rows)


def test_long_lists_of_copies(spark, monkeypatch):
    monkeypatch.setattr(ct, "LISTED_IDS", 4)
    rows = [(20 * c, t, "user", f"same {t}") for c in range(150) for t in range(4)]
    assert nodes(ct.prefix_trie(frame(spark, rows), 100)) == plain(rows)


def test_conversations_of_the_tables(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    got = nodes(ct.prefix_trie(turns, 100))
    assert got == plain(rows)
    assert nodes(ct.prefix_trie(turns)) == got


def test_one_conversation_and_none(spark):
    rows = [(21, 0, "user", "hi")]
    assert nodes(ct.prefix_trie(frame(spark, rows))) == plain(rows)
    assert ct.prefix_trie(frame(spark, rows).limit(0)).count() == 0
    assert ct.prefix_trie(frame(spark, [(None, 0, "user", "hi")])).count() == 0


def test_sql_gives_the_same_nodes(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = con.sql(ct.TRIE_SQL)
    want = ct.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rows = found.project(", ".join(want.columns)).fetchall()
    assert sorted(rows, key=str) == nodes(want)
