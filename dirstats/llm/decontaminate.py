"""Benchmark decontamination by a prefix-filtered set join, in built-in operations.

Every benchmark item is cut into windows of consecutive words. A window that occurs in a document
shares all of its words, so one of them is enough to find it: the necessary prefix of a
containment of 1 is the rarest token. Tokens are ordered by how many windows hold them (longer
words first among equals), and the window is looked up under its rarest one. A hit says where the
window would begin; beginnings outside of the document and documents shorter than the window are
left out, and the words in between are compared exactly.

The windows travel to the documents: below a stated size they are broadcast, so that documents
are read and judged in place and only hits are shuffled; beyond it, the exploded words are
shuffled to the windows, each with the words around it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of at most this many bytes are sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(
        F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>")
    )


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win): the distinct windows of each item. An item of fewer words is one window,
    one without words has none."""
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
        .where("item_id is not null and size(w) > 0")
        .select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.slice("w", F.col("s"), window).alias("win"))
        .distinct()
    )


def signatures(windows: DataFrame) -> DataFrame:
    """(word, at, win): each distinct window once, under its rarest word, which stands at place
    ``at`` of the window."""
    wins = windows.select("win").distinct()
    counts = wins.select(F.explode(F.array_distinct("win")).alias("word")).groupBy("word").count()
    ranked = (
        wins.select("win", F.posexplode("win").alias("at", "word"))
        .join(counts, "word")
        .groupBy("win")
        .agg(F.min(F.struct("count", (-F.length("word")).alias("l"), "word", "at")).alias("first"))
    )
    return ranked.select("first.word", "first.at", "win")


def _hits(docs: DataFrame, marks: DataFrame, window: int, small: bool) -> DataFrame:
    """(row_id, doc_id, n_words, start, win): one row per occurrence of a window, and at least
    one with a null win per document."""
    exploded = docs.select(
        "row_id", "doc_id", "w", F.posexplode_outer("w").alias("pos", "word")
    )
    if small:
        inside = F.slice("w", F.col("pos") - F.col("at") + 1, F.size("win")) == F.col("win")
        both = exploded.join(F.broadcast(marks), "word", "left")
        n_words, start = F.size("w"), F.col("pos") - F.col("at")
    else:
        first = F.greatest(F.col("pos") - window + 1, F.lit(0))
        exploded = exploded.select(
            "row_id", "doc_id", "pos", "word", F.size("w").alias("n"),
            first.alias("first"), F.slice("w", first + 1, 2 * window - 1).alias("near"),
        )
        both = exploded.join(marks, "word", "left")
        n_words, start = F.col("n"), F.col("pos") - F.col("at")
        inside = F.slice("near", start - F.col("first") + 1, F.size("win")) == F.col("win")
    fits = (F.col("pos") >= F.col("at")) & (start + F.size("win") <= n_words)
    # a case evaluates the comparison only where the bounds hold
    found = F.coalesce(F.when(F.col("win").isNull() | ~fits, F.lit(False)).otherwise(inside), F.lit(False))
    return (
        both.where(found | F.col("pos").isNull() | (F.col("pos") == 0))
        .select(
            "row_id",
            "doc_id",
            n_words.cast("long").alias("n_words"),
            F.when(found, start).alias("start"),
            F.when(found, F.col("win")).alias("win"),
        )
    )


def _covered(spans: Column) -> Column:
    """Words under sorted (start, n) spans that may overlap."""
    end = lambda s: s["start"] + s["n"]
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["sum"] + F.greatest(F.lit(0), end(s) - F.greatest(s["start"], a["end"]))).alias("sum"),
            F.greatest(a["end"], end(s)).alias("end"),
        ),
        lambda a: a["sum"].cast("long"),
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit (words inside of any
    occurrence of a window of any item), n_items (items with such a window), items_sha256 (of
    their ids, sorted as strings and comma-joined) and contaminated (n_hit > 0).

    A null text has no words, and an item with a null id or without words no windows; without
    items every document is clean. Item rows with one id count as one item. Repeated rows of
    docs each get a row, a null doc_id stays null, other columns are ignored.
    """
    windows = item_windows(items, window).cache()
    marks = signatures(windows)
    size = marks.agg(
        F.sum(F.octet_length("word") + F.octet_length(F.array_join("win", " ")) + 8 * window + 64)
    ).first()[0]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        words_of(F.col("text")).alias("w"),
    )
    hits = _hits(rows, marks, window, (size or 0) <= broadcast_bytes).withColumn(
        "win_id", F.sha2(F.array_join("win", " "), 256)
    )
    span = F.when(F.col("start").isNotNull(), F.struct("start", F.size("win").alias("n")))
    per_doc = hits.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        _covered(F.array_sort(F.collect_list(span))).alias("n_hit"),
        F.collect_set("win_id").alias("wins"),
    )
    names = windows.select("item_id", F.sha2(F.array_join("win", " "), 256).alias("win_id"))
    return (
        per_doc.select("row_id", "doc_id", "n_words", "n_hit", F.explode_outer("wins").alias("win_id"))
        .join(names, "win_id", "left")
        .groupBy("row_id")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.first("n_hit").alias("n_hit"),
            F.array_sort(F.collect_set("item_id")).alias("items"),
        )
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def clean_of(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs whose text holds no window of any item, with all their columns."""
    name = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    named = docs.select(F.struct("*").alias("row"), name.alias("name"))
    dirty = (
        contamination(docs.select(name.alias("doc_id"), "text"), items, window)
        .where("contaminated")
        .select(F.col("doc_id").alias("name"))
        .distinct()
    )
    return named.join(dirty, "name", "left_anti").select("row.*")
