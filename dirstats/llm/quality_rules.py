"""Quality rules: a table of thresholds compiled into one projection of text ratios.

Everything is built-in expressions; a document is measured and judged in the task that reads it,
without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was be with as by this",
    "de": "der die und das den von zu in mit sich des auf ist im dem nicht ein eine",
    "fr": "de la le et les des en un une du que est pour qui dans au par",
    "es": "de la que el en y a los se del las un por con no una su para es",
}


@dataclass(frozen=True)
class Rule:
    """measure has to be from low to high; None leaves that side open. Documents of fewer than
    from_words words pass."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The default table. Measures are the columns of ``ratios``.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 18.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("exclamations", "exclamations_per_word", None, 0.1),
    Rule("stop_words", "stop_word_share", 0.03, None, from_words=50),
    Rule("repeated_lines", "dup_line_share", None, 0.5),
    Rule("echoed_words", "echo_share", None, 0.3, from_words=20),
    Rule("repeated_words", "repeat_word_share", None, 0.3),
)


def _outside(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeat_words(windows: Column) -> Column:
    """windows: sorted distinct starts of repeated windows; the words they cover."""
    steps = F.zip_with(
        windows,
        F.slice(windows, 2, F.greatest(F.size(windows), F.lit(1))),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _pairs(runs: str, step: int) -> Column:
    """Hashes of twice as long runs from hashes of runs of step words."""
    later = F.slice(F.col(runs), step + 1, F.greatest(F.size(runs), F.lit(1)))
    return F.zip_with(F.col(runs), later, lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame) -> DataFrame:
    """docs as a column ``row`` with base counts and ratios beside it. A null text counts as
    empty. Windows of a text are compared by 64-bit hashes."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    word = F.col("row_words")
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    df = docs.select(F.struct("*").alias("row")).withColumn("row_text", text)
    trimmed = F.btrim(F.col("row_text"), F.lit(SPACES))
    df = df.select(
        "row",
        "row_text",
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
        .alias("row_words"),
        F.filter(
            F.split(F.col("row_text"), "\n"),
            lambda line: F.btrim(line, F.lit(SPACES)) != "",
        ).alias("row_lines"),
    )
    df = df.select(
        "row",
        F.size(word).cast("long").alias("n_words"),
        _outside(F.col("row_text"), SPACES).cast("long").alias("word_chars"),
        (F.length("row_text") - _outside(F.col("row_text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("row_text") - _outside(F.col("row_text"), "!")).cast("long").alias("n_exclamations"),
        F.size("row_lines").alias("n_lines"),
        (F.size("row_lines") - F.size(F.array_distinct("row_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(word, lambda w: w.isin(stop))).alias("n_stop_words"),
        F.transform(word, lambda w: F.xxhash64(w)).alias("runs"),
    )
    next_word = F.slice(F.col("runs"), 2, F.greatest(F.size("runs"), F.lit(1)))
    echoes = F.filter(F.zip_with(F.col("runs"), next_word, lambda a, b: a == b), lambda same: same)
    df = df.withColumn("n_echoes", F.size(echoes))
    for step in (1, 2, 4):
        df = df.withColumn("runs", _pairs("runs", step))
    df = df.withColumn(
        "runs", F.slice("runs", 1, F.greatest(F.col("n_words") - WINDOW + 1, F.lit(0)).cast("int"))
    )
    # only texts with a repeated window go through the sort below
    df = df.withColumn(
        "runs",
        F.when(
            F.size(F.array_distinct("runs")) < F.size("runs"),
            F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    later = F.slice(F.col("runs"), 2, F.greatest(F.size("runs"), F.lit(1)))
    df = df.withColumn(
        "runs",
        F.zip_with(
            F.col("runs"),
            later,
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
        ),
    )
    df = df.withColumn(
        "runs",
        F.array_sort(F.array_distinct(F.flatten(F.filter("runs", lambda pair: pair.isNotNull())))),
    )
    df = df.withColumn("n_repeat_words", _repeat_words(F.col("runs")).cast("long")).drop("runs")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return df.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_exclamations", "n_words").alias("exclamations_per_word"),
        share("n_stop_words", "n_words").alias("stop_word_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_word_share"),
        share("n_echoes", "n_words").alias("echo_share"),
        (
            (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
        ).alias("base_failed"),
        # a filter on this column stays above the projection, which would else be computed for
        # the filter and again for what it keeps, once per place that names a column
        F.monotonically_increasing_id().alias("row_id"),
    )


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a measured document breaks, in the order of the table."""
    checks = []
    for rule in rules:
        value, broken = F.col(rule.measure), F.lit(False)
        if rule.low is not None:
            broken = broken | (value < rule.low)
        if rule.high is not None:
            broken = broken | (value > rule.high)
        checks.append(
            F.when(broken & (F.col("n_words") >= rule.from_words), F.lit(rule.name))
        )
    return F.filter(F.array(*checks), lambda name: name.isNotNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept and failed (names of broken rules).

    A null or empty text, or one of spaces only, has no words and fails. Repeated rows are each
    judged; a null doc_id stays null; other columns of docs are ignored, whatever their names.
    """
    return measured(docs).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size(failed_rules(rules)) == 0)).alias("kept"),
        failed_rules(rules).alias("failed"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all their columns."""
    return (
        measured(docs)
        .where(
            ~F.col("base_failed") & (F.size(failed_rules(rules)) == 0) & (F.col("row_id") >= 0)
        )
        .select("row.*")
    )
