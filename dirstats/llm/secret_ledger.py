"""Secret scans over an incremental ledger of blobs.

A text is named by its SHA-256. The ledger holds one row per blob and rule version that was
scanned, with the findings. A run scans only the blobs that the ledger lacks for the present
rules, one copy of each, and joins the findings of all blobs back to every document that holds
them. The rule version is a digest of the rules, so changed rules scan everything again and the
old findings stay for whoever asks for the old version.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from dirstats.llm.scratch import new_path, written


@dataclass(frozen=True)
class SecretRule:
    """Matches of pattern, leftmost and without overlap, whose group has at least shortest
    characters. base: part of the fixed digest. needs: a text without any of these byte strings
    (compared in lower case) has no match."""

    kind: str
    pattern: str
    group: int
    shortest: int
    base: bool = True
    needs: tuple[str, ...] = ()


# The three base kinds, in their fixed order, and the kinds added to them.
RULES = (
    SecretRule(
        "assign",
        r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        needs=("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, needs=("akia",)),
    SecretRule("hex", r"[0-9a-f]+", 0, 24),
    SecretRule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----",
        0,
        40,
        base=False,
        needs=("private key",),
    ),
    SecretRule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, base=False, needs=("gh",)),
    SecretRule(
        "web_token",
        r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
        0,
        36,
        base=False,
        needs=("eyj",),
    ),
)
#: Long runs only: every match that is long enough, found without stopping at the short ones.
_RUN = re.compile(r"\[[^]]+\]\+")


def rule_version(rules: tuple[SecretRule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules: tuple[SecretRule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of every match, by start and then by rule; code points."""
    low = text.encode("utf-8", "surrogatepass").lower()
    out = []
    for k, rule in enumerate(rules):
        if rule.needs and not any(x.encode() in low for x in rule.needs):
            continue
        pattern = rule.pattern
        if _RUN.fullmatch(pattern):  # a run of one class: shorter runs fail as a whole
            pattern = f"{pattern[:-1]}{{{rule.shortest},}}"
        for m in re.finditer(pattern, text):
            if len(m[rule.group]) >= rule.shortest:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def _schema(rules: tuple[SecretRule, ...]) -> T.StructType:
    counts = [T.StructField(f"n_{r.kind}", T.LongType()) for r in rules if r.base]
    texts = [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    return T.StructType([T.StructField("blob", T.StringType()), *counts, *texts])


def _scanner(rules: tuple[SecretRule, ...]):
    base = [k for k, r in enumerate(rules) if r.base]

    def name(found: Iterable[tuple[int, int, int]]) -> str:
        return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in found)

    def scan(batches):
        for batch in batches:
            columns = [[] for _ in range(len(base) + 2)]
            for text in batch.column("text"):
                found = find(text.as_py() or "", rules)
                fixed = name(x for x in found if x[1] in base)
                for column, k in zip(columns, base, strict=False):
                    column.append(sum(x[1] == k for x in found))
                columns[-2].append(hashlib.sha256(fixed.encode()).hexdigest())
                columns[-1].append(name(found))
            counts = [pa.array(c, pa.int64()) for c in columns[:-2]]
            texts = [pa.array(c, pa.string()) for c in columns[-2:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), *counts, *texts],
                names=[f.name for f in _schema(rules).fields],
            )

    return scan


def _ledger(docs: DataFrame, path: str, rules: tuple[SecretRule, ...]) -> DataFrame | None:
    """Findings of the present rules that the ledger holds, or None before the first run."""
    try:
        known = docs.sparkSession.read.schema(_schema(rules)).parquet(
            f"{path}/rules={rule_version(rules)}"
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return known.dropDuplicates(["blob"])  # a run that broke off may have left its rows twice


def scan_secrets(
    docs: DataFrame, ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, blob, a count per base rule, base_sha256
    and spans (kind:start:end of all matches, in code points, by start and then by rule).

    ledger is the folder of the ledger, in storage that all executors share; without one the run
    starts from an empty ledger. New findings are appended to it before they are joined back.
    A null text counts as empty. Repeated rows each get a row, a null doc_id stays null, and
    other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "secret-ledger")
    texts = docs.select(
        F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).withColumn("blob", F.sha2(F.col("text"), 256))
    # one text per blob, whatever ids its rows have; a task sends each of its blobs once
    todo = texts.groupBy("blob").agg(F.first("text").alias("text"))
    known = _ledger(docs, ledger, rules)
    if known is not None:
        todo = todo.join(known.select("blob"), "blob", "left_anti")
    found = todo.select("blob", "text").mapInArrow(_scanner(rules), _schema(rules))
    found.write.mode("append").parquet(f"{ledger}/rules={rule_version(rules)}")
    # from a table, so that both sides are dealt out right below the join and a blob that very
    # many rows share can be split
    findings = written(_ledger(docs, ledger, rules), "findings")
    return texts.select("doc_id", "blob").join(findings, "blob").select("doc_id", *_schema(rules).names)


def redact(docs: DataFrame, mark: str = "[SECRET]", ledger: str | None = None) -> DataFrame:
    """docs with every found span of text replaced by mark; overlapping spans as one. All rows
    and columns stay, and n_chars, where there is such a column, counts the new text."""
    blob = F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256)
    found = scan_secrets(docs, ledger).where("spans <> ''").select("blob", "spans").distinct()
    both = (
        docs.select(F.struct("*").alias("row"))
        .withColumn("blob", blob)
        .join(found, "blob", "left")
    )
    spans = F.transform(
        F.split("spans", ","),
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("a"),
            F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("b"),
        ),
    )
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state, span):
        gap = F.substring(F.col("row.text"), state["at"] + 1, span["a"] - state["at"])
        return F.when(
            span["a"] >= state["at"],
            F.struct(
                F.concat(state["done"], gap, F.lit(mark)).alias("done"),
                span["b"].alias("at"),
            ),
        ).otherwise(
            F.struct(state["done"].alias("done"), F.greatest(state["at"], span["b"]).alias("at"))
        )

    clean = F.aggregate(
        spans,
        start,
        step,
        lambda s: F.concat(
            s["done"], F.substring(F.col("row.text"), s["at"] + 1, F.length("row.text"))
        ),
    )
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(clean)
    changed = both.withColumn("new_text", text)
    columns = [
        F.col("new_text").alias("text")
        if f.name == "text"
        else F.when(F.col("spans").isNull(), F.col("row.n_chars"))
        .otherwise(F.length("new_text"))
        .cast(f.dataType)
        .alias("n_chars")
        if f.name == "n_chars"
        else F.col("row").getField(f.name).alias(f.name)
        for f in docs.schema.fields
    ]
    return changed.select(*columns)
