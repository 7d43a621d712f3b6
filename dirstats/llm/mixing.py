"""Mixing to target weights by soft membership, in built-in operations.

A classifier learned from a labelled table gives every document a probability for each domain.
Documents then get non-negative rates such that the expected tokens per domain, the sum of
rate x tokens x probability, match the targets: least squares by projected gradient steps, in
which the executors sum the gradient over all documents and only one number per domain reaches
the driver. A rate is a function of a document's probabilities and of the steps so far, so no
rates are stored or exchanged between the steps.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirstats.llm.scratch import written

#: Domains of the labelled table and their shares of the tokens of the mix.
TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}
#: The classifier is fitted on at most so many labelled documents, chosen by a hash of their id.
TRAIN_ROWS = 20_000
#: Words fall into so many buckets, which bounds the table of weights that is broadcast.
BUCKETS = 1 << 17
#: Pseudo-documents by which a bucket's evidence is held back.
PRIOR_DOCS = 5.0
#: A bucket counts only if some domain's share of its documents is off by so many standard
#: errors from that domain's share of all marks.
SURE = 4.0
#: ... and if the evidence for some domain exceeds that for another by so much (natural log);
#: many slight differences would otherwise decide about long texts.
TELLING = 2.5
MOST_STEPS = 60
#: Greatest error of a domain's share at which the steps end.
TOLERANCE = 1e-4


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domain of a labelled row; null where the labels say too little."""
    return (
        F.when(toxic == 1, F.lit("toxic"))
        .when(quality == 1, F.lit("good"))
        .when(quality == 0, F.lit("poor"))
    )


def _buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """docs without text, and the buckets of each text's marks: distinct words, runs of signs,
    and a mark for how varied the words are. The words are a column of their own, so that they
    are taken once for all three places that use them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+|[^\p{L}\s]+"), F.lit(0))
    marked = docs.withColumn("parts", words).withColumn("kinds", F.array_distinct("parts"))
    varied = F.floor(10 * F.size("kinds") / F.greatest(F.size("parts"), F.lit(1)))
    marks = F.concat("kinds", F.array(F.concat(F.lit("varied "), varied.cast("string"))))
    return marked.withColumn(
        "buckets", F.transform(marks, lambda m: F.pmod(F.xxhash64(m), F.lit(buckets)))
    ).drop("text", "parts", "kinds")


def labelled_sample(labels: DataFrame, domains: list[str], train_rows: int) -> DataFrame:
    """(doc_id, domain) of at most train_rows labelled documents, by a hash of their id."""
    domain = domain_of(F.col("quality"), F.col("toxic"))
    return (
        labels.select("doc_id", domain.alias("domain"))
        .where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )


def weights(
    texts: DataFrame, sample: DataFrame, domains: list[str], buckets: int = BUCKETS
) -> DataFrame:
    """The table (bucket, w0, w1, ...) of a mark's log odds for each domain, of at most
    ``buckets`` rows; empty without labelled documents."""
    k = range(len(domains))
    each = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    train = texts.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # outer, as a filter on the array would take its words a second time
    found = _buckets(train, buckets).select("domain", F.explode_outer("buckets").alias("bucket"))
    counts = written(found.groupBy("bucket").agg(F.count("*").alias("n"), *each), "marks")
    marks = counts.agg(F.sum("n"), *(F.sum(f"n{i}") for i in k)).first()
    if not marks[0]:
        return counts.select("bucket", *(F.lit(0.0).alias(f"w{i}") for i in k))
    shares = [marks[i + 1] / marks[0] for i in k]
    errors = [
        F.abs(F.col(f"n{i}") - F.col("n") * F.lit(q)) / F.sqrt(F.col("n") * F.lit(max(q * (1 - q), 1e-9)))
        for i, q in enumerate(shares)
    ]
    logs = [
        F.log((F.col(f"n{i}") + PRIOR_DOCS) / (F.col("n") * F.lit(q) + PRIOR_DOCS)).alias(f"w{i}")
        for i, q in enumerate(shares)
    ]
    w = [F.col(f"w{i}") for i in k]
    sure = counts.where(F.greatest(*errors, F.lit(0.0)) >= SURE).select("bucket", *logs)
    return sure.where(F.greatest(*w, F.lit(-99.0)) - F.least(*w, F.lit(99.0)) >= TELLING)


def biases(sums: DataFrame, sample: DataFrame, domains: list[str]) -> list[float | None]:
    """What is added to a domain's evidence so that the probabilities of the sample add up to
    its documents of each domain; this is also how the absence of marks counts. None for a domain
    that no document of the sample has, if it has any. Rows of one document count as one, with
    their mean evidence, so at most the sample's rows reach the driver."""
    mean = [F.avg(f"s{i}").alias(f"s{i}") for i in range(len(domains))]
    rows = sums.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "domain").agg(*mean).collect()
    if not rows:
        return [0.0] * len(domains)
    evidence = np.array([[r[f"s{i}"] for i in range(len(domains))] for r in rows])
    shares = np.array([sum(r["domain"] == d for r in rows) for d in domains]) / len(rows)
    there = shares > 0
    evidence, shares = evidence[:, there], shares[there]
    bias = np.log(shares)
    for _ in range(200):
        logits = evidence + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        mean = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
        move = np.log(shares / np.maximum(mean, 1e-12))
        bias = bias + move
        if np.abs(move).max() < 1e-4:
            break
    found = iter((bias - bias.max()).tolist())
    return [next(found) if x else None for x in there]


def memberships(
    docs: DataFrame, labels: DataFrame, domains: list[str], train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """(doc_id, name, n_tokens, p0, p1, ...) per row of docs; name is a digest of the text. The
    probability is null for a domain that no labelled document of docs has."""
    k = range(len(domains))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sample = written(labelled_sample(labels, domains, train_rows), "sample")
    table = weights(texts, sample, domains)
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    n_tokens = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    rows = texts.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        F.sha2("text", 256).alias("name"),
        n_tokens.cast("long").alias("n_tokens"),
        "text",
    )
    # a bucket of weight 0 that every text has: marks without weight fall out at the join
    everywhere = F.lit(-1).cast("long")
    none = docs.sparkSession.range(1).select(everywhere.alias("bucket"), *(F.lit(0.0).alias(f"w{i}") for i in k))
    held = _buckets(rows, BUCKETS).withColumn("bucket", F.explode_outer(F.concat("buckets", F.array(everywhere))))
    sums = written(
        held.drop("buckets")
        .join(F.broadcast(table.unionByName(none)), "bucket")
        .groupBy("row_id", "doc_id", "name", "n_tokens")
        .agg(*(F.sum(f"w{i}").alias(f"s{i}") for i in k))
        .drop("row_id"),
        "evidence",
    )
    bias = biases(sums, sample, domains)
    logits = {i: F.col(f"s{i}") + F.lit(bias[i]) for i in k if bias[i] is not None}
    top = F.greatest(*logits.values()) if len(logits) > 1 else next(iter(logits.values()))
    powers = {i: F.exp(x - top) for i, x in logits.items()}
    total = sum(powers.values(), F.lit(0.0))
    p = [powers[i] / total if i in powers else F.lit(None).cast("double") for i in k]
    return sums.select("doc_id", "name", "n_tokens", *(p[i].alias(f"p{i}") for i in k))


def _rate(steps: list[tuple[float, np.ndarray]], k: int, ahead: float | None = None) -> Column:
    """The rate after steps (momentum, direction): each carries the rate on by its last change
    times the momentum, moves it against the direction along the document's probabilities, and
    lifts it to 0 if it is negative. With ahead, the point that the next step starts from."""
    pair = F.struct(F.lit(1.0).alias("last"), F.lit(1.0).alias("now"))
    carried = lambda r, momentum: r["now"] + (r["now"] - r["last"]) * momentum

    def move(r, step):
        along = sum((F.col(f"p{i}") * step[i + 1] for i in range(1, k)), F.col("p0") * step[1])
        return F.struct(
            r["now"].alias("last"),
            F.greatest(F.lit(0.0), carried(r, step[0]) - along).alias("now"),
        )

    def end(r):
        return r["now"] if ahead is None else carried(r, F.lit(ahead))

    if not steps:
        return F.lit(1.0)
    table = F.array(*(F.array(*(F.lit(float(x)) for x in [m, *d])) for m, d in steps))
    return F.aggregate(table, pair, move, end)


def fit_rates(members: DataFrame, shares: list[float]) -> Column:
    """The rate of a row of members, such that expected tokens per domain have the given shares
    of all tokens, or 1 where no share is above 0: accelerated projected gradient steps, whose momentum starts anew whenever the
    residual grows. They are taken in the metric of the tokens and scaled by the domains' own
    products, so that a step length of 1 is always safe. The rate is that after the best step;
    a warning tells shares that it misses by more than TOLERANCE."""
    k = len(shares)
    p = [F.col(f"p{i}") for i in range(k)]
    products = members.agg(
        F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * p[i] * p[j]) for i in range(k) for j in range(k))
    ).first()
    total = float(products[0] or 0)
    if not total or not sum(shares):
        return F.lit(1.0)
    scale = np.array([float(x) for x in products[1:]]).reshape(k, k) / total
    inverse = np.linalg.inv(scale + 1e-9 * np.eye(k))
    goal = np.array(shares) / sum(shares)

    steps: list[tuple[float, np.ndarray]] = []
    age, last, best, best_at = 1.0, np.inf, np.inf, 0
    least, least_at, missed = np.inf, 0, goal
    for _ in range(MOST_STEPS):
        following = (1 + np.sqrt(1 + 4 * age * age)) / 2
        momentum = (age - 1) / following
        # the residual at the present rates, to stop, and at the point of the next step
        now, ahead = _rate(steps, k), _rate(steps, k, momentum)
        drawn = members.select(*p, (now * F.col("n_tokens")).alias("now"), (ahead * F.col("n_tokens")).alias("ahead"))
        sums = drawn.agg(*(F.sum(F.col(c) * x) for c in ("now", "ahead") for x in p)).first()
        at, further = np.array([float(x) for x in sums]).reshape(2, k) / total - goal
        worst = float(np.abs(at).max())
        if worst < least:
            least, least_at, missed = worst, len(steps), at
        if worst < 0.99 * best:
            best, best_at = worst, len(steps)
        if worst < TOLERANCE or len(steps) - best_at >= 12:
            break
        off = float(at @ inverse @ at)
        if off > last:
            age, momentum, further, following = 1.0, 0.0, at, (1 + np.sqrt(5)) / 2
        last, age = off, following
        steps.append((momentum, inverse @ further))
    if least > TOLERANCE:
        off_by = ", ".join(f"{x:+.2g}" for x in missed)
        warnings.warn(f"the mix misses its shares {goal.tolist()} by {off_by}", stacklevel=2)
    return _rate(steps[:least_at], k)


def rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, the probability of each domain
    as p_<domain>, and rate, how often the mix draws the document in expectation.

    labels has doc_id, quality and toxic; rows whose labels are null are not learned from, and
    of several rows of one document the least domain counts. targets gives each domain's share
    of the tokens; the mix has as many tokens as docs. A null text counts as empty and has no
    tokens: it gets a rate like any other but adds nothing. Without labels all domains are
    equally likely. A domain that no labelled document of docs has cannot be told or drawn: its
    probability is 0 and the other targets are scaled up to make up for it. Repeated rows each
    get a row, a null doc_id stays null, other columns are ignored.
    """
    found, rate, domains = _fitted(docs, labels, targets or TARGETS, train_rows)
    named = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)]
    return found.select("doc_id", "n_tokens", *named, rate.alias("rate"))


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """docs with all their columns, and rate as a further column (named mix_rate where docs have
    a column rate)."""
    found, rate, _ = _fitted(docs, labels, targets or TARGETS, train_rows)
    new = "mix_rate" if "rate" in (c.lower() for c in docs.columns) else "rate"
    per_text = found.select("name", rate.alias("found")).groupBy("name").agg(F.min("found").alias("found"))
    name = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    named = docs.select(F.struct("*").alias("row"), name.alias("name"))
    return named.join(per_text, "name").select("row.*", F.col("found").alias(new))


def draw(rows: DataFrame, rate: str = "rate") -> DataFrame:
    """Each row as often as the mix draws it: the whole part of its rate, and once more if a
    number in [0, 1) that a hash of doc_id and text gives is below the rest. Rows of rate 1 and
    more all stay, and the same input always gives the same rows. A further column copy (named
    mix_copy where rows have a column copy) numbers the copies of a row from 0. A null rate
    draws nothing."""
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("draw")), 11) / F.lit(float(1 << 53))
    whole = F.floor(rate)
    times = whole + (chance < F.col(rate) - whole).cast("long")
    copy = "mix_copy" if "copy" in (c.lower() for c in rows.columns) else "copy"
    # a sequence from 0 would count down for no copies
    numbers = F.slice(F.sequence(F.lit(0), times.cast("int")), 1, times.cast("int"))
    return rows.select("*", F.explode(numbers).alias(copy))


def _fitted(docs, labels, targets, train_rows) -> tuple[DataFrame, Column, list[str]]:
    domains = sorted(targets)
    found = written(memberships(docs, labels, domains, train_rows), "memberships")
    names = [f"p{i}" for i in range(len(domains))]
    first = found.select(names).first()
    shares = [targets[d] if first and first[i] is not None else 0.0 for i, d in enumerate(domains)]
    found = found.fillna(0.0, names)
    return found, fit_rates(found, shares), domains
