"""Mixing documents to target weights of domains, with DataFrame functions only.

A naive Bayes classifier over binned measures of the text, counted on the labelled rows, gives every
document its domain posteriors. Document rates are fitted so that the expected tokens of each domain
meet the target weights: least squares over nonnegative rates by projected gradient steps, in which
each step needs one sum per domain over all documents and moves a document by a few numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import settled

BINS = 16
STEPS = 40
SETTLED = 1e-6
#: Target weights of the expected tokens.
TARGETS = {"good": 0.90, "poor": 0.10}
MEASURES = ("size", "upper", "marks", "high", "long", "lines")


def domain_of_labels() -> Column:
    """good, poor or toxic by the labels table; null where a label is missing."""
    return (F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic").isNull() | F.col("quality").isNull(), None)
            .when(F.col("quality") == 1, "good").otherwise("poor"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, tokens (words, at least 1) and the measures of every text; null is empty."""
    text = F.coalesce("text", F.lit(""))
    size, chars = F.octet_length(text).cast("double"), F.length(text).cast("double")
    words = F.regexp_count(text, F.lit(r"\S+"))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), size.alias("_size"), chars.alias("_chars"), words.alias("_words"),
                       (chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("_upper"),
                       (chars - F.length(F.translate(text, "!#$%&*|", ""))).alias("_marks"),
                       (chars - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("_lines"))
    per = F.greatest(F.col("_chars"), F.lit(1.0))
    tokens = F.greatest(F.col("_words"), F.lit(1)).cast("double")
    return base.select(
        "doc_id", "text_hash", tokens.alias("tokens"), F.log1p("_size").alias("size"), (F.col("_upper") / per).alias("upper"),
        (F.col("_marks") / per).alias("marks"), ((F.col("_size") - F.col("_chars")) / per).alias("high"),
        (F.col("_chars") / tokens).alias("long"), (F.col("_lines") / per).alias("lines"))


def _bin(name: str, edges: list[float]) -> Column:
    return sum((F.when(F.col(name) > edge, 1).otherwise(0) for edge in edges), F.lit(0))


def posteriors(rows: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """`rows` with `posterior`, an array in the order of `domains` that sums to 1.

    All labelled rows are counted. Without any, every domain is equally likely.
    """
    known = (labels.select("doc_id", domain_of_labels().alias("domain")).filter(F.col("domain").isin(domains))
             .groupBy("doc_id").agg(F.min("domain").alias("domain")))
    train = settled(rows.join(known, "doc_id").select("domain", *MEASURES))
    marks = [i / BINS for i in range(1, BINS)]
    cuts = train.agg(*[F.percentile_approx(m, marks, 1_000).alias(m) for m in MEASURES]).first()
    edges = {m: sorted(set(cuts[m] or [])) for m in MEASURES}
    binned = train.select("domain", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), _bin(m, edges[m]).alias("bin")) for m in MEASURES])).alias("x"))
    counts = {(r["measure"], r["bin"], r["domain"]): r["count"]
              for r in binned.select("domain", "x.*").groupBy("measure", "bin", "domain").count().collect()}
    totals = {d: sum(n for (m, _, k), n in counts.items() if k == d and m == MEASURES[0]) for d in domains}
    everything = sum(totals.values())
    logs = []
    for d in domains:
        score = F.lit(float(np.log((totals[d] + 1) / (everything + len(domains)))))
        for m in MEASURES:
            size = len(edges[m]) + 1
            table = [float(np.log((counts.get((m, b, d), 0) + 1) / (totals[d] + size))) for b in range(size)]
            score = score + F.element_at(F.array(*map(F.lit, table)), F.col(f"_{m}") + 1)
        logs.append(score)
    staged = rows.select("*", *[_bin(m, edges[m]).alias(f"_{m}") for m in MEASURES]).withColumn("_log", F.array(*logs))
    staged = staged.withColumn("_top", F.array_max("_log")).withColumn("_exp", F.transform("_log", lambda x: F.exp(x - F.col("_top"))))
    total = F.aggregate("_exp", F.lit(0.0), lambda s, x: s + x)
    return staged.withColumn("_sum", total).select(*rows.columns, F.transform("_exp", lambda x: x / F.col("_sum")).alias("posterior"))


def _rate(steps: list[list[float]]) -> Column:
    """The rate after the projected steps so far, from 1."""
    def step(rate, g):
        move = F.aggregate(F.zip_with("posterior", g, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.lit(0.0), rate - move)

    if not steps:
        return F.lit(1.0)
    return F.aggregate(F.array(*[F.array(*map(F.lit, g)) for g in steps]), F.lit(1.0), step)


def fit_rates(rows: DataFrame, targets: list[float]) -> Column:
    """Rate of each document of `rows(tokens, posterior)`, a written table, as an expression over `posterior`.

    Minimises the distance of the expected domain tokens to the targets over nonnegative rates. The
    gradient is scaled by the domains' second moments over the documents whose rate is above zero,
    and every step is projected to rates of at least zero. The domain with the largest target is
    taken once, which sets the total; the others follow, less or more often. Stops when all totals
    meet the targets, nothing moves, or after STEPS steps.
    """
    k = range(len(targets))
    share = [F.col("posterior")[i] for i in k]

    def sums(rate: Column) -> tuple[np.ndarray, np.ndarray] | None:
        row = rows.withColumn("_rate", rate).agg(
            *[F.sum(F.col("tokens") * share[i] * F.col("_rate")).alias(f"s{i}") for i in k],
            *[F.sum(F.when(F.col("_rate") > 0, F.col("tokens") * share[i] * share[j]).otherwise(0.0)).alias(f"m{i}_{j}") for i in k for j in k]).first()
        if row["s0"] is None:
            return None
        return np.array([row[f"s{i}"] for i in k]), np.array([[row[f"m{i}_{j}"] for j in k] for i in k])

    steps: list[list[float]] = []
    found = sums(_rate(steps))
    if found is None:
        return F.lit(1.0)
    weight = np.array(targets)
    goal = weight * found[0][weight.argmax()] / weight.max()
    for _ in range(STEPS):
        now, moments = found
        if np.abs(now - goal).max() <= SETTLED * goal.sum():
            break
        metric = np.linalg.inv(moments + (1e-9 * np.trace(moments) + 1e-12) * np.eye(len(targets)))
        steps.append([float(x) for x in metric @ (now - goal)])
        found = sums(_rate(steps))
        if np.abs(found[0] - now).max() <= 1e-9 * goal.sum():
            break
    return _rate(steps)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, text_hash, tokens, posterior, rate and copies for every row of `docs`.

    `copies` is the rate rounded down or up by a hash of the row, so that expected tokens follow the
    rates. Domains no label names leave the targets. Null texts are empty with one token; null ids
    have no label; repeated rows are rows of their own; an empty table gives no rows.
    """
    targets = targets or TARGETS
    present = {r["domain"] for r in labels.join(docs.select("doc_id").distinct(), "doc_id").select(domain_of_labels().alias("domain")).distinct().collect()}
    domains = [d for d in sorted(targets) if d in present] or sorted(targets)
    rows = settled(measured(docs))
    rows = settled(posteriors(rows, labels, domains).select("doc_id", "text_hash", "tokens", "posterior"))
    rate = fit_rates(rows, [targets[d] for d in domains])
    chance = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    return rows.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Rows of `docs`, all columns, each as often as its copies say."""
    plan = mix(docs, labels, targets).filter("copies <> 1").select("doc_id", F.col("text_hash").alias("_hash"), F.col("copies").alias("_copies"))
    plan = settled(plan.dropDuplicates(["doc_id", "_hash"]))
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    plan = plan.withColumnsRenamed({"doc_id": "_doc", "_hash": "_text"})
    joined = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_text")), "left")
    often = F.coalesce("_copies", F.lit(1))
    return joined.select(*[F.col(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(0), often)).alias("_copy")).drop("_copy")
