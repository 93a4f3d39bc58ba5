"""Mixing, quality, toxicity and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def small(documents, spark, n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["red", "green", "blue", "house", "tree", "water"]) + rng.choice(["", "s", "y"]) for _ in range(rng.randrange(5, 80))]
        toxic, poor = i % 7 == 0, i % 7 and i % 5 == 0
        if toxic:
            words[::6] = [rng.choice(["blorgish", "snarfy"]) for _ in words[::6]]
        text = " ".join(words)
        rows.append((i, text.upper() + "!!!" if poor else text))
        if i % 2:
            labels.append((i, int(not poor), int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "red tree"), (n + 2, "green " * 30_000), (3, rows[3][1])]
    labels += [(None, 1, 1), (n + 9, 1, 0), (5, None, None), (labels[0])]
    return rows, documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def test_toxicity(spark, documents):
    from scanweave.llm.toxicity import drop_toxic, score_toxicity

    rows, docs, labels = small(documents, spark)
    got = score_toxicity(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == (r["doc_id"] % 7 == 0) for r in known]) > 0.95
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if not r["predicted"])
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert all(r["score"] == 0 for r in score_toxicity(docs, labels.limit(0)).collect())


def test_quality(spark, documents):
    from scanweave.llm.quality import score_quality

    rows, docs, labels = small(documents, spark)
    got = score_quality(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == int(not (r["doc_id"] % 7 and r["doc_id"] % 5 == 0)) for r in known]) > 0.97
    assert score_quality(docs.limit(0), labels).count() == 0
    assert all(r["score"] == 1 for r in score_quality(docs, labels.limit(0)).collect())


def test_pair_tables_learn_an_interaction():
    from scanweave.llm.quality import AdditiveModel

    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((AdditiveModel(x, y).score(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("name, label, threshold, recall", [("op10_unlabelled_toxicity", "toxic", 0.5, 0.8), ("op8_additive_quality", "quality", 0.7, 0.95)])
def test_held_out_accuracy(spark, name, label, threshold, recall):
    from scanweave.llm.queries import QUERIES

    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", label)
    rows = QUERIES[name](spark, BIG).join(labels, "doc_id").filter("held_out").collect()
    positive = [r["predicted"] for r in rows if r[label] == 1]
    negative = [r["predicted"] for r in rows if r[label] == 0]
    assert np.mean(positive) > recall and np.mean(negative) < 0.05


def test_mixing(spark, documents):
    from scanweave.llm.mixing import mix, mixed

    rows, docs, labels = small(documents, spark)
    targets = {"good": 0.8, "poor": 0.1, "toxic": 0.1}
    got = mix(docs, labels, targets).collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-9 for r in got)
    totals = sum(np.array(r["posterior"]) * r["tokens"] * r["rate"] for r in got)
    assert np.allclose(totals / totals.sum(), [0.8, 0.1, 0.1], atol=0.01)
    out = mixed(docs, labels, targets)
    assert out.columns == docs.columns
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == +want
    assert mix(docs.limit(0), labels).count() == 0 and mixed(docs.limit(0), labels).count() == 0
    assert mix(docs, labels.limit(0)).count() == len(rows)


def test_rates_solve_least_squares(spark):
    """The totals meet the goal with nonnegative rates, some of them zero."""
    from scanweave.llm.mixing import fit_rates
    from scanweave.session import cut

    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 0.5, 0.5], 300)
    tokens = rng.integers(1, 500, 300).astype(float)
    df = cut(spark.createDataFrame([(float(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens double, posterior array<double>"))
    targets = [0.7, 0.25, 0.05]
    got = np.array([(r["tokens"], r["rate"], *r["posterior"]) for r in df.withColumn("rate", fit_rates(df, targets)).collect()])
    totals = (got[:, 2:] * got[:, :1] * got[:, 1:2]).sum(axis=0)
    have = (p * tokens[:, None]).sum(axis=0)
    goal = np.array(targets) * have[0] / targets[0]
    assert np.allclose(totals, goal, rtol=1e-3) and (got[:, 1] >= 0).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        from scanweave.session import cut

        before = docs
        docs = cut(stage(spark, docs, SF))
        if name == "mixing":  # most documents are of the heaviest domain and stay
            assert docs.count() >= 0.8 * before.count()
        if name != "packing":
            assert docs.columns == columns and docs.count() > 0
            ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)
    assert {r["doc_id"] for r in docs.collect()} == ids
