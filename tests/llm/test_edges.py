"""Faults once found in the training-data operators, each with a test of its own."""

import numpy as np
from pyspark.sql import functions as F


def spans_of(text):
    from scanweave.llm.notices import FUZZY, Notices

    return sorted((label, text[a:b], edits) for label, a, b, edits, _ in Notices(FUZZY).search(text))


def test_notices_do_not_depend_on_windows():
    assert spans_of("all rights reservd all rights reserved") == [("all-rights-reserved", "all rights reservd", 1), ("all-rights-reserved", "all rights reserved", 0)]
    assert spans_of("all rights reservedness") == []
    assert [s[2] for s in spans_of(" ".join(["gnu general public license"] * 5))] == [0] * 5


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_notice_labels_match_a_plain_scan():
    import random

    from scanweave.llm.notices import EDIT_SHARE, FUZZY

    rng = random.Random(3)
    # Labels of rules that end with a word.
    plain = {label for rule, exact, label in FUZZY if not rule.endswith(" ")} - {label for rule, exact, label in FUZZY if rule.endswith(" ")}
    for _ in range(150):
        words = rng.choices("a of the and under".split(), k=8)
        body = rng.choice([b for b, exact, _ in FUZZY if not exact]).strip()
        noisy = list(body)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(noisy))
            noisy[at:at + 1] = rng.choice([[], [noisy[at], "z"], ["q"]])
        line = " ".join([*words[:4], *"".join(noisy).split(), *words[4:]])
        starts = [0, *(i + 1 for i, c in enumerate(line) if c == " ")]
        ends = [*(i for i, c in enumerate(line) if c == " "), len(line)]
        want = set()
        for rule, exact, label in FUZZY:
            most = len(rule) // EDIT_SHARE
            tail = rule + exact
            for a in starts:
                for b in ends:
                    if a < b and abs(b - a - len(tail)) <= most and line[a:b].endswith(exact):
                        if edit_distance(line[a:b - len(exact)], rule) <= most:
                            want.add(label)
        assert {s[0] for s in spans_of(line)} & plain == want & plain, line


def test_one_class_of_quality_is_its_share(spark, documents):
    from scanweave.llm.quality import score_quality

    docs = documents([(i, f"word {i}") for i in range(20)])
    for value in (0, 1):
        labels = spark.createDataFrame([(i, value, 0) for i in range(20)], "doc_id long, quality int, toxic int")
        assert {(r["score"], r["predicted"]) for r in score_quality(docs, labels).collect()} == {(float(value), value)}


def test_a_repeated_id_counts_once_in_samples(spark, documents):
    from scanweave.llm import quality, toxicity

    rows = [(i, ("bad awful words " if i % 3 == 0 else "nice kind text ") * 3 + str(i)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    once, often = documents(rows), documents(rows + [(9, rows[9][1])] * 500)
    a, b = (toxicity.fit(d, labels, F.lit(True)) for d in (once, often))
    assert np.array_equal(a.slots, b.slots) and np.allclose(a.weights, b.weights)
    a, b = (quality.fit(d, labels, F.lit(True)) for d in (once, often))
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables))


def test_vectors_in_several_waves_are_exact(spark, monkeypatch):
    from scanweave.llm import vectors as V

    monkeypatch.setattr(V, "ROW_BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 8)
    monkeypatch.setattr(V, "QUERY_PART", 3)
    monkeypatch.setattr(V, "ROW_PART", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>").repartition(5)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in V.nearest_neighbours(df, F.col("vec_id") % 50 == 0, 10).collect()}
    want = {}
    for q in range(0, 600, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want |= {(q, k + 1): int(i) for k, i in enumerate(np.lexsort((np.arange(600), d))[:10])}
    assert got == want
