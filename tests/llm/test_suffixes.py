"""Repeated strings against brute force."""

import hashlib
import random

import pytest

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Digest of every row: all 100-byte strings in order of id, text and start."""
    seen, out = set(), {}
    from collections import Counter

    for i, text in sorted(Counter(rows), key=lambda r: (-1 if r[0] is None else r[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(raw[p:p + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for p in range(len(raw)) if gone[p] and not (p and gone[p - 1]))
        out[i, text] = (i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[r] for r in rows), key=str)


def some_texts(seed, docs=40):
    rng = random.Random(seed)

    def run(n):
        return "".join(rng.choice("abcd éß\n") for _ in range(n))

    shared = [run(n) for n in (99, 100, 101, 130, 250, 400)]
    rows = []
    for i in range(docs):
        parts = [run(rng.randrange(0, 200)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randrange(0, 6))]
        rows.append((i, "".join(parts)))
    near = list(run(600))
    for i in range(30):
        text = list(near)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(600)] = rng.choice("xyz")
        rows.append((100 + i, "".join(text)))
    rows += [(200, None), (201, ""), (202, "a" * 1000), (203, "ab" * 300), (204, "a" * 99), (205, "\0" * 150 + "q"), (206, "\0" * 120),
             (207, shared[3] * 3), (208, run(40) + "\0" * 130), (7, rows[7][1]), (None, shared[5]), (209, "long text " * 30_000)]
    return rows


def got(df):
    from scanweave.llm.suffixes import digest, remove_repeats

    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in digest(remove_repeats(df)).collect()), key=str)


def test_deep_shallow_sorts():
    from scanweave.llm.suffixes import deep_shallow

    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(0, 100))) for _ in range(300)]
    strings += [b"x" * 60 + bytes(rng.choice(b"abc") for _ in range(40)) for _ in range(200)] + [b"x" * 100] * 5
    order, common = deep_shallow(strings, 100)
    filled = [strings[i].ljust(100, b"\0") for i in order]
    assert filled == sorted(s.ljust(100, b"\0") for s in strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert common[k] == n


@pytest.mark.parametrize("limits", [{}, {"CLASS_ROWS": 3, "BUCKET_ROWS": 50}])
def test_against_brute_force(spark, documents, monkeypatch, limits):
    from scanweave.llm import suffixes

    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    rows = some_texts(3)
    assert got(documents(rows)) == brute(rows)


def test_empty_and_texts(spark, documents):
    from scanweave.llm.suffixes import without_repeats

    rows = some_texts(5, 10)
    assert got(documents(rows).limit(0)) == []
    out = without_repeats(documents(rows))
    assert out.columns == documents(rows).columns and out.count() == len(rows)
    kept = {r["doc_id"]: r for r in out.collect()}
    assert kept[200]["text"] is None and kept[202]["text"] == "a" and kept[0]["text"] == rows[0][1]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept.values())


def test_query(spark):
    from scanweave.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in QUERIES["op6_suffix_repeats"](spark, SF).collect()), key=str)
    assert found == brute(rows)


def executed_joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_are_not_broadcast(spark, documents, monkeypatch):
    """Spark would send these short tables to the driver; at size they took its memory."""
    from scanweave.llm import suffixes

    plans = []
    true_settled = suffixes.settled
    monkeypatch.setattr(suffixes, "settled", lambda df: (plans.append(executed_joins(df)), true_settled(df))[1])
    suffixes.remove_repeats(documents(some_texts(3))).count()
    # Only the short table of crowded anchors (one of CLASS_ROWS contexts or more each) may be broadcast.
    assert sum("BroadcastHashJoin" in p for p in plans) <= 2 and sum("SortMergeJoin" in p for p in plans) >= 4
    assert all("LeftAnti" in p or "LeftSemi" in p for p in plans if "BroadcastHashJoin" in p)


def test_crowded_anchors_give_few_windows(spark, documents, monkeypatch):
    """Strings over a frequent phrase are hashed one by one only where a neighbour shares most of them."""
    from scanweave.llm import suffixes

    rng = random.Random(9)
    phrase = "".join(rng.choice("abcdefgh") for _ in range(70))

    def run(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    rows = [(i, run(200) + phrase + run(200)) for i in range(60)]
    rows.append((60, rows[0][1][150:320]))
    monkeypatch.setattr(suffixes, "CLASS_ROWS", 3)
    made = []
    true_settled = suffixes.settled

    def counted(df):
        out = true_settled(df)
        if "window" in out.columns and "before" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(suffixes, "settled", counted)
    assert got(documents(rows)) == brute(rows)
    # The two equal surroundings are settled by hash; the 60 others share the phrase only.
    assert made and sum(made) < 60 * 12
