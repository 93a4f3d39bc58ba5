"""Near duplicates against all pairs by brute force."""

import random
import re
from collections import defaultdict

import pytest

SF = "/root/testdata/sf0.001"


def brute(rows, size, percent):
    """(n_shingles, component, kept) for each row, by comparing all sets that share a shingle."""
    sets, where = [], defaultdict(list)
    for k, (i, text) in enumerate(rows):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(size, len(words))
        sets.append({tuple(words[j:j + n]) for j in range(len(words) - n + 1)} if n else set())
        for s in sets[-1]:
            where[s].append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        if rows[k][0] is None:
            continue
        for j in {j for x in s for j in where[x] if j < k and rows[j][0] is not None}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)), i is None or least[find(k)] == i) for k, (i, _) in enumerate(rows)]


def some_texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    hot = [rng.choice(words) for _ in range(150)]
    for _ in range(60):
        text = list(hot)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((n, " ".join(text)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, rows[3][1].upper()),
             (n + 7, "été Été"), (n + 8, "long " * 20_000), (5, rows[5][1]), (7, "another text under a used id " * 3), (n + 9, "another text under a used id " * 3)]
    return rows


def test_against_brute_force(spark, documents, monkeypatch):
    from scanweave.llm import neardup

    rows = some_texts(4)
    want = sorted(brute(rows, 5, 80))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(documents(rows)).collect())
    assert got == want
    kept = neardup.keep_one(documents(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if w[3])
    assert kept.columns == documents(rows).columns


def test_small_blocks_and_null_ids(spark, documents, monkeypatch):
    from scanweave.llm import neardup

    for name in ("LIST_BLOCK", "SET_BLOCK", "BUCKET_ROWS", "SET_ROWS"):
        monkeypatch.setattr(neardup, name, 8)
    rows = some_texts(8)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(documents(rows), 4).collect())
    assert got == sorted(brute(rows, 4, 80))
    alone = neardup.near_duplicates(documents([(None, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in alone] == [(None, None, True)] * 2
    assert neardup.near_duplicates(documents(rows).limit(0)).count() == 0


def test_a_task_holds_two_blocks(spark, documents, monkeypatch):
    from scanweave.llm import neardup

    for name in ("SET_BLOCK", "SET_ROWS"):
        monkeypatch.setattr(neardup, name, 8)
    whole = neardup._confirmed(80)

    def bounded(percent):
        def compare(frame):
            assert len(frame) <= 60, f"{len(frame)} sets in one task"
            return whole(frame)

        return compare

    monkeypatch.setattr(neardup, "_confirmed", bounded)
    words = [f"w{i}" for i in range(150)]
    rows = [(n, " ".join(words[:n % 150] + [f"x{n}"] + words[n % 150 + 1:])) for n in range(200)]
    got = neardup.near_duplicates(documents(rows)).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 200


def test_one_row_of_each_component_stays(spark, documents):
    from scanweave.llm import neardup

    words = [f"w{i}" for i in range(100)]
    text, near, other = " ".join(words), " ".join(words[:99] + ["x"]), " ".join(f"v{i}" for i in range(50))
    # A row without id beside a named one, a row repeated whole, near copies and another text under one id, repeats without id.
    rows = [(3, text), (None, text), (3, text), (3, near), (4, near), (3, other), (None, "alone here"), (None, "alone here"), (0, "zero"), (None, None), (9, None), (9, None)]
    kept = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(documents(rows)).collect()), key=str)
    first = [k for k in kept if k in ((3, text), (3, near))]
    assert len(first) == 1
    assert kept == sorted([*first, (3, other), (None, "alone here"), (0, "zero"), (None, None), (9, None)], key=str)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    from scanweave.llm.queries import QUERIES

    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op9_coordinate_join"](spark, sf).collect())
    assert got == sorted(brute(rows, 4, 80))
