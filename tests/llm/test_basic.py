"""Sharding, packing, notices and vector searches against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TEXTS = [(1, "alpha beta"), (2, None), (3, ""), (4, "alpha beta"), (5, "x" * 5000), (6, "été Über"), (6, "été Über"), (None, "no id")]


def test_differencing_is_close_to_even():
    from scanweave.llm.sharding import difference

    rng = random.Random(3)
    weights = [rng.randrange(1, 10_000) for _ in range(3_000)]
    parts = np.zeros((len(weights), 8), dtype=np.int64)
    parts[:, 0] = weights
    shard = difference(parts)[:, 0]
    sums = [sum(w for w, s in zip(weights, shard) if s == k) for k in range(8)]
    assert sum(sums) == sum(weights) and max(sums) - min(sums) <= 50
    assert difference(np.array([[5, 0]])).shape == (1, 2)
    # Known small case: 8, 7, 6, 5, 4 differ by 2 after differencing into two parts.
    two = np.zeros((5, 2), dtype=np.int64)
    two[:, 0] = [8, 7, 6, 5, 4]
    label = difference(two)[:, 0]
    assert abs(sum(w if s else -w for w, s in zip([8, 7, 6, 5, 4], label))) == 2


def check_shards(rows):
    for shard, members in rows.items():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))


def test_shards_keep_groups(spark, documents, monkeypatch):
    from scanweave.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 16)
    monkeypatch.setattr(sharding, "FAN_IN", 4)
    rng = random.Random(5)
    many = TEXTS + [(100 + i, "w" * rng.randrange(1, 400) + str(i % 150)) for i in range(400)]
    rows = sharding.shard_documents(documents(many), 8).collect()
    assert len(rows) == len(many)
    by_shard, by_crc = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r["shard"]].append(r)
        by_crc[r["text_crc32"]].add(r["shard"])
    check_shards(by_shard)
    assert all(len(s) == 1 for s in by_crc.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in many)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    rest = [sum(r["size"] for r in by_shard[s]) for s in range(8) if not any(r["size"] == 5001 for r in by_shard[s])]
    assert max(rest) - min(rest) < 0.02 * sum(rest)
    assert sharding.shard_documents(documents(TEXTS).limit(0), 8).count() == 0


def test_fill_matches_brute_force():
    from itertools import product

    from scanweave.llm.packing import fill

    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 40), 4), reverse=True)
        counts = {length: rng.randrange(0, 4) for length in lengths}
        room = rng.randrange(0, 90)
        used = fill(lengths, counts, room)
        best = max(s for c in product(*[range(counts[x] + 1) for x in lengths]) if (s := sum(a * b for a, b in zip(c, lengths))) <= room)
        assert sum(a * b for a, b in used.items()) == best
        assert all(counts[a] >= b for a, b in used.items())


def check_packing(rows, docs, tokenizer, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r["offset"])
        at = 0
        for r in seq:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    copies = Counter(i for i, _ in docs)
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == len(ids) * copies[i]
        for r in pieces:
            piece = np.array(ids[r["start"]:r["start"] + r["length"]], dtype="<u4")
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids)
    return by_seq


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    from scanweave.llm.packing import pack_documents
    from scanweave.llm.queries import tokenizer_path

    hard = [(50, "Å ǅ ΣΣ it's <|endoftext|> x\x1cy   z\n\n\t end\r\n"), (51, "word " * 3000), (52, "≠ a")]
    docs = TEXTS + hard + [(60 + i, "the cat " * (i * 7 % 300)) for i in range(80)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = pack_documents(documents(docs), tokenizer_path(), capacity=512).collect()
    by_seq = check_packing(rows, docs, tokenizer, 512)
    for r in rows:
        assert len(r["ids"]) == r["length"]
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 512) + 1
    assert pack_documents(documents(docs).limit(0), tokenizer_path()).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    from scanweave.llm.packing import Encoder
    from scanweave.llm.queries import tokenizer_path

    whole, own, rng = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path()), random.Random(9)
    signs = list("abzAZ09'.,!-_ \n\t\xa0\x85\u2028\x1c\x00\x7f<|>éÉ̈ßǅΣσςİıﬁ½²中文🙂\u0301\u200d'sS'LL") + ["'re", "<|endoftext|>", "<|startoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 30)))
        assert own.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    from scanweave.llm.queries import QUERIES, tokenizer_path

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    by_seq = check_packing(QUERIES["op2_bin_slack_packing"](spark, SF).collect(), docs, Tokenizer.from_file(tokenizer_path()), 4096)
    total = sum(r["length"] for s in by_seq.values() for r in s)
    assert len(by_seq) <= -(-total // 4096) + 1


def base_rows(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    from scanweave.llm.notices import BASE

    hits = [(i, label) for phrase, label in BASE.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    return (len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None),
            ",".join(sorted({h[1] for h in hits})))


def test_notices(spark, documents):
    from scanweave.llm.notices import notice_digest, scan_notices

    docs = TEXTS + [
        (20, "Released Under, the MIT-License. cc by nc cc-BY-nc CC by nc!"), (21, "undr the mit licnse"),
        (22, "apache licence version 2 of"), (23, "apache license version 3"), (24, "under theé mit license"),
        (25, "word " * 20_000 + "under the mit license"), (26, "GNU General Publik License"), (27, "cc by nd"),
        (28, "the mit license under the mit license under the mit license"), (29, "\x00under\x7fthe[mit`license")]
    rows = notice_digest(scan_notices(documents(docs))).collect()
    assert len(rows) == len(docs)
    want = defaultdict(set)
    for i, t in docs:
        want[i].add(base_rows(t))
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in want[r["doc_id"]]
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",") + [""])
    got = {r["doc_id"]: r["labels"] for r in rows}
    assert got[21] == "mit" and got[22] == "apache-2" and got[23] == "" and got[26] == "gpl" and got[27] == ""
    spans = scan_notices(documents([(21, "we say undr the mit licnse now")])).collect()[0]["spans"]
    assert [(s["first_word"], s["n_words"], s["text"]) for s in spans] == [(2, 4, "undr the mit licnse")]
    assert scan_notices(documents(docs).limit(0)).count() == 0


def test_notices_query(spark):
    from scanweave.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_fuzzy_notices"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_rows(texts[r["doc_id"]])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x")).repartition(4)


def random_rows(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.5 * rng.standard_normal(dim)]) for i in range(n)]
    for i in range(0, n, 3):
        rows[i] = (i, rows[0][1])  # a third are copies of one vector
    bad = [(n, None), (n + 1, [0.0] * dim), (n + 2, [1.0, None] + [0.0] * (dim - 2)), (n + 3, [float("nan")] * dim),
           (n + 4, [float("inf")] * dim), (None, [1.0] * dim), (n + 5, [1.0, 2.0]), (20 * n, [3.0, 2.0]), (1, rows[1][1]), (n + 6, [])]
    return rows + bad


def ranked(rows, usable, key, asked, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and usable(v)}
    out = []
    for q, a in rows:
        if asked(q):
            near = sorted((key(a, b), i) for i, b in rows if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def finite(v):
    return all(x is not None and math.isfinite(x) for x in v)


def test_neighbours(spark, monkeypatch):
    from scanweave.llm import vectors as V

    monkeypatch.setattr(V, "ROW_BLOCK", 64)
    monkeypatch.setattr(V, "QUERY_BLOCK", 16)
    rows = random_rows(1, 400, 24)
    got = V.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0, 10).collect()
    want = ranked(rows, lambda v: finite(v) and any(v), math.dist, lambda q: q % 20 == 0, 10)
    assert len(got) == len(want)
    assert {(r["query_id"], r["rank"]) for r in got} == {w[:2] for w in want}
    hits = {(r["query_id"], r["vec_id"]) for r in got} & {(w[0], w[2]) for w in want}
    assert len(hits) >= 0.99 * len(want)
    exact = {(w[0], w[2]): w[3] for w in want}
    assert all(abs(r["score"] - exact[r["query_id"], r["vec_id"]]) < 1e-12 for r in got if (r["query_id"], r["vec_id"]) in exact)
    assert V.nearest_neighbours(vectors(spark, rows).limit(0), F.lit(True)).count() == 0


def test_bounds_hold():
    from scanweave.llm.vectors import distance_bounds, encode

    rng = np.random.default_rng(2)
    rows, asked, centre = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64)), np.full(64, 0.1)
    codes, norm, overlap = encode(rows, centre)
    low, high = distance_bounds(asked, centre, np.frombuffer(b"".join(codes), np.uint8).reshape(2000, -1), norm, overlap)
    true = ((asked[:, None] - rows[None]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.999
    assert len(codes[0]) == 64


def test_maxscore(spark, monkeypatch):
    from scanweave.llm import vectors as V

    monkeypatch.setattr(V, "MAXSCORE_ROWS", 64)
    monkeypatch.setattr(V, "QUERY_BLOCK", 16)
    monkeypatch.setattr(V.Postings, "WINDOW", 16)
    rows = [(i, None if v is None else [None if x is None or not math.isfinite(x) else int(x * 4) for x in v]) for i, v in random_rows(4, 400, 24)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    got = V.inner_product_search(df, F.col("vec_id") % 20 == 0, 20).collect()
    want = ranked(rows, lambda v: all(x is not None for x in v), lambda a, b: -sum(x * y for x, y in zip(a, b)), lambda q: q % 20 == 0, 20)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(*w[:3], -w[3]) for w in want]
    assert V.inner_product_search(df.limit(0), F.lit(True)).count() == 0


def test_maxscore_waves_give_few_rows(spark, monkeypatch):
    """A query takes its k-th score into the next wave, so tasks do not give out k rows for every block of rows."""
    from scanweave.llm import vectors as V

    monkeypatch.setattr(V, "MAXSCORE_ROWS", 40)
    rng = random.Random(8)
    rows = [(i, [rng.randrange(-40, 40) for _ in range(12)]) for i in range(2_000)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    made, true_top_k = [], V.top_k
    monkeypatch.setattr(V, "top_k", lambda found, *rest: (made.append(found.count()), true_top_k(found, *rest))[1])
    got = V.inner_product_search(df, F.col("vec_id") % 100 == 0, 10).collect()
    want = ranked(rows, lambda v: True, lambda a, b: -sum(x * y for x, y in zip(a, b)), lambda q: q % 100 == 0, 10)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(*w[:3], -w[3]) for w in want]
    # 50 blocks of rows would give 20 x 50 x 10 rows at once.
    assert sum(made) < 20 * 50 * 10 / 2


@pytest.mark.parametrize("floor", [None, 40, 5_000])
def test_maxscore_block_above_a_floor(floor):
    from scanweave.llm.vectors import LOWEST, Postings

    rng = np.random.default_rng(3)
    for size in (30, 1 << 36):  # products of the large ones are not exact in doubles
        rows, ids = rng.integers(-size, size, (300, 8)) // 2, rng.permutation(300)
        own = ids[:40]
        least = LOWEST if floor is None else floor
        held = Postings(ids, rows if size == 30 else rows >> 12)
        found = held.search(own, rows[:40], np.full(40, least), 7)
        scores = rows[:40] @ (rows if size == 30 else rows >> 12).T
        for n in range(40):
            best = sorted((-int(x), int(i)) for i, x in zip(ids, scores[n]) if i != own[n] and x > least)[:7]
            assert [(-int(x), int(i)) for m, i, x in zip(*found) if m == n] == best


@pytest.mark.parametrize("name", ["op1_one_bit_neighbours", "op4_maxscore"])
def test_search_queries_match_sql(spark, name):
    from check import compare, connect
    from scanweave.llm.queries import ORACLES, QUERIES

    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) is None
