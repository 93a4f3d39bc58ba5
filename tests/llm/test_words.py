"""Hashed resampling, periodic runs and offset-preserving pieces against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [(1, "alpha beta " * 30), (1, "alpha beta " * 30), (2, None), (3, ""), (None, "no id at all " * 9), (5, "x" * 9_000), (6, "été Über ＡＢ " * 12),
       (7, " \t\n "), (8, "a a a a a a a"), (9, "A-B_c.9 ▁ ▁▁ q" * 8)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- resampling ---

def test_span_crcs(monkeypatch):
    from scanweave.llm import resampling as R

    monkeypatch.setattr(R, "PART", 1 << 12)
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(60_000), dtype=np.uint8)
    spans = [(0, 0), (5, 5), (0, 1), (3, 67), (3, 68), (0, 60_000), (7, 7 + 64 * 8), (100, 100 + 4096), (100, 101 + 4096), (1, 1 + 3 * 4096)]
    spans += [(a, a + rng.randrange(1, most)) for most in (12, 60, 200, 3_000) for a in rng.sample(range(57_000), 80)]
    starts, ends = np.array(spans).T
    assert R.span_crcs(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]
    assert len(R.span_crcs(data, starts[:0], ends[:0])) == 0


def resampled(rows, target, run=1, buckets=10_000, min_words=20, seed=2024):
    """The contract, word by word."""
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [" ".join(words[i:i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(f.encode()) % buckets for f in found]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0]))
    ranks = [(x, k + 1 if k < len(order) // 10 else None) for k, x in enumerate(order)] + [(x, None) for x in out if x[1] < min_words]
    return Counter((x[0], x[2], x[3], x[4], r) for x, r in ranks)


@pytest.mark.parametrize("run", [1, 3])
def test_resample(spark, documents, monkeypatch, run):
    from scanweave.llm import resampling as R

    monkeypatch.setattr(R, "PART", 256)
    monkeypatch.setattr(R, "RANGE_ROWS", 20)
    rng = random.Random(run)
    words = ["a", "bb", "Ccc", "été", "9x", "long" * 40, "汉字" * 30]
    rows = ODD + [(100 + i // 2, rng.choice([" ", ", ", "-"]).join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(400)]
    target = ["bb bb 9x", None, "", "été " * 50]
    aim = spark.createDataFrame([(t, "clash") for t in target], "text string, rank string")
    got = R.resample(documents(rows), aim, run=run, buckets=500, share=(10, 100))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == resampled(rows, target, run, 500)


def test_resample_of_nothing(spark, documents):
    from scanweave.llm.resampling import resample

    aim = spark.createDataFrame([], "text string")
    assert resample(documents(ODD).limit(0), aim).count() == 0
    assert all(r["rank"] is None and r["weight"] == 0 for r in resample(documents([(1, None), (2, "")]), aim).collect())


def test_resample_query(spark):
    from scanweave.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = QUERIES["op11_position_table_resampling"](spark, SF).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == resampled(docs, target)


# --- periodic runs ---

def slow_runs(words, periods, least):
    """Every maximal stretch of equal words `p` apart; those with a smaller period count under that."""
    found, n = {}, len(words)
    for p in range(1, n):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, periods * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def ordered(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def test_lyndon_lengths():
    from scanweave.llm.periods import lyndon_lengths

    rng = random.Random(2)
    for _ in range(1_500):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(0, 40))]
        want = [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]
        assert lyndon_lengths(w) == want


@pytest.mark.parametrize("periods,least", [(4, 6), (2, 2), (3, 5)])
def test_document_runs(periods, least):
    from scanweave.llm.periods import document_runs

    rng = random.Random(periods)
    for _ in range(600):
        docs = []
        for _ in range(rng.randrange(1, 4)):
            w, size = [], rng.randrange(0, 60)
            while len(w) < size:
                unit = [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
                w += (unit * 6)[:rng.randrange(1, len(unit) * 6 + 1)]
            docs.append(w)
        got = document_runs(np.array(sum(docs, []), dtype=np.int64), np.cumsum([len(d) for d in docs]), periods, least)
        assert got == [ordered(slow_runs(d, periods, least)) for d in docs]


def test_long_runs():
    from scanweave.llm.periods import document_runs

    rng = random.Random(4)
    unit = [rng.randrange(50) for _ in range(700)]
    words = [rng.randrange(50) for _ in range(900)] + unit * 5 + [7] * 20_000
    assert document_runs(np.array(words), np.array([len(words)])) == [ordered(
        r for r in [*slow_runs(words[:4_400], 4, 6), (len(words) - 20_000 - (unit[-1] == 7), 20_000 + (unit[-1] == 7), 1)])]


def run_row(doc_id, text):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, words = h // 10, (text or "").encode().split()
    n = len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = ordered(slow_runs(words, 4, 6))
    drop = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def test_run_query_parts(spark, documents):
    from scanweave.llm.periods import find_runs, planted, run_digest

    rng = random.Random(8)
    rows = ODD + [(i, " ".join(rng.choices("ab c dd e".split(), k=rng.randrange(0, 90)))) for i in range(20, 120)]
    got = run_digest(find_runs(planted(documents(rows))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(run_row(i, t) for i, t in rows)
    found = {r["doc_id"]: r for r in find_runs(documents([(8, "x a a a a a a a y"), (9, None)])).collect()}
    assert found[8]["collapsed"] == "x a y" and [tuple(r) for r in found[8]["runs"]] == [(1, 7, 1)]
    assert found[9]["collapsed"] == "" and found[9]["runs"] == [] and found[9]["n_words"] == 0
    assert find_runs(documents(ODD).limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_runs(documents(ODD), periods=1)


# --- pieces ---

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    from scanweave.llm.queries import tokenizer_path

    path = tokenizer_path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


LETTERS = "ab  ▁é漢😀\n\t\x00the ing<s></s>́ﬁ１Ⅷ　​"


def test_pieces_and_spans_match_the_library(library):
    from scanweave.llm.pieces import Model

    path, sp = library
    model, rng = Model.at(path), random.Random(3)
    texts = ["", " ", "  a", "a ", "▁", "▁a", " ▁ b", "x" * 5_000, "the " * 3_000]
    for text in texts + ["".join(rng.choices(LETTERS, k=rng.randrange(0, 30))) for _ in range(1_500)]:
        ids, begins, ends = model.encode(text.encode())
        want = sp.encode(text, return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in want] == list(zip(ids, begins, ends))
        assert model.decode(ids) == sp.decode(ids.tolist())
    for _ in range(1_500):
        ids = np.array([rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(rng.randrange(0, 12))], dtype=np.int64)
        places = np.array([0, 0, len(ids) // 2, len(ids)])
        text, ends = model.decode_rows(ids, places)
        assert [text[a:b].decode() for a, b in zip([0, *ends], ends)] == [sp.decode(ids[a:b].tolist()) for a, b in zip(places, places[1:])]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_maps_match_the_library(rule, squeeze):
    import sentencepiece

    from scanweave.llm.pieces import Normaliser, _fields

    n = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    mine, rng = Normaliser(_fields(n.serialized_model_proto())[3][0]), random.Random(6)
    for _ in range(600):
        text = "".join(rng.choices(LETTERS + "ÅＡｱﾞ", k=rng.randrange(0, 20)))
        want, places = n.normalize(text, with_offsets=True)
        got, where = mine.walk(text.encode())
        assert got.decode() == want
        source, made = (np.cumsum([0, *(len(c.encode()) for c in t)]) for t in (text, want))
        assert not want or where[made].tolist() == source[places].tolist()


def test_invalid_bytes_keep_their_places(library):
    from scanweave.llm.pieces import Model

    ids, begins, ends = Model.at(library[0]).encode(b"a \xff\xe6\xbc b")
    assert begins[0] == 0 and ends[-1] == 7 and (begins[1:] == ends[:-1]).all()
    assert Model.at(library[0]).decode(ids) == "a ��� b"


def test_piece_operators(spark, documents, library):
    from scanweave.llm.pieces import decoded, encode_documents, piece_digest

    path, sp = library
    rows = Counter((r["doc_id"], tuple(r["ids"]), r["text"], tuple(r["ends"])[-1:]) for r in
                   encode_documents(documents(ODD), path).withColumn("text", decoded("ids", path)).collect())
    def known(i, t):
        ids = sp.encode(t or "")
        return i, tuple(ids), sp.decode(ids), (len(t.encode()),) if t else ()
    assert rows == Counter(known(i, t) for i, t in ODD)
    digest = piece_digest(encode_documents(documents(ODD), path), path)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["span_bytes"]) for r in digest.collect()) == Counter(
        (i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)), len((t or "").encode())) for i, t in ODD for ids in [sp.encode(t or "")])
    assert encode_documents(documents(ODD).limit(0), path).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>").select(decoded("ids", path).alias("t")).collect()
    assert [r["t"] for r in nulls] == [None, ""]


def test_piece_query(spark, library):
    from scanweave.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_offset_pieces"](spark, SF).drop("span_bytes").collect()
    want = []
    for r in docs:
        ids = library[1].encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library[1].decode(ids))))
    assert Counter(map(tuple, got)) == Counter(want)
