"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@op("op1_one_bit_neighbours", """
    WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
                 AND len([x FOR x IN embedding IF x <> 0]) > 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score
          FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.vectors import nearest_neighbours

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest_neighbours(vectors, F.col("vec_id") % 100 == 0, 10)


@op("op2_bin_slack_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@op("op3_fuzzy_notices")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.notices import notice_digest, scan_notices

    return notice_digest(scan_notices(table(spark, sf_dir, "documents")))


@op("op4_maxscore", """
    WITH v AS (SELECT DISTINCT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
          FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.vectors import inner_product_search, usable

    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long"))
    vectors = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding"), zero=True)).select("vec_id", whole.alias("vector"))
    return inner_product_search(vectors, F.col("vec_id") % 20 == 0, 20)


@op("op5_differencing_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.sharding import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@op("op8_additive_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@op("op10_unlabelled_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@op("op9_coordinate_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


@op("op6_suffix_repeats")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.suffixes import digest, remove_repeats

    return digest(remove_repeats(table(spark, sf_dir, "documents")))


@op("op7_soft_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: crc32 in SQL: the table of byte values, and a text folded through it.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
                    FROM (SELECT unnest(range(0, 256)) AS n))"""


def _crc(text: str) -> str:
    one = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return (f"xor(list_reduce(list_transform(range(0, strlen({text})), lambda i: {one}), "
            "lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295)")


@op("op11_position_table_resampling", rf"""
    WITH {_CRC_TABLE},
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
    dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
    words AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM b), crc_table),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN words USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM b JOIN words USING (w) GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM dw)::DOUBLE + 10000)
                                             / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM b)::DOUBLE + 10000))))::BIGINT AS gain
              FROM (SELECT DISTINCT bucket FROM words) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    g AS (SELECT doc_id, sum(gain)::BIGINT AS total FROM dw JOIN words USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
    weighed AS (SELECT doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE floor(total::DOUBLE / len(ws))::BIGINT END AS weight
                FROM d LEFT JOIN g USING (doc_id)),
    scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
               FROM weighed),
    r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM r""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@op("op12_lyndon_runs", rf"""
    WITH {_CRC_TABLE},
    d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                 {_crc("doc_id::VARCHAR")} AS h FROM documents, crc_table),
    e AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS changed, h // 10 AS g FROM d),
    f AS (SELECT *, CASE WHEN changed THEN g % n END AS a FROM e),
    v AS (SELECT doc_id, n, CASE WHEN changed THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i
                 ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM f),
    w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM v),
    pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w AS x JOIN w AS y ON x.doc_id = y.doc_id AND x.word = y.word
              AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    marked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
    alike AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM marked GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM alike GROUP BY doc_id, start, length),
    told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
    dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.periods import find_runs, planted, run_digest

    return run_digest(find_runs(planted(table(spark, sf_dir, "documents"))))


@op("op13_offset_pieces")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.llm.pieces import encode_documents, piece_digest

    path = tokenizer_path("piece_bpe_32k.model")
    return piece_digest(encode_documents(table(spark, sf_dir, "documents"), path), path)
