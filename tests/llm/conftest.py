import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table of (doc_id, text) pairs over several partitions, with clashing extra columns."""
    from pyspark.sql import functions as F

    def make(rows, parts=3):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA).repartition(parts)
        for name in ("rank", "score", "shard", "key", "node", "slot", "label"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
