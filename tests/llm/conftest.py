import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with columns whose names clash with internal ones."""
    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", 0) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F
            for name in ("id", "norm", "digest", "size", "_part", "shard", "gram", "n", "copy", "mix", "score", "_id", "u"):
                df = df.withColumn(name, F.lit("x"))
        return df
    return make
