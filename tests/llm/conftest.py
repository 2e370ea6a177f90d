import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from texts; ids count from 0 unless pairs are given."""

    def make(*texts, extra=False):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(
            [(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS
        )
        if extra:
            from pyspark.sql import functions as F

            # Columns whose names clash with helpers' names.
            for name in ("item", "band", "group", "bands", "start", "length", "_row", "_key", "size", "shard"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
