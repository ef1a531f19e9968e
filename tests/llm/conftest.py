import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Long enough prose for windows and shingles: sentences of numbered words.
def prose(seed: int, n: int = 60) -> str:
    return " ".join(f"w{(seed * 7919 + i * 104729) % 9973}" for i in range(n))


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text, source) rows, with extra columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(data, SCHEMA)
        clash = {c: F.lit(i) for i, c in enumerate(("kept", "size", "spans", "copies", "P", "label", "_0", "__gone"))}
        return df.withColumns(clash) if extra else df

    return make
