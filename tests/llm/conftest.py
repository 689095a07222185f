import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, t string, v int, key string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from contactlift.llm.store import ship

    ship(spark)


@pytest.fixture
def table(spark, tmp_path):
    """Documents as a stored table, with extra columns whose names clash with those used inside."""
    def make(rows, parts=3):
        full = [(i, t, *(list(rest) + ["en", "s"][len(rest):]), None, 1, "x", 2, "y") for i, t, *rest in rows]
        path = str(tmp_path / f"docs{len(os.listdir(tmp_path))}")
        spark.createDataFrame(full, SCHEMA).repartition(parts).write.parquet(path)
        return spark.read.schema(SCHEMA).parquet(path)

    return make
