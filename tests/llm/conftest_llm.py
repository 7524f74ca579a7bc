import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(os.path.dirname(HERE))
for p in (ROOT, HERE):
    if p not in sys.path:
        sys.path.insert(0, p)

SF01 = "/root/testdata/sf0.01"
EMPTY_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


def frame(spark, rows, schema, parts=2):
    return spark.createDataFrame(rows, schema).repartition(parts)
