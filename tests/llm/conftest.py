import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs001(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def rows001(docs001):
    return [(r["doc_id"], r["text"]) for r in docs001.collect()]


LONG = " ".join(f"w{k % 977}x{k}" for k in range(30000))
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, "Common footer line here\nfirst body text"),
    (6, "  COMMON footer line HERE\t\nsecond body text\n\n"), (7, "École É line of text\nCommon footer line here"),
    (7, "École É line of text\nCommon footer line here"), (8, LONG), (None, "no id\nCommon footer line here"),
    (None, None), (9, "a b\n" * 12), (10, "\n"), (11, "Common footer line here\nCommon footer line here")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra
    columns named like internal and result columns."""
    rows = [(i, t, None if k % 3 == 0 else f"s{k % 2}", k, f"x{k}", None)
            for k, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _doc long, n_lines string, kept string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
