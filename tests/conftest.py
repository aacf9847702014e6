import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quirelens.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "8", 4)


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def rows(df, *cols):
    """Rows as a sorted list of tuples."""
    out = df.select(*cols) if cols else df
    return sorted([tuple(r) for r in out.collect()], key=repr)
