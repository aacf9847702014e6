import pytest

from conftest import SF, TABLES
from quirelens.session import SCHEMAS, table


@pytest.mark.parametrize("name", TABLES)
def test_stated_schema_is_the_files(spark, name):
    assert table(spark, SF, name).schema == spark.read.parquet(f"{SF}/{name}.parquet").schema
    assert set(SCHEMAS) == set(TABLES)
