import pytest


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs with clashing extra columns."""
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).selectExpr(
            "*", "'x' AS bucket", "1 AS fingerprint", "2 AS score", "3 AS shard", "4 AS k", "5 AS n")
    return make
