import pytest
from hard_rows import HARD_ROWS, make_docs


@pytest.fixture(scope="session")
def hard(spark):
    return make_docs(spark, HARD_ROWS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def docs_small(sf_small):
    import pandas as pd
    return pd.read_parquet(f"{sf_small}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
