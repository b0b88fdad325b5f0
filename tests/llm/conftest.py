import duckdb
import pytest


@pytest.fixture(scope="session")
def sf():
    import glob

    path = "/root/testdata/sf0.001"
    if not glob.glob(path):
        pytest.skip("no test data")
    return path


@pytest.fixture(scope="session")
def documents(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall())
