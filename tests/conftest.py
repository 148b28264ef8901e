import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from perfweave.session import local_session
    s = local_session(cores="*", shuffle_partitions=8)
    yield s
    s.stop()


def duck_views(folder):
    """DuckDB connection with a folder's tables as views."""
    import duckdb

    from perfweave.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con
