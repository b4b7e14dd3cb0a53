import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from provspark.session import local_session, ship

    s = local_session(4, spark__sql__shuffle__partitions=4, spark__driver__memory="4g")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return ship(s)


@pytest.fixture(scope="session")
def oracle():
    """Runs DuckDB's SQL over the smallest tables."""
    import duckdb
    from helpers import DATA

    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return lambda sql: con.execute(sql).df()
