import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from compare import session
    return session(**{"spark.sql.streaming.stateStore.providerClass":
                      "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                      "spark.sql.streaming.stateStore.stateSchemaCheck": "true"})


@pytest.fixture
def hot(spark):
    """Make every key with more than a handful of rows a hot one."""
    spark.conf.set("spark.vigil.rowsPerTask", "7")
    yield 7
    spark.conf.unset("spark.vigil.rowsPerTask")
