import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session, ship

    tmp = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(tmp / "warehouse"), spark__checkpoint__dir=f"file://{tmp}/shared",
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()
