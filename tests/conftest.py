import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from watchfold.session import session, ship

    shared = tmp_path_factory.mktemp("shared")
    out = session("local[8]", 8, **{"spark.driver.memory": "8g", "spark.checkpoint.dir": str(shared), "spark.sql.autoBroadcastJoinThreshold": "256k"})
    out.sparkContext.setLogLevel("ERROR")
    ship(out)
    yield out
    out.stop()
