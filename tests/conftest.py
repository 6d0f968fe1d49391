import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loopweave.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()
