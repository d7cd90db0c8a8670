import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tickerloom.session import session

    folder = tmp_path_factory.mktemp("shared")
    more = {
        "spark.master": f"local[{os.environ.get('TEST_CPUS', '4')}]",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"file://{folder}",
        "spark.sql.warehouse.dir": f"file://{folder}/warehouse",
    }
    s = session("tests", **more)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
