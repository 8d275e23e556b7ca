import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # workers import the package too

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from strandlake import session

    built = session.build("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
