import os
import sys
import time
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["TZ"] = "UTC"
time.tzset()
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lauda.session import local_session

    return local_session("4", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def tiny():
    return TINY
