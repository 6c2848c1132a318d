from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from feedweave.session import get_session
    scratch = tempfile.mkdtemp(prefix="feedweave-tests-")
    s = get_session("local[4]", app="feedweave-tests", shuffle_partitions=8,
                    extra_conf={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def scratch_dir():
    return tempfile.mkdtemp(prefix="feedweave-t-")
