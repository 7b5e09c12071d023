import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from segmetrics.config import local_session

    # tests set their own checkpoint folder only when the session has none
    s = local_session("*", 8, app="segmetrics-tests",
                      checkpoint_dir=tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def raw_rows(spark, rows):
    """Raw sale DataFrame (16 string columns) from short dicts."""
    from segmetrics.schema import RAW_COLUMNS, RAW_SCHEMA

    full = [tuple(r.get(c) for c in RAW_COLUMNS) for r in rows]
    return spark.createDataFrame(full, RAW_SCHEMA)
