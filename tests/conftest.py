"""Shared fixtures: one local Spark session with a private checkpoint folder."""

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tmweave.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="tmweave-tests", shuffle_partitions=4,
                      **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tmweave-test-ckpt-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tmweave-test-")


@pytest.fixture(autouse=True)
def _ship_test_module(request):
    """Plug-in classes defined in test modules must reach the Python workers."""
    from pyspark import cloudpickle
    try:
        cloudpickle.register_pickle_by_value(request.module)
    except ValueError:
        pass
    yield
