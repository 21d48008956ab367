import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gridweave import ensure_checkpoint_dir, get_session

    s = get_session("local[8]", 8, app_name="gridweave-tests")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="gridweave-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="gridweave-test-", dir="/tmp")
