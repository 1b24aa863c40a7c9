import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="tessera-tests-")
    extra = {"spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")}
    s = build_session("local[*]", 8, extra=extra)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
    yield s


@pytest.fixture()
def scratch_dir():
    return tempfile.mkdtemp(prefix="tessera-case-")
