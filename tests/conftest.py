import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from contactlift.session import build_session

    extra = {}
    # tests set their own checkpoint folder only when the environment names none
    if not os.environ.get("SPARK_CHECKPOINT_DIR"):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    s = build_session(master="local[8]", shuffle_partitions=8, extra=extra)
    yield s
    s.stop()
