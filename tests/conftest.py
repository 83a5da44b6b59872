import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from auditframe.session import checkpoint_dir, get_spark

    s = get_spark(master="local[4]", shuffle_partitions=4, extra_conf={"spark.driver.memory": "4g"})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="af-test-ckpt-"))
    checkpoint_dir(s)
    yield s
