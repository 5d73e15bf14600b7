import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spindle.session import checkpoint_dir, local_session  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, shuffle_partitions=8, app="spindle-tests")
    if not s.sparkContext.getCheckpointDir():  # tests only: no cluster folder configured
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    checkpoint_dir(s)
    yield s
    s.stop()


def rows(df, order=None):
    cols = df.columns
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r)) if order is None else out
