import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from keelson.session import build_session
    # spark.checkpoint.dir comes from the environment's defaults when set;
    # keelson.session.shared_root makes a private folder only when it is not.
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="keelson-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples (by the given columns, or all)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
