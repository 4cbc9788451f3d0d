import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from treeline.plans.session import local_session

    s = local_session(4, "2g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *cols):
    """Rows as a sorted list of tuples."""
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)
