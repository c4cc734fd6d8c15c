import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from matchday.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="matchday-tests")
    yield s
    s.stop()


def plan_text(df) -> str:
    """Formatted physical plan as text (what `explain` prints)."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()
