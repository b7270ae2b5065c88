import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cropseries.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", "cropseries-tests", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.log.level": "ERROR"})
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect a frame as sorted tuples of the named columns."""
    def collect(df, *columns):
        key = lambda r: tuple((v is None, str(type(v)) if isinstance(v, bool) else "", v if v is not None else 0) for v in r)
        return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=key)
    return collect
