import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from plumbline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "plumbline-tests", "local[4]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted tuples of a small frame."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((c is None, str(c)) for c in r))

    return collect


@pytest.fixture
def one():
    """The single row of a frame as a dict."""

    def collect(df):
        (row,) = df.collect()
        return row.asDict()

    return collect
