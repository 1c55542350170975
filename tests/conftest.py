import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from crawlq.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def page(spark):
    """One-page tables from markup."""

    def make(*html, url="http://h.example/d/p.html"):
        rows = [(i, url, h) for i, h in enumerate(html)]
        return spark.createDataFrame(rows, "page_id bigint, url string, html string")

    return make


@pytest.fixture(scope="session")
def items():
    """`item` values of page rows in document order."""
    return lambda df: [r["item"] for r in df.orderBy("page_id", "pos").collect()]
