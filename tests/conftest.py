import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from gridlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("gridlens-tests", "8", "6g")


@pytest.fixture(autouse=True)
def drop_cached_tables(spark):
    yield
    spark.catalog.clearCache()
