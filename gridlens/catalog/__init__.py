"""All registered queries."""

from gridlens.catalog import basics, models, series  # noqa: F401
from gridlens.catalog.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
