"""Registered queries, their derived input tables, and the SQL that checks them."""

from . import learning, projections, relational, streams  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
