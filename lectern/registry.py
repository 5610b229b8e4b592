"""All queries of the retrieval engine, by survey id."""

from __future__ import annotations

from .plans import queries as planned
from .sources import queries as read


def queries():
    """Query name -> function of (spark, sf_dir)."""
    return planned.QUERIES | read.QUERIES


def oracle_sql():
    """Query name -> DuckDB SQL."""
    return planned.ORACLES | read.ORACLES
