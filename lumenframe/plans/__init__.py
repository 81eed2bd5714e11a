"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from lumenframe.sources.ship import ship

FLAGSHIP = "gallery_dual_gate"
#: Modules with QUERIES: name -> (query, SQL or None).
FAMILIES = ("vectors", "tracks", "evaluation", "boxes", "colours", "texts", "streams", "poses", "regions", "brands", "decoders", "motion", "life", "live")


def _all() -> dict:
    return {name: found for family in FAMILIES for name, found in import_module(f"lumenframe.plans.{family}").QUERIES.items()}


def shipped(query):
    """The query, once executors have this package."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: shipped(query) for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
