"""Registered queries with their SQL oracles, by operator family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog_core, catalog_fronts, catalog_surfaces, catalog_writes  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg_grouped"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
