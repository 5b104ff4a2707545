"""Attribute-value rows as one map for each parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attribute_map(parents: DataFrame, key: str, meta: DataFrame, foreign: str, name: str, value: str, order: str, alias: str = "_meta") -> DataFrame:
    """Parents with a JSON object of their attributes; null and empty names are skipped, the last of a name wins."""
    rows = meta.filter(F.col(name).isNotNull() & (F.col(name) != "") & F.col(foreign).isNotNull())
    last = F.row_number().over(Window.partitionBy(foreign, name).orderBy(F.desc(order)))
    rows = rows.withColumn("__last", last).filter("__last = 1")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col(value).cast("string").alias("value"))))
    maps = rows.groupBy(F.col(foreign).alias("__parent")).agg(F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"}).alias(alias))
    joined = parents.join(maps, F.col(key) == F.col("__parent"), "left").drop("__parent")
    return joined.withColumn(alias, F.coalesce(alias, F.lit("{}")))
