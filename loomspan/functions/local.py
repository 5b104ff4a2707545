"""Small driver-side rows as a DataFrame, without a Python worker behind them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def frame(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Rows become a local relation, which the optimizer sees and can broadcast."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = kind.names
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(kind))
    return spark.createDataFrame(table, schema=kind)
