"""Columns computed by user code, in Arrow batches over declared dependencies only."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator, Tuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def provided(function: Callable[..., pd.Series], dependencies: list[Column], kind: T.DataType | str) -> Column:
    """``function`` gets one series for each dependency, a batch at a time, and returns one.

    Only the dependencies travel to Python, and the rest of the row stays where it is.
    """
    returns = T.StructType.fromDDL(f"v {kind}")[0].dataType if isinstance(kind, str) else kind

    def run(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.Series]:  # travels by value
        for series in batches:
            yield function(*series) if isinstance(series, tuple) else function(series)

    return F.pandas_udf(run, returns)(*dependencies)
