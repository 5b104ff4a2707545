"""Keyset scans, multi-key lookups, cross-source joins on text keys."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import local
from ..plans.compile import Compiler
from ..plans.model import ModelError, Table

#: Keys of one lookup; more go through a join that is not broadcast.
MOST_BROADCAST_KEYS = 10_000


def after(keys: list[Column], values: list) -> Column:
    """``(k1 > a) OR (k1 = a AND k2 > b) ...``."""
    tests = []
    for n in range(len(keys)):
        equal = [k == v for k, v in zip(keys[:n], values[:n])]
        tests.append(functools.reduce(operator.and_, [*equal, keys[n] > values[n]]))
    return functools.reduce(operator.or_, tests)


def beyond(order: list[tuple[Column, bool]], values: list[Column | None]) -> Column:
    """Rows behind a place in an order of (column, descending); nulls are first ascending, and last descending."""
    tests = []
    for n, ((column, down), value) in enumerate(zip(order, values)):
        equal = [c.isNull() if v is None else c == v for (c, _), v in zip(order[:n], values[:n])]
        if value is None:
            behind = F.lit(False) if down else column.isNotNull()
        else:
            behind = (column < value) | column.isNull() if down else column > value
        tests.append(functools.reduce(operator.and_, [*equal, behind]))
    return functools.reduce(operator.or_, tests)


def keyset_page(compiler: Compiler, table: Table, size: int, start: list | None = None, columns: list[str] | None = None) -> DataFrame:
    """Up to ``size + 1`` rows in key order behind the key ``start``; the last one tells that there are more."""
    if not table.keys:
        raise ModelError(f"{table.name} has no key")
    rows = compiler.scan(table)
    if start is not None:
        if len(start) != len(table.keys):
            raise ModelError(f"{table.name} has {len(table.keys)} key columns")
        rows = rows.filter(after([F.col(k) for k in table.keys], [F.lit(v).cast(table.columns[k].type) for k, v in zip(table.keys, start)]))
    rows = rows.orderBy(*table.keys).limit(size + 1)
    return rows.select(*columns) if columns else rows


def multi_get(compiler: Compiler, spark: SparkSession, table: Table, keys: list[tuple], columns: list[str]) -> DataFrame:
    """One row for each requested key in its order (``ordinal``), null where there is none."""
    names = list(table.keys)
    if not names or any(len(k) != len(names) for k in keys):
        raise ModelError(f"{table.name} has {len(names)} key columns")
    kinds = ", ".join(f"__k{i} {table.columns[n].type.simpleString()}" for i, n in enumerate(names))
    wanted = local.frame(spark, [(i, *k) for i, k in enumerate(keys)], f"ordinal int, {kinds}")
    on = functools.reduce(operator.and_, [F.col(f"__k{i}") == F.col(n) for i, n in enumerate(names)])
    asked = wanted.select(*[f"__k{i}" for i in range(len(names))])
    if len(keys) <= MOST_BROADCAST_KEYS:
        asked = F.broadcast(asked)
    compiler.policy.guard_read(table, set(columns), compiler.context)
    found = compiler.scan(table).join(asked, on, "left_semi")
    picked = found.select(*[F.col(n).alias(f"__f{i}") for i, n in enumerate(names)], *columns)
    on = functools.reduce(operator.and_, [F.col(f"__k{i}") == F.col(f"__f{i}") for i in range(len(names))])
    return wanted.join(picked, on, "left").select("ordinal", *columns)


def cross_source_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", prefix: str = "right_") -> DataFrame:
    """Join of frames of different sources: keys compare as text, clashing right columns get a prefix."""
    if how not in ("inner", "left"):
        raise ModelError(f"no {how} join across sources")
    names = {c: (f"{prefix}{c}" if c in left.columns else c) for c in right.columns}
    renamed = right.select(F.col(right_key).cast("string").alias("__key"), *[F.col(c).alias(n) for c, n in names.items()])
    return left.join(renamed, F.col(left_key).cast("string") == F.col("__key"), how).drop("__key")


def expanded(rows: DataFrame, children: DataFrame, key: str, foreign: str, most: int) -> DataFrame:
    """Children of the rows' keys; more than ``most`` of them in all are an error."""
    found = children.join(rows.select(F.col(key).alias("__k")), F.col(foreign) == F.col("__k"), "left_semi")
    if found.limit(most + 1).count() > most:
        raise ModelError(f"more than {most} expanded rows")
    return found


def group_members(junction: DataFrame, member: str, group: str) -> DataFrame:
    """(group, members) of a membership table, members in order."""
    return junction.groupBy(F.col(group).alias("group")).agg(F.array_sort(F.collect_set(F.col(member))).alias("members"))
