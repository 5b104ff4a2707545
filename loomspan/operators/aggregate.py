"""Grouped aggregates, pivots and metric series."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compile import Compiler
from ..plans.model import ModelError, Table
from ..plans.nodes import Filter, Through

OPERATIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
MOST_LABELS = 100
NULL_LABEL = "_null_"


@dataclass
class Grouped:
    """``values`` has (operation, column) pairs; ``count`` adds ``_count``."""

    table: str
    keys: list[str] = field(default_factory=list)
    values: list[tuple[str, str]] = field(default_factory=list)
    count: bool = False
    filter: Filter | None = None
    deleted: str = "hide"


def _numeric(table: Table, name: str) -> str:
    column = table.column(name)
    if not isinstance(column.type, T.NumericType):
        raise ModelError(f"{table.name}.{name} is not numeric")
    return column.name


def grouped(compiler: Compiler, query: Grouped) -> DataFrame:
    """One row a group, null keys being a group; without keys one row; keys alone give the distinct keys.

    Values come out as doubles, named ``_sum_column`` and so on.  Decimals and integers are
    summed exactly before that.
    """
    table = compiler.model.table(query.table)
    keys = [table.column(k).name for k in query.keys]
    if not keys and not query.values and not query.count:
        raise ModelError("nothing selected")
    used = {*keys, *(c for _, c in query.values)}
    compiler.policy.guard_read(table, used, compiler.context)
    compiler.policy.guard_use(table, used)
    rows = compiler.scan(table, query.filter, query.deleted)
    out = [F.count("*").alias("_count")] if query.count else []
    for operation, name in query.values:
        if operation not in OPERATIONS:
            raise ModelError(f"no aggregate {operation}")
        out.append(OPERATIONS[operation](F.col(_numeric(table, name))).cast("double").alias(f"_{operation}_{name}"))
    if not out:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*out) if keys else rows.agg(*out)


@dataclass
class Pivot:
    table: str
    rows: list[str]
    column: str
    value: str
    aggregate: str
    filter: Filter | None = None
    deleted: str = "hide"


def pivot_labels(compiler: Compiler, query: Pivot) -> list[tuple[object, str]]:
    """(value, label) of the pivot column in order; more than ``MOST_LABELS`` are an error.

    The driver gets at most that many values and one more.
    """
    table = compiler.model.table(query.table)
    if query.column in query.rows:
        raise ModelError("the pivot column is a row key")
    if query.filter is not None and _through(query.filter):
        raise ModelError("a pivot cannot filter on a link")
    used = {*query.rows, query.column, query.value}
    compiler.policy.guard_read(table, used, compiler.context)
    compiler.policy.guard_use(table, used)
    column = table.column(query.column).name
    values = compiler.scan(table, query.filter, query.deleted).select(column).distinct()
    found = [r[0] for r in values.orderBy(F.col(column).asc_nulls_first()).limit(MOST_LABELS + 1).collect()]
    if len(found) > MOST_LABELS:
        raise ModelError(f"more than {MOST_LABELS} values to pivot on")
    labels = [(v, NULL_LABEL if v is None else str(v)) for v in found]
    names = [label for _, label in labels] + list(query.rows)
    if len(set(names)) < len(names):
        raise ModelError("two pivot columns would have one name")
    return labels


def _through(part: Filter) -> bool:
    return isinstance(part, Through) or any(map(_through, getattr(part, "parts", ())))


def pivot(compiler: Compiler, query: Pivot, labels: list[tuple[object, str]] | None = None) -> DataFrame:
    """A column for each value: the aggregate where the pivot column has it.

    Counts are 0 where there is nothing, other aggregates null.  Plain conditional
    aggregates combine before their only shuffle.
    """
    labels = pivot_labels(compiler, query) if labels is None else labels
    table = compiler.model.table(query.table)
    rows = compiler.scan(table, query.filter, query.deleted)
    column, value = table.column(query.column), F.col(table.column(query.value).name)
    if query.aggregate == "count":
        make = lambda c: F.count(c).cast("long")
    elif query.aggregate in OPERATIONS:
        _numeric(table, query.value)
        make = lambda c: OPERATIONS[query.aggregate](c).cast("double")
    else:
        raise ModelError(f"no aggregate {query.aggregate}")
    cells = [make(F.when(F.col(column.name).isNull() if v is None else F.col(column.name) == F.lit(v).cast(column.type), value)).alias(label) for v, label in labels]
    keys = [table.column(k).name for k in query.rows]
    if not cells:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*cells) if keys else rows.agg(*cells)


def pivot_cells(crosstab: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """The same rows with their cells as one map."""
    cells = F.create_map(*[x for label in labels for x in (F.lit(label), F.col(f"`{label}`"))]) if labels else F.create_map()
    return crosstab.select(*keys, cells.alias("cells"))


def metric_series(compiler: Compiler, table: str, labels: list[str], value: str | None, most: int, filter: Filter | None = None) -> DataFrame:
    """Count, and sum of ``value``, for each combination of labels; more than ``most`` are an error."""
    query = Grouped(table, labels, [("sum", value)] if value else [], True, filter)
    series = grouped(compiler, query)
    if series.limit(most + 1).count() > most:
        raise ModelError(f"more than {most} series")
    return series


def page_of_groups(groups: DataFrame, keys: list[Column], most: int = 100) -> tuple[DataFrame, DataFrame]:
    """First groups in order, and how many there are."""
    return groups.orderBy(*keys).limit(most), groups.agg(F.count("*").alias("groupCount"))
