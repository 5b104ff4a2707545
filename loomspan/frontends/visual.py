"""Visual query documents: tables, joins, columns, a filter tree and a row cap."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters
from ..plans.compile import Compiler

MOST_ROWS = 1000
OPS = {"_eq", "_neq", "_lt", "_lte", "_gt", "_gte", "_contains", "_in", "_between", "_null"}


class VisualError(ValueError):
    """A document that cannot be run."""


def execute(compiler: Compiler, spec: dict) -> DataFrame:
    """``{tables: [{table, alias}], joins: [{left, right, on: [[a, b]], kind}], columns, filter, limit}``.

    Each joined table must connect to one that is already placed; a table may come twice
    under different aliases.  Columns carry ``show``, ``alias``, ``sort`` and ``sortOrder``.
    """
    if not spec.get("tables"):
        raise VisualError("no tables")
    tables = {t.get("alias") or t["table"]: compiler.model.table(t["table"]) for t in spec["tables"]}
    if len(tables) < len(spec["tables"]):
        raise VisualError("two tables have one alias")
    frames = {}
    for alias, table in tables.items():
        frames[alias] = compiler.scan(table).select(*[F.col(c).alias(f"{alias}.{c}") for c in table.columns])
    first = next(iter(tables))
    rows, placed, waiting = frames[first], {first}, list(spec.get("joins", []))
    while waiting:
        ready = next((j for j in waiting if (j["left"] in placed) != (j["right"] in placed)), None)
        if ready is None:
            raise VisualError("a join does not connect to the tables before it")
        waiting.remove(ready)
        kind = ready.get("kind", "inner").lower()
        if kind not in ("inner", "left") or not ready.get("on"):
            raise VisualError("a join is inner or left, on a pair of columns or more")
        new = ready["right"] if ready["left"] in placed else ready["left"]
        on = [_cell(tables, ready["left"], a) == _cell(tables, ready["right"], b) for a, b in ready["on"]]
        rows = rows.join(frames[new], functools.reduce(operator.and_, on), kind)
        placed.add(new)
    if placed != set(tables):
        raise VisualError("a table is not joined")
    if spec.get("filter"):
        rows = rows.filter(_filter(compiler, tables, spec["filter"]))
    columns = spec.get("columns") or []
    shown = [_cell(tables, c["table"], c["column"]).alias(c.get("alias") or c["column"]) for c in columns if c.get("show", True)]
    for c in columns:
        compiler.policy.guard_read(tables[c["table"]], {c["column"]}, compiler.context)
    if not shown:
        raise VisualError("no column is shown")
    sorts = sorted((c.get("sortOrder", 0), k, c) for k, c in enumerate(columns) if c.get("sort"))
    order = []
    for *_, c in sorts:
        cell = _cell(tables, c["table"], c["column"])
        order.append(cell.asc_nulls_first() if c["sort"] == "asc" else cell.desc_nulls_last())
    order += [_cell(tables, alias, key).asc_nulls_first() for alias, t in tables.items() for key in t.keys]  # what the cap leaves is no chance
    limit = spec.get("limit") or 0
    rows = rows.orderBy(*order) if order else rows
    return rows.limit(MOST_ROWS if limit <= 0 else min(limit, MOST_ROWS)).select(*shown)


def _cell(tables: dict, alias: str, column: str) -> Column:
    if alias not in tables:
        raise VisualError(f"no table {alias}")
    return F.col(f"`{alias}.{tables[alias].column(column).name}`")


def _filter(compiler: Compiler, tables: dict, node: dict) -> Column:
    for key, join in (("and", operator.and_), ("or", operator.or_)):
        if key in node:
            if not node[key]:
                raise VisualError(f"{key} is empty")
            return functools.reduce(join, [_filter(compiler, tables, n) for n in node[key]])
    op, value = node["op"], node.get("value")
    if op not in OPS:
        raise VisualError(f"no operator {op}")
    if op == "_in" and not value:
        raise VisualError("_in is empty")
    if op == "_between" and len(value or ()) != 2:
        raise VisualError("_between takes two values")
    table = tables.get(node["table"])
    cell = _cell(tables, node["table"], node["column"])
    compiler.policy.guard_read(table, {node["column"]}, compiler.context)
    compiler.policy.guard_use(table, {node["column"]})
    if op == "_contains":  # here the caller's wildcards count
        return cell.like(f"%{value}%".replace("\\", "\\\\"))
    return filters.predicate(cell, op, value, table.column(node["column"]).type)
