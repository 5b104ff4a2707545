"""The programmatic entry: a tree or a grouped query to flat rows, with a total on request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregate import Grouped, grouped
from ..operators.mutate import Outcome, Writer
from ..plans.compile import Compiler
from ..plans.model import ModelError
from ..plans.nodes import Query


@dataclass
class Result:
    rows: DataFrame
    total: DataFrame | None = None


def execute(compiler: Compiler, query: Query | Grouped, with_total: bool = False) -> Result:
    """Links to one row are flattened to ``link.column``; collections stay arrays."""
    if isinstance(query, Grouped):
        return Result(grouped(compiler, query))
    rows = compiler.nested(query)
    out = []
    for f in rows.schema:
        single = query.link_names.get(f.name, f.name) in compiler.model.table(query.table).single_links and f.name in query.links
        if single and isinstance(f.dataType, T.StructType):
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") for g in f.dataType]
        else:
            out.append(F.col(f"`{f.name}`"))
    return Result(rows.select(*out), compiler.total(query) if with_total else None)


def tools(documents: list[dict], compiler: Compiler):
    """Declared tools: each document names a table, columns, a filter with ``{{parameter}}`` places, sort and limit."""
    from ..operators import filters

    def bound(value, given):
        if isinstance(value, str) and value.startswith("{{") and value.endswith("}}"):
            if value[2:-2] not in given:
                raise ModelError(f"no parameter {value[2:-2]}")
            return given[value[2:-2]]
        if isinstance(value, dict):
            return {k: bound(v, given) for k, v in value.items()}
        return [bound(v, given) for v in value] if isinstance(value, list) else value

    def make(d):
        def call(**given):
            table = compiler.model.table(d["table"])
            part = filters.parse(bound(d["filter"], given), compiler.model, table) if d.get("filter") else None
            return compiler.flat(Query(table.name, d.get("columns", []), filter=part, sort=d.get("sort", []), limit=d.get("limit"), aggregates=d.get("aggregates", [])))

        return call

    return {d["name"]: make(d) for d in documents}


def write_tools(writers: dict[str, Writer]):
    """``insert``, ``update`` and ``delete`` of one row, each (rows before, table, ...) to an outcome.

    A row's ``id`` is its key: one value, a list by key column, or text ``a|b``.  All goes through the
    table's writer, so that a row outside the caller's scope changes nothing.
    """

    def of(table):
        if table not in writers:
            raise ModelError(f"no writable table {table}")
        return writers[table]

    def key(writer, id):
        names = list(writer.table.keys)
        given = list(id) if isinstance(id, (list, tuple)) else id.split("|") if isinstance(id, str) and len(names) > 1 else [id]
        if len(given) != len(names):
            raise ModelError(f"{writer.table.name} has {len(names)} key columns")
        whole = [isinstance(writer.table.columns[n].type, T.IntegralType) and isinstance(v, str) for n, v in zip(names, given)]
        try:
            return {n: int(v) if w else v for n, v, w in zip(names, given, whole)}
        except ValueError as e:
            raise ModelError(f"{id!r} is no key of {writer.table.name}") from e

    def insert(before: DataFrame, table: str, values: dict) -> Outcome:
        return of(table).insert(before, values)

    def update(before: DataFrame, table: str, id, set: dict) -> Outcome:
        own = key(of(table), id)
        if not set or any(of(table).table.column(c).name in own for c in set):
            raise ModelError("an update sets columns other than the key")
        return of(table).update(before, own | set)

    def delete(before: DataFrame, table: str, id) -> Outcome:
        return of(table).delete(before, key(of(table), id))

    return {"insert": insert, "update": update, "delete": delete}
