"""The filter language: parsing of filter documents and their lowering to predicates."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import Model, ModelError, Table
from ..plans.nodes import And, Cmp, Const, Filter, Not, Or, Ref, Search, Through, both
from . import search


class FilterError(ValueError):
    """A filter outside the language."""


TEXT_OPS = {"_contains", "_ncontains", "_starts_with", "_nstarts_with", "_ends_with", "_nends_with", "_like", "_nlike"}
PLAIN_OPS = {"_eq", "_neq", "_lt", "_lte", "_gt", "_gte", "_in", "_nin", "_between", "_nbetween", "_null"}


def parse(document: Mapping, model: Model, table: Table) -> Filter:
    """``{column: {op: value}}`` with ``and``, ``or``, ``_search`` and single links; siblings are ANDed."""
    if not document:
        raise FilterError("empty filter")
    parts = []
    for key, value in document.items():
        if key in ("and", "or"):
            if not isinstance(value, list) or not value:
                raise FilterError(f"{key} needs a list with a member")
            members = tuple(parse(v, model, table) for v in value)
            if key == "or" and any(_has_link(m) for m in members):
                raise FilterError("or cannot hold a filter on a link")
            parts.append(And(members) if key == "and" else Or(members))
        elif key == "_search":
            parts.append(Search(value))
        elif key in table.single_links:
            inner = parse(value, model, model.table(table.single_links[key].parent))
            if isinstance(inner, Or) or isinstance(inner, And) and any(isinstance(p, Or) for p in inner.parts):
                raise FilterError("or within a link's filter")
            parts.append(Through(key, inner))
        elif key in table.multi_links or key in table.many_links:
            raise FilterError(f"{key} has many rows; only links to one row can be filtered")
        else:
            column = table.column(key)
            if not isinstance(value, Mapping) or not value:
                raise FilterError(f"{key} needs an operator")
            parts += [comparison(column.name, op, v, column.type) for op, v in value.items()]
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def comparison(name: str, op: str, value: object, kind: T.DataType) -> Cmp:
    """A checked comparison."""
    if op not in TEXT_OPS | PLAIN_OPS:
        raise FilterError(f"unknown operator {op}")
    if op in TEXT_OPS and not isinstance(kind, T.StringType):
        raise FilterError(f"{op} is for text columns, not {name}")
    if op in ("_between", "_nbetween"):
        if not isinstance(value, (list, tuple)) or len(value) < 2:
            raise FilterError(f"{op} needs two values")
        value = list(value[:2])
    if op in ("_in", "_nin"):
        value = list(value) if isinstance(value, (list, tuple)) else [value]
    return Cmp(name, op, value)


def primary_key(table: Table, values: list) -> Filter:
    """Equality with all key columns, by position."""
    if not table.keys or len(values) != len(table.keys):
        raise FilterError(f"{table.name} has {len(table.keys)} key columns, not {len(values)}")
    return And(tuple(Cmp(k, "_eq", v) for k, v in zip(table.keys, values)))


def _has_link(part: Filter) -> bool:
    return isinstance(part, Through) or isinstance(part, (And, Or)) and any(map(_has_link, part.parts))


def literal(value: object, kind: T.DataType) -> Column:
    """A literal of the column's type, so that the comparison can reach the scan."""
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) >= 1 << 63:
        return F.lit(str(value)).cast("decimal(38,0)")
    if isinstance(value, float) and isinstance(kind, T.IntegralType):
        return F.lit(value)
    if isinstance(value, int) and not isinstance(value, bool) and isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) and abs(value) >= 1 << 31:
        return F.lit(value)
    return F.lit(value).cast(kind)


def predicate(column: Column, op: str, value: object, kind: T.DataType) -> Column:
    """One comparison as a Column; null operands and empty lists have their own meaning."""
    if isinstance(value, Column):
        bound = value
    elif isinstance(value, (list, tuple)):
        bound = [literal(v, kind) for v in value]
    elif op in TEXT_OPS or op == "_null":
        bound = value
    else:
        bound = None if value is None else literal(value, kind)
    match op:
        case "_eq":
            return column.isNull() if bound is None else column == bound
        case "_neq":
            return column.isNotNull() if bound is None else column != bound
        case "_null":
            return column.isNotNull() if value is False else column.isNull()
        case "_in":
            return column.isin(*bound) if bound else F.lit(False)
        case "_nin":
            return ~column.isin(*bound) if bound else F.lit(True)
        case "_between":
            return column.between(*bound)
        case "_nbetween":
            return ~column.between(*bound)
    if op in TEXT_OPS:
        negated = op.startswith("_n")
        test = _text(column, op.replace("_n", "_", 1) if negated else op, value)
        return ~test if negated else test
    compare = {"_lt": operator.lt, "_lte": operator.le, "_gt": operator.gt, "_gte": operator.ge}
    if op not in compare:
        raise FilterError(f"unknown operator {op}")
    return compare[op](column, F.lit(None).cast(kind) if bound is None else bound)


def _text(column: Column, op: str, value: object) -> Column:
    match op:
        case "_contains":
            return column.contains(value)
        case "_starts_with":
            return column.startswith(value)
        case "_ends_with":
            return column.endswith(value)
        case "_like":  # the caller's wildcards, and a backslash is only itself
            return column.like(value.replace("\\", "\\\\") if isinstance(value, str) else value)
    raise FilterError(f"unknown operator {op}")


def where(
    df: DataFrame,
    part: Filter | None,
    model: Model,
    table: Table,
    parent: Callable[[Table, Filter], DataFrame],
) -> DataFrame:
    """Rows of ``df`` that satisfy ``part``.

    Predicates become one condition, which Catalyst pushes to the scan.  A filter through a
    link becomes a left semi join with the parents that ``parent`` gives, so that no row
    is repeated; its side is broadcast only if the session's threshold says so.
    """
    if part is None:
        return df
    links, plain = [], []
    for p in part.parts if isinstance(part, And) else [part]:
        if isinstance(p, And):
            df = where(df, p, model, table, parent)
        elif isinstance(p, Through):
            links.append(p)
        elif _has_link(p):
            raise FilterError("or cannot hold a filter on a link")
        else:
            plain.append(condition(df, p, model, table))
    if plain:
        df = df.filter(functools.reduce(operator.and_, plain))
    for p in links:
        link = table.single_links[p.link]
        rows = parent(model.table(link.parent), p.part)
        keys = rows.select(*[F.col(c).alias(f"__parent{k}") for k, c in enumerate(link.parent_columns)])
        on = [df[c] == F.col(f"__parent{k}") for k, c in enumerate(link.child_columns)]
        df = df.join(keys, functools.reduce(operator.and_, on), "left_semi")
    return df


def condition(df: DataFrame, part: Filter, model: Model, table: Table) -> Column:
    """A filter without links as a Column over ``df``."""
    match part:
        case Cmp(name, op, value):
            column = table.column(name)
            return predicate(df[column.name], op, df[table.column(value.column).name] if isinstance(value, Ref) else value, column.type)
        case And(parts):
            return functools.reduce(operator.and_, [condition(df, p, model, table) for p in parts])
        case Or(parts):
            return functools.reduce(operator.or_, [condition(df, p, model, table) for p in parts])
        case Not(inner):
            return ~condition(df, inner, model, table)
        case Const(value):
            return F.lit(value)
        case Search(text):
            names = search_columns(table)
            if not names:
                raise FilterError(f"{table.name} has no search columns")
            return search.matches([df[table.column(n).name] for n in names], text)
    raise FilterError(f"{part!r} is not a predicate")


def search_columns(table: Table) -> list[str]:
    return [c.strip() for c in table.metadata.get("search", "").split(",") if c.strip()]


def columns_of(part: Filter | None, table: Table) -> set[str]:
    """Columns of its own table that a filter reads."""
    match part:
        case Cmp(name, _, value):
            return {name} | ({value.column} if isinstance(value, Ref) else set())
        case And(parts) | Or(parts):
            return set().union(*[columns_of(p, table) for p in parts])
        case Not(inner):
            return columns_of(inner, table)
        case Search():
            return set(search_columns(table))
    return set()


class FilterBuilder:
    """The same vocabulary, fluently: ``FilterBuilder(table).eq("a", 1).any(...).build()``."""

    def __init__(self, table: Table):
        self.table, self.parts = table, []

    def where(self, column: str, op: str, value: object) -> FilterBuilder:
        found = self.table.column(column)
        self.parts.append(comparison(found.name, op, value, found.type))
        return self

    def __getattr__(self, name: str):
        if f"_{name}" not in TEXT_OPS | PLAIN_OPS:
            raise AttributeError(name)
        return lambda column, value=True: self.where(column, f"_{name}", value)

    def in_(self, column: str, values: list) -> FilterBuilder:
        return self.where(column, "_in", values)

    def any(self, *others: FilterBuilder) -> FilterBuilder:
        self.parts.append(Or(tuple(o.build() for o in others)))
        return self

    def through(self, link: str, other: FilterBuilder) -> FilterBuilder:
        if link not in self.table.single_links:
            raise ModelError(f"{self.table.name} has no link {link}")
        self.parts.append(Through(link, other.build()))
        return self

    def build(self) -> Filter:
        if not self.parts:
            raise FilterError("empty filter")
        return both(*self.parts)
