"""OData reads: $filter, $select, $orderby, $top, $skip, $count, $expand over one entity set."""

from __future__ import annotations

import dataclasses
import re
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from ..operators import filters, keys
from ..plans.compile import Compiler, Page
from ..plans.model import Table
from ..plans.nodes import And, Cmp, Filter, Or, Query

DEFAULT_PAGE, MOST_PAGE = 100, 1000
OPS = {"eq": "_eq", "ne": "_neq", "lt": "_lt", "le": "_lte", "gt": "_gt", "ge": "_gte"}
OPPOSITE = {"_eq": "_neq", "_neq": "_eq", "_lt": "_gte", "_gte": "_lt", "_gt": "_lte", "_lte": "_gt", "_in": "_nin", "_nin": "_in", "_contains": "_ncontains", "_ncontains": "_contains"}
#: Fixed: the entity data model's name of each scalar; all others are texts.
EDM = {"Short": "Edm.Int16", "Int": "Edm.Int32", "BigInt": "Edm.Int64", "Decimal": "Edm.Decimal", "Float": "Edm.Double", "Boolean": "Edm.Boolean", "DateTime": "Edm.DateTimeOffset", "DateTimeOffset": "Edm.DateTimeOffset"}
TOKEN = re.compile(r"\s+|(?P<text>'(?:[^']|'')*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w.]*)|(?P<mark>[(),])")


class ODataError(ValueError):
    """A request outside the supported part."""


def parse_filter(text: str, table: Table) -> Filter:
    tokens, at = [], 0
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found:
            raise ODataError(f"unexpected {text[at]!r}")
        if found.lastgroup:
            tokens.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    part, end = _or(tokens, 0, table)
    if end != len(tokens):
        raise ODataError(f"unexpected {tokens[end][1]!r}")
    return part


def _is(tokens, at, word) -> bool:
    return at < len(tokens) and tokens[at][1] == word


def _or(tokens, at, table):
    part, at = _and(tokens, at, table)
    parts = [part]
    while _is(tokens, at, "or"):
        part, at = _and(tokens, at + 1, table)
        parts.append(part)
    return (parts[0] if len(parts) == 1 else Or(tuple(parts))), at


def _and(tokens, at, table):
    part, at = _not(tokens, at, table)
    parts = [part]
    while _is(tokens, at, "and"):
        part, at = _not(tokens, at + 1, table)
        parts.append(part)
    return (parts[0] if len(parts) == 1 else And(tuple(parts))), at


def _not(tokens, at, table):
    if _is(tokens, at, "not"):
        part, at = _not(tokens, at + 1, table)
        return negated(part), at
    return _leaf(tokens, at, table)


def _leaf(tokens, at, table):
    if at >= len(tokens):
        raise ODataError("unexpected end")
    if _is(tokens, at, "("):
        part, at = _or(tokens, at + 1, table)
        if not _is(tokens, at, ")"):
            raise ODataError("missing )")
        return part, at + 1
    if tokens[at][1] == "contains" and _is(tokens, at + 1, "("):
        column = table.column(tokens[at + 2][1])
        if not _is(tokens, at + 3, ",") or not _is(tokens, at + 5, ")"):
            raise ODataError("contains takes a column and a text")
        return filters.comparison(column.name, "_contains", _value(tokens[at + 4]), column.type), at + 6
    column = table.column(tokens[at][1])
    op = tokens[at + 1][1] if at + 1 < len(tokens) else ""
    if op == "in":
        if not _is(tokens, at + 2, "("):
            raise ODataError("in takes a list")
        values, at = [], at + 3
        while not _is(tokens, at, ")"):
            if at >= len(tokens):
                raise ODataError("missing )")
            if not _is(tokens, at, ","):
                values.append(_value(tokens[at]))
            at += 1
        return Cmp(column.name, "_in", values), at + 1
    if op not in OPS or at + 2 >= len(tokens):
        raise ODataError(f"no operator {op}")
    return filters.comparison(column.name, OPS[op], _value(tokens[at + 2]), column.type), at + 3


def _value(token):
    kind, text = token
    if kind == "text":
        return text[1:-1].replace("''", "'")
    if kind == "number":
        return float(text) if "." in text else int(text)
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    raise ODataError(f"{text!r} is not a value")


def negated(part: Filter) -> Filter:
    """``not`` pushed to the comparisons."""
    match part:
        case And(parts):
            return Or(tuple(map(negated, parts)))
        case Or(parts):
            return And(tuple(map(negated, parts)))
        case Cmp(column, op, value):
            return Cmp(column, OPPOSITE[op], value)
    raise ODataError("this cannot be negated")


def tree(options: dict[str, str], compiler: Compiler, entity: str) -> Query:
    table = compiler.model.table(entity)
    known = {"$filter", "$select", "$orderby", "$top", "$skip", "$count", "$expand", "$skiptoken"}
    if set(options) - known:
        raise ODataError(f"unsupported: {', '.join(sorted(set(options) - known))}")
    part = parse_filter(options["$filter"], table) if options.get("$filter") else None
    columns = [table.column(c.strip()).name for c in options["$select"].split(",")] if options.get("$select") else []
    sort = []
    for item in options.get("$orderby", "").split(","):
        if item.strip():
            name, _, direction = item.strip().partition(" ")
            sort.append(f"{table.column(name).name}_{direction.strip() or 'asc'}")
    top = int(options.get("$top", DEFAULT_PAGE))
    if top < 0:
        raise ODataError("$top is negative")
    skip = int(options.get("$skip", 0)) + int(options.get("$skiptoken", 0))
    out = Query(table.name, columns or list(table.columns), filter=part, sort=sort, limit=min(top, MOST_PAGE), offset=skip)
    for name in filter(None, (x.strip() for x in options.get("$expand", "").split(","))):
        link = table.single_links.get(name)
        target = link.parent if link else table.multi_links[name].child if name in table.multi_links else None
        if target is None:
            raise ODataError(f"no navigation {name}")
        out.links[name] = Query(target, list(compiler.model.table(target).columns), limit=MOST_PAGE)
    return out


def execute(compiler: Compiler, entity: str, options: dict[str, str]) -> DataFrame:
    """With what ``$expand`` asks for; more than ``MOST_PAGE`` expanded rows in all are an error."""
    query = tree(options, compiler, entity)
    table = compiler.model.table(entity)
    for name in query.links:
        link = table.multi_links.get(name)
        if link and len(link.parent_columns) == 1:
            rows = compiler.page_rows(dataclasses.replace(query, links={}))
            keys.expanded(rows, compiler.scan(compiler.model.table(link.child)), link.parent_columns[0], link.child_columns[0], MOST_PAGE)
    return compiler.nested(query)


def metadata(compiler: Compiler) -> str:
    """``$metadata``: entity types with keys, properties and navigations, as far as the caller may see them."""
    sets, types = [], []
    shown = compiler.policy.visible(compiler.model.overview(), compiler.context)
    names = {entry["table"] for entry in shown}
    for entry in shown:
        table = compiler.model.table(entry["table"])
        keyed = "".join(f'<PropertyRef Name="{escape(k)}"/>' for k in entry["keys"])
        lines = [f"<Key>{keyed}</Key>"] if keyed else []
        lines += [f'<Property Name="{escape(c["name"])}" Type="{EDM.get(c["scalar"], "Edm.String")}" Nullable="{str(c["nullable"] and not c["is_key"]).lower()}"/>' for c in entry["columns"]]
        ends = {n: f"Main.{x.parent}" for n, x in table.single_links.items() if x.parent in names}
        ends |= {n: f"Collection(Main.{x.child})" for n, x in table.multi_links.items() if x.child in names}
        lines += [f'<NavigationProperty Name="{escape(n)}" Type="{escape(kind)}"/>' for n, kind in sorted(ends.items())]
        types.append(f'<EntityType Name="{escape(table.name)}">{"".join(lines)}</EntityType>')
        if keyed:
            sets.append(f'<EntitySet Name="{escape(table.name)}" EntityType="Main.{escape(table.name)}"/>')
    schema = f'<Schema Namespace="Main" xmlns="http://docs.oasis-open.org/odata/ns/edm">{"".join(types)}<EntityContainer Name="Container">{"".join(sets)}</EntityContainer></Schema>'
    return f'<?xml version="1.0" encoding="utf-8"?><edmx:Edmx Version="4.0" xmlns:edmx="http://docs.oasis-open.org/odata/ns/edmx"><edmx:DataServices>{schema}</edmx:DataServices></edmx:Edmx>'


def page(compiler: Compiler, entity: str, options: dict[str, str]) -> Page:
    """With the total that ``$count`` asks for."""
    return compiler.page(tree(options, compiler, entity))
