"""The closed expression language of computed columns, lowered to built-in functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExprError(ValueError):
    """An expression outside the language, or one that names what is not there."""


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Fn:
    name: str
    args: tuple


@dataclass(frozen=True)
class Concat:
    parts: tuple


@dataclass(frozen=True)
class Case:
    operand: object
    branches: tuple  # (value, result)
    otherwise: object = None


@dataclass(frozen=True)
class Cast:
    part: object
    to: str  # Text or Int


@dataclass(frozen=True)
class DateAdd:
    source: object
    unit: str
    n: object


@dataclass(frozen=True)
class DateDiff:
    unit: str
    start: object
    end: object


@dataclass(frozen=True)
class DatePart:
    unit: str
    source: object


@dataclass(frozen=True)
class JsonGet:
    source: object
    path: tuple[str, ...]


Expr = Col | Lit | Param | Fn | Concat | Case | Cast | DateAdd | DateDiff | DatePart | JsonGet

#: Least and most arguments of each function.
ARITY = {"UPPER": (1, 1), "LOWER": (1, 1), "LEN": (1, 1), "COALESCE": (2, None), "ABS": (1, 1), "ROUND": (2, 2)}
#: Microseconds of the units that have a fixed length.
MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
DEPTH = 32


def lower(expr: Expr, column: Callable[[str], Column], params: Mapping[str, object] | None = None) -> Column:
    """The expression as a Column; ``column`` resolves names and fails on unknown ones."""
    go = lambda e: lower(e, column, params)
    match expr:
        case Col(name):
            return column(name)
        case Lit(value):
            return F.lit(value)
        case Param(name):
            if params is None or name not in params:
                raise ExprError(f"no parameter {name}")
            return F.lit(params[name])
        case Fn(name, args):
            return _function(name, [go(a) if not (name == "ROUND" and k == 1) else a for k, a in enumerate(args)])
        case Concat(parts):
            if len(parts) < 2:
                raise ExprError("concatenation needs two parts or more")
            return F.concat(*[go(p).cast("string") for p in parts])
        case Case(operand, branches, otherwise):
            if not branches:
                raise ExprError("a case needs a branch")
            on, out = go(operand), None
            for value, result in branches:
                test = on == go(value)
                out = F.when(test, go(result)) if out is None else out.when(test, go(result))
            return out.otherwise(go(otherwise) if otherwise is not None else F.lit(None))
        case Cast(part, to):
            kinds = {"Text": "string", "Int": "int"}
            if to not in kinds:
                raise ExprError(f"no cast to {to}")
            return go(part).cast(kinds[to])
        case DateAdd(source, unit, n):
            _check(unit, [*PARTS, "week"])
            return F.timestamp_add(unit.upper(), go(n).cast("int"), go(source))
        case DateDiff(unit, start, end):
            _check(unit, MICROS)
            passed = F.unix_micros(go(end).cast("timestamp")) - F.unix_micros(go(start).cast("timestamp"))
            return F.floor(passed / F.lit(MICROS[unit]))
        case DatePart(unit, source):
            _check(unit, PARTS)
            return PARTS[unit](go(source))
        case JsonGet(source, path):
            for name in path:
                if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
                    raise ExprError(f"bad path segment {name!r}")
            return F.get_json_object(go(source), "$." + ".".join(path))
    raise ExprError(f"unknown node {expr!r}")


def _check(unit: str, known) -> None:
    if unit not in known:
        raise ExprError(f"unit {unit} is not supported here")


def _function(name: str, args: list) -> Column:
    if name not in ARITY:
        raise ExprError(f"unknown function {name}")
    least, most = ARITY[name]
    if len(args) < least or most is not None and len(args) > most:
        raise ExprError(f"{name} does not take {len(args)} arguments")
    match name:
        case "UPPER":
            return F.upper(args[0])
        case "LOWER":
            return F.lower(args[0])
        case "LEN":
            return F.length(args[0])
        case "COALESCE":
            return F.coalesce(*args)
        case "ABS":
            return F.abs(args[0])
    if not isinstance(args[1], Lit) or not isinstance(args[1].value, int):
        raise ExprError("ROUND takes a number of digits")
    return F.round(args[0], args[1].value)


TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*')|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<mark>\|\||[(),]))")


def parse(text: str) -> Expr:
    """``concat := primary ('||' primary)*`` with strings, numbers, names, calls and parentheses."""
    tokens, at = [], 0
    while text[at:].strip():
        found = TOKEN.match(text, at)
        if not found:
            raise ExprError(f"unexpected {text[at:].strip()[:20]!r}")
        tokens.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    expr, end = _concat(tokens, 0, 0)
    if end != len(tokens):
        raise ExprError(f"unexpected {tokens[end][1]!r}")
    return expr


def _concat(tokens: list, at: int, depth: int) -> tuple[Expr, int]:
    if depth > DEPTH:
        raise ExprError("nested too deeply")
    part, at = _primary(tokens, at, depth)
    parts = [part]
    while at < len(tokens) and tokens[at][1] == "||":
        part, at = _primary(tokens, at + 1, depth)
        parts.append(part)
    return (parts[0] if len(parts) == 1 else Concat(tuple(parts))), at


def _primary(tokens: list, at: int, depth: int) -> tuple[Expr, int]:
    if at >= len(tokens):
        raise ExprError("unexpected end")
    kind, word = tokens[at]
    if kind == "text":
        return Lit(word[1:-1].replace("''", "'")), at + 1
    if kind == "number":
        return Lit(float(word) if "." in word else int(word)), at + 1
    if kind == "name":
        if at + 1 < len(tokens) and tokens[at + 1][1] == "(":
            args, at = [], at + 2
            while tokens[at : at + 1] and tokens[at][1] != ")":
                arg, at = _concat(tokens, at, depth + 1)
                args.append(arg)
                if tokens[at : at + 1] and tokens[at][1] == ",":
                    at += 1
                elif not tokens[at : at + 1] or tokens[at][1] != ")":
                    raise ExprError("unfinished arguments")
            if at >= len(tokens):
                raise ExprError("unfinished arguments")
            return Fn(word.upper(), tuple(args)), at + 1
        return Col(word), at + 1
    if word == "(":
        inner, at = _concat(tokens, at + 1, depth + 1)
        if at >= len(tokens) or tokens[at][1] != ")":
            raise ExprError("missing )")
        return inner, at + 1
    raise ExprError(f"unexpected {word!r}")


def raw_sql(template: str, column: Callable[[str], Column]) -> str:
    """The older form: SQL with ``{column}`` places; statements and comments are refused."""
    for mark in (";", "--", "/*", "*/"):
        if mark in template:
            raise ExprError(f"{mark} is not allowed")
    for name in re.findall(r"\{(\w+)\}", template):
        column(name)
    return re.sub(r"\{(\w+)\}", r"`\1`", template)
