"""Stored values and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.nodes import And, Cmp, Const, Filter, Not, Or

#: Values that one literal map may hold; a lookup table beyond that stays a table.
MOST_VALUES = 1000


def load(lookup: DataFrame, value: str, name: str) -> dict:
    """Value to name of a lookup table, which must be small."""
    rows = lookup.select(value, name).limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values")
    return dict(rows)


def named(column: Column, names: dict) -> Column:
    """Names for stored values; an unknown value is null."""
    out = F.lit(None).cast("string")
    for value, name in names.items():
        out = F.when(column == F.lit(value), F.lit(name)).otherwise(out)
    return out


def stored(part: Filter, column: str, names: dict) -> Filter:
    """A filter on names as one on stored values; an unknown name matches nothing."""
    values = {n: v for v, n in names.items()}
    match part:
        case Cmp(c, op, value) if c == column:
            if isinstance(value, (list, tuple)):
                return Cmp(c, op, [values[v] for v in value if v in values])
            return Cmp(c, op, values[value]) if value in values else part if value is None or op == "_null" else Const(False)
        case And(parts):
            return And(tuple(stored(p, column, names) for p in parts))
        case Or(parts):
            return Or(tuple(stored(p, column, names) for p in parts))
        case Not(inner):
            return Not(stored(inner, column, names))
    return part


def transitions(column: Column, allowed: dict[str, list[str]]) -> Column:
    """States that a row may go to next."""
    out = F.array().cast("array<string>")
    for state, following in allowed.items():
        out = F.when(F.lower(column) == state.lower(), F.array(*map(F.lit, following)) if following else F.array().cast("array<string>")).otherwise(out)
    return out
