"""The query tree that every front end builds and ``compile`` turns into DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.expr import Expr

DEFAULT_LIMIT = 100
UNLIMITED = -1


@dataclass(frozen=True)
class Ref:
    """Another column as an operand."""

    column: str


@dataclass(frozen=True)
class Cmp:
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Search:
    text: str


@dataclass(frozen=True)
class Through:
    """Rows whose single-link parent satisfies a filter."""

    link: str
    part: object


Filter = Cmp | And | Or | Not | Const | Search | Through


@dataclass(frozen=True)
class Aggregate:
    """Aggregate of ``column`` over a chain of links from the row."""

    alias: str
    operation: str
    path: tuple[str, ...]
    column: str
    last_filter: Filter | None = None


@dataclass(frozen=True)
class Join:
    """Explicit theta join: ``source.left op target.right``."""

    alias: str
    query: Query
    left: str
    right: str
    op: str = "_eq"
    single: bool = False


@dataclass
class Query:
    table: str
    columns: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    filter: Filter | None = None
    sort: list[str] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    links: dict[str, Query] = field(default_factory=dict)  # alias -> query of the linked table
    link_names: dict[str, str] = field(default_factory=dict)  # alias -> link, where they differ
    joins: list[Join] = field(default_factory=list)
    aggregates: list[Aggregate] = field(default_factory=list)
    computed: dict[str, Expr] = field(default_factory=dict)
    deleted: str = "hide"  # hide, include or only

    def page(self) -> tuple[int, int]:
        """(offset, limit), the limit -1 for all rows."""
        limit = DEFAULT_LIMIT if self.limit is None else self.limit
        if limit < UNLIMITED:
            raise ValueError(f"limit {limit}")
        if self.offset < 0:
            raise ValueError(f"offset {self.offset}")
        return self.offset, limit


def both(*parts: Filter | None) -> Filter | None:
    """AND of those that are there."""
    real = tuple(p for p in parts if p is not None)
    return None if not real else real[0] if len(real) == 1 else And(real)
