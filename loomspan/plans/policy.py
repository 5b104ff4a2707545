"""Mandatory rewriting of every query: row filters, column guards, masks.

Rewriters see one table at a time, wherever a query reads it: at the root, behind a link,
in a join, in an aggregate's chain or within a filter.  Their filters are ANDed in order of
priority; there is no way to read a table around them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..functions import crypto, masks
from .model import Table
from .nodes import And, Cmp, Const, Filter, Not, Or, both


class AccessDenied(PermissionError):
    """The caller may not read or write this."""


@dataclass
class Context:
    """The caller: claims, roles, and profile switches by rewriter name."""

    claims: Mapping[str, object] = field(default_factory=dict)
    roles: frozenset[str] = frozenset()
    off: frozenset[str] = frozenset()
    admin_role: str = "admin"

    @property
    def is_admin(self) -> bool:
        return self.admin_role in self.roles


ANYONE = Context()


@dataclass(frozen=True)
class Profile:
    """A named choice of rewriters; security rewriters cannot be switched off by one."""

    name: str
    off: frozenset[str] = frozenset()

    def context(self, base: Context) -> Context:
        locked = {r.name for r in BUILT_IN if r.priority < 100}
        if self.off & locked:
            raise AccessDenied(f"profile {self.name}: {', '.join(sorted(self.off & locked))}")
        return Context(base.claims, base.roles, base.off | self.off, base.admin_role)


class Rewriter:
    name, priority = "", 200

    def row_filter(self, table: Table, context: Context, deleted: str) -> Filter | None:
        return None


class Tenant(Rewriter):
    """``tenant-filter: column`` pins it to the caller's tenant; without one there is no access."""

    name, priority = "tenant", 0

    def row_filter(self, table, context, deleted):
        column = table.metadata.get("tenant-filter")
        if not column:
            return None
        value = context.claims.get(table.metadata.get("tenant-context-key", "tenant_id"))
        if value is None:
            raise AccessDenied(f"{table.name}: no tenant")
        return Cmp(column, "_eq", value)


class AutoFilter(Rewriter):
    """``auto-filter: column:claim, ...``; a list claim allows any of its values."""

    name, priority = "auto-filter", 1

    def row_filter(self, table, context, deleted):
        spec = table.metadata.get("auto-filter")
        bypass = table.metadata.get("auto-filter-bypass-role")
        if not spec or bypass and bypass in context.roles:
            return None
        parts = []
        for pair in spec.split(","):
            column, claim = (x.strip() for x in pair.split(":"))
            value = context.claims.get(claim)
            if value is None or isinstance(value, (list, tuple)) and not value:
                raise AccessDenied(f"{table.name}: no claim {claim}")
            parts.append(Cmp(column, "_in", list(value)) if isinstance(value, (list, tuple)) else Cmp(column, "_eq", value))
        return both(*parts)


class RowScope(Rewriter):
    """``policy-actions`` and ``policy-row-scope: column = {claim}``, which roles may be exempt from."""

    name, priority = "policy", 1

    def row_filter(self, table, context, deleted):
        actions = table.metadata.get("policy-actions")
        if actions is not None and "read" not in {a.strip() for a in actions.split(",")} and not context.is_admin:
            raise AccessDenied(f"{table.name}: read")
        return self.scope(table, context)

    @staticmethod
    def scope(table: Table, context: Context) -> Filter | None:
        scope = table.metadata.get("policy-row-scope")
        roles = {r.strip() for r in table.metadata.get("policy-row-scope-roles", "").split(",") if r.strip()}
        if not scope or context.is_admin or roles and not roles & context.roles:
            return None
        found = re.fullmatch(r"\s*(\w+)\s*=\s*\{(\w+)\}\s*", scope)
        if not found:
            raise ValueError(f"{table.name}: bad row scope {scope!r}")
        value = context.claims.get(found[2])
        if value is None:
            raise AccessDenied(f"{table.name}: no claim {found[2]}")
        return Cmp(found[1], "_eq", value)


class SoftDelete(Rewriter):
    """``soft-delete: column`` hides rows where it is set, unless the query asks for them."""

    name, priority = "soft-delete", 100

    def row_filter(self, table, context, deleted):
        column = table.metadata.get("soft-delete")
        if not column or deleted == "include":
            return None
        return Cmp(column, "_null", deleted != "only")


BUILT_IN = (Tenant(), AutoFilter(), RowScope(), SoftDelete())


def write_scope(table: Table, context: Context) -> Filter | None:
    """Rows that the caller may write: those of the tenant, of the claims and of the row scope."""
    found = [Tenant().row_filter(table, context, "include"), AutoFilter().row_filter(table, context, "include"), RowScope.scope(table, context)]
    return both(*[f for f in found if f is not None])


class Policy:
    """All rewriters in order, and the guards and masks of columns."""

    def __init__(self, rewriters: tuple[Rewriter, ...] = BUILT_IN, keys: dict[int, bytes] | None = None):
        self.rewriters = sorted(rewriters, key=lambda r: r.priority)
        self.keys = keys or {}
        self.observers = []

    def row_filter(self, table: Table, context: Context, deleted: str = "hide") -> Filter | None:
        found = [r.row_filter(table, context, deleted) for r in self.rewriters if r.name not in context.off]
        return both(*[f for f in found if f is not None and f != Const(True)])

    def guard_read(self, table: Table, names: set[str], context: Context) -> None:
        """No use at all of a denied column, be it shown, filtered, sorted or aggregated."""
        denied = {c.strip() for c in table.metadata.get("policy-read-deny", "").split(",") if c.strip()}
        for name in {table.column(n).name for n in names if table.has_column(n)}:
            if not context.is_admin and (name in denied or table.columns[name].metadata.get("visibility") == "hidden"):
                raise AccessDenied(f"{table.name}.{name}")

    def guard_use(self, table: Table, names: set[str]) -> None:
        """An encrypted column can be shown but not filtered, sorted or aggregated."""
        for name in names:
            if table.has_column(name) and table.column(name).metadata.get("encrypt"):
                raise AccessDenied(f"{table.name}.{name} is encrypted")

    def blinded(self, table: Table, part: Filter | None) -> Filter | None:
        """Equality with an encrypted column as equality with its blind index; nothing else is possible."""
        match part:
            case Cmp(name, op, value) if table.has_column(name) and table.column(name).metadata.get("blind-index") and self.keys:
                if op not in ("_eq", "_in") or value is None:
                    return part
                key, index = self.keys[max(self.keys)], table.column(name).metadata["blind-index"]
                tokens = [crypto.blind_token(str(v), key) for v in (value if op == "_in" else [value])]
                return Cmp(index, op, tokens if op == "_in" else tokens[0])
            case And(parts):
                return And(tuple(self.blinded(table, p) for p in parts))
            case Or(parts):
                return Or(tuple(self.blinded(table, p) for p in parts))
            case Not(inner):
                return Not(self.blinded(table, inner))
        return part

    def shown(self, table: Table, name: str, column, context: Context):
        """The column as the caller may see it: opened if it is encrypted, masked if it must be."""
        metadata = table.column(name).metadata
        if metadata.get("encrypt") and self.keys:
            column = crypto.decrypt(column, self.keys, crypto.place(table.schema, table.name, table.column(name).name))
        if metadata.get("read-as") == "text":
            column = column.cast("string")
        mask = metadata.get("mask")
        role = metadata.get("unmask-role")
        if not mask or context.is_admin or role and role in context.roles:
            return column
        return masks.mask(column, mask)

    def visible(self, overview: list[dict], context: Context) -> list[dict]:
        """Introspection without hidden tables and denied columns."""
        out = []
        for entry in overview:
            if entry["metadata"].get("visibility") == "hidden" and not context.is_admin:
                continue
            denied = set() if context.is_admin else {c.strip() for c in entry["metadata"].get("policy-read-deny", "").split(",")}
            out.append(entry | {"columns": [c for c in entry["columns"] if c["name"] not in denied]})
        return out

    def observe(self, phase: str, table: str, **facts) -> None:
        for observer in self.observers:
            observer(phase, table, facts)
