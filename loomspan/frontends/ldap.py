"""LDAP search filters, exactly and with three-valued logic."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import literal
from ..plans.compile import Compiler
from ..plans.model import ModelError, Table
from ..plans.nodes import Filter


class LdapError(ValueError):
    """A filter outside the grammar."""


def predicate(text: str, table: Table) -> Column:
    """``(&(a=b)(!(c=*))(d>=1)(e~=x)(f=x*y))``; an unknown attribute is undefined, so it matches nothing."""
    column, at = _filter(text.strip(), 0, table)
    if at != len(text.strip()):
        raise LdapError(f"unexpected {text.strip()[at:][:10]!r}")
    return column


def _filter(text: str, at: int, table: Table) -> tuple[Column, int]:
    if text[at : at + 1] != "(":
        raise LdapError("( expected")
    mark = text[at + 1 : at + 2]
    if mark in ("&", "|"):
        parts, at = [], at + 2
        while text[at : at + 1] == "(":
            part, at = _filter(text, at, table)
            parts.append(part)
        if text[at : at + 1] != ")":
            raise LdapError(") expected")
        empty = F.lit(mark == "&")
        return functools.reduce(operator.and_ if mark == "&" else operator.or_, parts) if parts else empty, at + 1
    if mark == "!":
        part, at = _filter(text, at + 2, table)
        if text[at : at + 1] != ")":
            raise LdapError(") expected")
        return ~part, at + 1
    end = text.find(")", at)
    found = re.fullmatch(r"([\w-]+)(=|>=|<=|~=)(.*)", text[at + 1 : end], re.S)
    if end < 0 or not found:
        raise LdapError(f"bad comparison {text[at:][:20]!r}")
    name, op, raw = found.groups()
    if not table.has_column(name):
        return F.lit(None).cast("boolean"), end + 1
    return _test(table, name, op, raw), end + 1


def _unescaped(text: str) -> str:
    return re.sub(r"(?:\\[0-9a-fA-F]{2})+", lambda m: bytes.fromhex(m[0].replace("\\", "")).decode(), text)


def _test(table: Table, name: str, op: str, raw: str) -> Column:
    found = table.column(name)
    column = F.col(found.name)
    if op == "=" and raw == "*":
        return column.isNotNull()
    if op == "=" and "*" in raw:
        pieces = [_unescaped(p) for p in raw.split("*")]
        pattern = "%".join(re.sub(r"([\\%_])", r"\\\1", p) for p in pieces)
        return column.cast("string").like(pattern)
    text = _unescaped(raw)
    if op == "~=":
        return F.lower(F.trim(column.cast("string"))) == text.strip().lower()
    try:
        value = literal(text, found.type) if isinstance(found.type, (T.StringType, T.TimestampNTZType, T.TimestampType, T.DateType)) else literal(float(text), T.DoubleType())
    except ValueError:
        return F.lit(None).cast("boolean")
    return {"=": column == value, ">=": column >= value, "<=": column <= value}[op]


def search(compiler: Compiler, table: str, text: str, attributes: list[str]) -> DataFrame:
    target = compiler.model.table(table)
    compiler.policy.guard_read(target, set(attributes), compiler.context)
    compiler.policy.guard_read(target, set(re.findall(r"\(([\w-]+)(?:=|>=|<=|~=)", text)), compiler.context)
    return compiler.scan(target).filter(predicate(text, target)).select(*attributes)


@dataclass
class Entries:
    """A family of entries: a table's rows, named ``attribute=column,base``."""

    table: str
    attribute: str
    column: str
    base: str
    filter: Filter | None = None

    def named(self, compiler: Compiler, key: str, alias: str) -> DataFrame:
        """(key, name) of the entries that the caller may see."""
        table = compiler.model.table(self.table)
        compiler.policy.guard_read(table, {self.column, key}, compiler.context)
        value = F.regexp_replace(F.col(table.column(self.column).name).cast("string"), r'([,+"\\<>;=])|^([ #])| $', r"\\$0")
        name = F.concat(F.lit(f"{self.attribute}="), value, F.lit(f",{self.base}"))
        return compiler.scan(table, self.filter).select(F.col(key).alias(f"__{alias}"), name.alias(alias))


def members(compiler: Compiler, groups: Entries, relationship: str, people: Entries) -> DataFrame:
    """(dn, member): a row for each member of each group, through a junction or of children.

    Both sides are what the caller may see.  Groups of any size stay spread over rows.
    """
    table = compiler.model.table(groups.table)
    if relationship in table.many_links:
        link = table.many_links[relationship]
        pairs = _pairs(compiler, link)
        found = pairs.join(groups.named(compiler, link.source_column, "dn"), F.col("__source") == F.col("__dn"))
        return found.join(people.named(compiler, link.target_column, "member"), F.col("__target") == F.col("__member")).select("dn", "member")
    link = table.multi_links.get(relationship)
    if link is None or len(link.parent_columns) > 1:
        raise ModelError(f"no membership {relationship}")
    found = groups.named(compiler, link.parent_columns[0], "dn")
    return found.join(people.named(compiler, link.child_columns[0], "member"), F.col("__dn") == F.col("__member")).select("dn", "member")


def member_of(compiler: Compiler, people: Entries, groups: Entries, relationship: str) -> DataFrame:
    """(dn, memberOf): a row for each group of each entry, the other way through the groups' junction.

    Children carry their one parent themselves, and publish none.
    """
    link = compiler.model.table(groups.table).many_links.get(relationship)
    if link is None or link.target != compiler.model.table(people.table).name:
        raise ModelError(f"no junction {relationship}")
    found = _pairs(compiler, link).join(people.named(compiler, link.target_column, "dn"), F.col("__target") == F.col("__dn"))
    return found.join(groups.named(compiler, link.source_column, "memberOf"), F.col("__source") == F.col("__memberOf")).select("dn", "memberOf")


def _pairs(compiler: Compiler, link) -> DataFrame:
    junction = compiler.scan(compiler.model.table(link.junction))
    return junction.select(F.col(link.junction_source).alias("__source"), F.col(link.junction_target).alias("__target")).distinct()
