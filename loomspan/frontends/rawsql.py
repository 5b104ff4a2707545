"""Raw SQL for trusted roles: one SELECT or WITH, nothing that writes, a row cap."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

from ..plans.compile import Compiler
from ..plans.policy import AccessDenied

MOST_ROWS = 10_000
#: Words that no read needs.
DENIED = {
    "insert", "update", "delete", "merge", "drop", "alter", "create", "truncate", "grant", "revoke", "exec", "execute",
    "call", "set", "use", "cache", "uncache", "refresh", "load", "export", "import", "add", "reset", "analyze", "msck",
    "repair", "into", "replace", "transform", "reflect", "java_method", "declare",
}


class RawSqlError(ValueError):
    """SQL that is not a plain read."""


def _bare(sql: str, backslash: bool) -> str:
    """The statement without strings, quoted names and comments."""
    escape = r"\\.|" if backslash else ""
    pattern = rf"'(?:{escape}''|[^'])*'|\"(?:{escape}\"\"|[^\"])*\"|`(?:``|[^`])*`|--[^\n]*|/\*[\s\S]*?\*/"
    return re.sub(pattern, " ", sql)


def validate(sql: str) -> None:
    """Checked with and without backslash escapes, as engines differ on them."""
    for backslash in (False, True):
        bare = _bare(sql, backslash).strip().rstrip(";").strip()
        if ";" in bare:
            raise RawSqlError("one statement at a time")
        if re.search(r"['\"`]|/\*", bare):
            raise RawSqlError("a quote or comment stays open")
        words = re.findall(r"[A-Za-z_]\w*", bare.lower())
        if not words or words[0] not in ("select", "with"):
            raise RawSqlError("only SELECT and WITH")
        if found := DENIED.intersection(words):
            raise RawSqlError(f"{', '.join(sorted(found))} not allowed")


def execute(compiler: Compiler, sql: str, params: dict | None = None, role: str = "raw-sql", limit: int = MOST_ROWS) -> DataFrame:
    """Runs over the tables as the caller may see them; named parameters are bound, not pasted."""
    if role not in compiler.context.roles and not compiler.context.is_admin:
        raise AccessDenied("raw SQL")
    validate(sql)
    frames = {}
    for table in compiler.model.tables.values():
        if re.search(rf"\b{re.escape(table.name)}\b", sql, re.I):
            frames[table.name] = compiler.scan(table)
    if not frames:
        raise RawSqlError("no table")
    spark = next(iter(frames.values())).sparkSession
    own = {name: f"__raw_{uuid.uuid4().hex}" for name in frames}
    text = re.sub(r"('(?:''|[^'])*')|\b(" + "|".join(map(re.escape, own)) + r")\b(?!\s*\()(?!\.)", lambda m: m[1] or own.get(m[2], m[2]), sql.strip().rstrip(";"))
    try:  # analysed at once, so that no view stays behind
        for name, frame in frames.items():
            frame.createTempView(own[name])
        found = spark.sql(text, args=params or {})
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)
    confined(found, set(own.values()))
    return found.limit(min(limit, MOST_ROWS))


def confined(df: DataFrame, views: set[str]) -> None:
    """Refuses a plan that reads anything but the tables as the caller may see them.

    Every view and leaf of the analysed plan has to stand below one of ``views``, or hold no table.
    """
    lines = [re.match(r"^([ :+-]*)(.*)$", x).groups() for x in df._jdf.queryExecution().analyzed().toString().splitlines() if x.strip()]
    above: list[tuple[int, str]] = []
    for k, (indent, node) in enumerate(lines):
        while above and above[-1][0] >= len(indent):
            above.pop()
        leaf = k + 1 == len(lines) or len(lines[k + 1][0]) <= len(indent)
        inside = any(re.match(rf"(SubqueryAlias|View) \W*({'|'.join(views)})\b", x) for _, x in above)
        own = re.match(rf"View \W*({'|'.join(views)})\b", node)
        harmless = not node.startswith("View ") and (not leaf or re.match(r"OneRowRelation|LocalRelation|Range|CTERelationRef", node))
        if not inside and not own and not harmless:
            raise AccessDenied("raw SQL reads what is no table of the model")
        above.append((len(indent), node))
