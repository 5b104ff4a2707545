"""Metadata rules: ``selector, selector { key: value; key: value }``.

A selector is ``:root`` or dotted globs (table, schema.table or schema.table.column),
optionally followed by ``| has(columnGlob)``.  The first colon ends the key; a semicolon
within backquotes belongs to the value.
"""

from __future__ import annotations

import re

from .model import ModelError


def parse(text: str) -> list[tuple[str, dict[str, str], str | None]]:
    """(selector, values, needed column) for each selector of each rule, in order."""
    out, at = [], 0
    while text[at:].strip():
        brace = text.find("{", at)
        end = _outside(text, "}", brace + 1)
        if brace < 0 or end < 0:
            raise ModelError(f"unfinished rule: {text[at:].strip()[:60]}")
        values = {}
        for item in _split(text[brace + 1 : end], ";"):
            if not item.strip():
                continue
            key, colon, value = item.partition(":")
            if not colon or not key.strip():
                raise ModelError(f"no key in {item.strip()!r}")
            values[key.strip()] = value.strip().strip("`")
        for selector in text[at:brace].split(","):
            glob, bar, needs = selector.partition("|")
            has = re.fullmatch(r"\s*has\(([^)]+)\)\s*", needs)
            if not glob.strip() or bar and not has:
                raise ModelError(f"bad selector {selector.strip()!r}")
            out.append((glob.strip(), dict(values), has[1].strip() if has else None))
        at = end + 1
    return out


def _outside(text: str, mark: str, at: int) -> int:
    """First ``mark`` from ``at`` that is not within backquotes."""
    quoted = False
    for k in range(at, len(text)):
        if text[k] == "`":
            quoted = not quoted
        elif text[k] == mark and not quoted:
            return k
    return -1


def _split(text: str, mark: str) -> list[str]:
    parts, at = [], 0
    while (k := _outside(text, mark, at)) >= 0:
        parts.append(text[at:k])
        at = k + 1
    return [*parts, text[at:]]
