"""Masks of sensitive values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "••••••"
DOTS = "••••"


def mask(column: Column, kind: str) -> Column:
    """``redact``, ``last4`` or ``email``; null stays null."""
    text = column.cast("string")
    match kind:
        case "redact":
            out = F.lit(REDACTED)
        case "last4":
            out = F.when(F.length(text) <= 4, F.lit(REDACTED)).otherwise(F.concat(F.lit(DOTS), F.right(text, F.lit(4))))
        case "email":
            at = F.instr(text, "@")
            shown = F.concat(F.substring(text, 1, 1), F.lit(DOTS), F.substring(text, at, F.length(text)))
            out = F.when(at > 1, shown).otherwise(F.lit(REDACTED))
        case _:
            raise ValueError(f"no mask {kind}")
    return F.when(text.isNotNull(), out)
