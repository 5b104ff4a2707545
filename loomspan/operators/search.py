"""Full-text terms, and ranked search over all text columns of a model."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranked search: shortest term, candidates and results of one table, results overall.
LEAST_TERM, CANDIDATES, PER_TABLE, OVERALL = 2, 50, 5, 50


def terms(text: str) -> list[str]:
    """Words, and phrases in double quotes; a quote left open runs to the end."""
    return [t.strip() for t in re.findall(r'"([^"]*)"?|([^\s"]+)', text) for t in t if t.strip()]


def matches(columns: list[Column], text: str) -> Column:
    """All terms as whole words, in any case, each in any of the columns; a phrase within one column."""
    tests = []
    for term in terms(text):
        words = re.findall(r"\w+", term)
        if not words:
            continue
        # \b would miss words next to letters outside ASCII, so word edges are spelt out.
        pattern = r"(?iu)(?<![\p{L}\p{N}_])" + r"[^\p{L}\p{N}_]+".join(words) + r"(?![\p{L}\p{N}_])"
        tests.append(functools.reduce(operator.or_, [c.rlike(pattern) for c in columns]))
    return functools.reduce(operator.and_, tests) if tests else F.lit(True)


def ranked(frames: dict[str, tuple[DataFrame, list[str]]], term: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text columns hold the term: (results, totals).

    ``frames`` has each table's DataFrame and keys.  Candidates of a table are its first by
    key; those with more matching columns rank higher.  Limits are the feature here: they
    become top-k operators, never a collect.
    """
    if len(term) < LEAST_TERM:
        raise ValueError(f"a term has {LEAST_TERM} characters or more")
    results, totals = [], []
    for name, (df, keys) in sorted(frames.items()):
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if not texts:
            continue
        hit = df.filter(functools.reduce(operator.or_, [F.col(c).contains(term) for c in texts]))
        totals.append(hit.agg(F.count("*").alias("total")).select(F.lit(name).alias("table"), "total"))
        key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
        matched = F.array_compact(F.array(*[F.when(F.lower(c).contains(term.lower()), F.lit(c)) for c in texts]))
        order = [F.col(k) for k in keys] or [F.col(c) for c in df.columns]
        first = hit.orderBy(*order).limit(CANDIDATES).select(F.lit(name).alias("table"), key.alias("row_key"), matched.alias("matched"))
        first = first.withColumn("score", F.size("matched"))
        results.append(first.orderBy(F.desc("score"), "row_key").limit(PER_TABLE))
    if not results:
        raise ValueError("no table has text columns")
    union = functools.reduce(DataFrame.unionByName, results)
    return union.orderBy(F.desc("score"), "table", "row_key").limit(OVERALL), functools.reduce(DataFrame.unionByName, totals)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; the window's limit is pushed below its shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rn") <= n)
