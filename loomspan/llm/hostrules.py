"""Quality rules on documents, and verdicts on the hosts they come from.

All of it is built-in expressions.  Rule counts come from arrays within a row, so that a
document of any length stays in one row and nothing is shuffled for them.  Failures are
summed by host, rates are shrunk towards all hosts by a beta prior whose mean and strength
the rates themselves give (moments), and hosts whose failure rate is surely above a limit
are rejected with all their documents.

Defined results: a null text has no words and fails; a null host is a host of its own;
repeated rows each count; with one host the prior is that host's own rate; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, small_enough

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
MOST_SYMBOLS = 25  # percent of the characters in words
MOST_DUPLICATE_LINES = 30  # percent of the lines
WINDOW = 5
LIMIT, Z = 0.5, 1.645
MOST_HOSTS = 100_000


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def counts(docs: DataFrame, host: str) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.char_length(without(text, SPACES)).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.char_length(without(x, SPACES)) > 0).alias("lines"),
        F.transform(
            F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), ""), lambda w: F.xxhash64(w)
        ).alias("w"),
    )
    rest = ", ".join(f"w[i + {k}]" for k in range(1, WINDOW))
    windows = base.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr(f"CASE WHEN size(w) > {WINDOW} THEN transform(slice(w, 1, size(w) - {WINDOW - 1}), (x, i) -> xxhash64(x, {rest})) END").alias("g"),
    )
    # Only texts with a window twice pay for sorting: equal windows then stand side by side.
    ordered = windows.withColumn(
        "o", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN array_sort(transform(g, (x, i) -> named_struct('g', x, 'i', i))) END")
    )
    twice = ordered.withColumn(
        "d",
        F.expr("array_sort(transform(filter(o, (x, j) -> (x.g <=> get(o, j - 1).g) OR (x.g <=> get(o, j + 1).g)), x -> x.i))"),
    )
    covered = F.expr(f"aggregate(transform(d, (x, k) -> least({WINDOW}, coalesce(get(d, k + 1) - x, {WINDOW}))), 0L, (s, x) -> s + x)")
    kept = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    return twice.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def judged(counted: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``failed``, which holds the softer rules too."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (
        100 * F.col("n_dup_lines") > MOST_DUPLICATE_LINES * F.col("n_lines")
    )
    return counted.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | soft)


def host_verdicts(documents: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """(host, docs, failures, rate, host_ok) from rows of (host, failed).

    With ``p`` a host's rate and ``m`` their mean, the variance of ``p`` beyond what
    binomial sampling gives sets the prior's strength.  A host is rejected when its
    posterior mean less ``z`` standard deviations is above ``limit``.
    """
    hosts = documents.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    p = F.col("failures") / F.col("docs")
    moments = hosts.agg(
        (F.sum("failures") / F.sum("docs")).alias("m"),
        F.coalesce(F.var_pop(p), F.lit(0.0)).alias("v"),
        F.avg(1 / F.col("docs")).alias("inverse"),
    )
    m = F.col("m")
    noise = m * (1 - m) * F.col("inverse")
    between = F.greatest(F.col("v") - noise, F.lit(1e-6))
    found = moments.select(m, F.greatest(F.lit(2.0), F.least(F.lit(1e4), m * (1 - m) / between - 1)).alias("strength")).first()
    m, strength = F.lit(found.m or 0.0), F.lit(found.strength or 2.0)
    a = F.col("failures") + m * strength
    n = F.col("docs") + strength
    rate = a / n
    bound = rate - z * F.sqrt(rate * (1 - rate) / (n + 1))
    return hosts.select("host", "docs", "failures", rate.alias("rate"), (bound <= limit).alias("host_ok"))


def filtered(docs: DataFrame, host: str = "source") -> DataFrame:
    """Every document with its counts, whether it failed by itself, and whether it is kept."""
    work = Workspace(docs.sparkSession, "hostrules")
    documents = work.table(judged(counts(docs, host)), "documents")
    verdicts = work.table(host_verdicts(documents), "hosts")
    verdicts = verdicts.select(F.col("host").alias("own"), "rate", "host_ok")
    if small_enough(verdicts, MOST_HOSTS):
        verdicts = F.broadcast(verdicts)
    joined = documents.join(verdicts, F.col("host").eqNullSafe(F.col("own")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("host_ok")).alias("kept"),
    )
