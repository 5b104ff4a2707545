"""Secret scans: fixed patterns, and character Markov models for what the patterns miss.

All of it is built-in expressions.  Two first-order character models, one of random strings
and one of ordinary identifiers, are counted from labelled samples; a long token is a secret
when the log-likelihood ratio of the two exceeds a margin.  The table of log ratios is a
literal in the plan, its size fixed by the alphabet, so that a scan is one pass without a
shuffle, and a row needs nothing but itself.

Labelled samples: what the patterns match counts as random, ordinary words after ``password=``
included, other long tokens as ordinary.
Transitions are counted over all documents, and no more rows than two alphabets squared come of it.

Defined results: a null text has no spans; repeated rows each get theirs; without any
labelled random string the models add nothing; an empty table gives an empty result; other
columns are ignored; time grows with a text's length and, by a power of 1.5, with its spans.
Positions count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = rf"(?i:{KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the whole run, which is 20 characters or more
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
LEAST_VALUE = 6
FEW = 32  # spans that are cut out of a text one by one
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
MARGIN = 6.0

SPAN = "struct<s:int,k:int,e:int,v:string>"
NO_SPANS = f"CAST(array() AS array<{SPAN}>)"


def folded(items: str, state: dict[str, str], step: dict[str, str], last: str = "a.out") -> str:
    """SQL of a fold over the array ``items``, whose ``state`` has a growing array ``out``.

    ``step`` has each field after item ``x`` from the state ``b`` before it.  Appending to one
    long array would copy it for each item; this appends to a short one for each block of items
    instead, some square root of all, and adds whole blocks.
    """
    width = f"greatest(1, CAST(sqrt(size({items})) AS int))"
    blocks = f"transform(sequence(0, CAST(ceil(size({items}) / {width}) AS int)), i -> slice({items}, i * {width} + 1, {width}))"
    struct = lambda fields: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    block_state = struct({k: NO_SPANS if k == "out" else f"a.{k}" for k in state})
    joined = struct({k: "concat(a.out, b.out)" if k == "out" else f"b.{k}" for k in state})
    return f"aggregate({blocks}, {struct(state)}, (a, block) -> aggregate(block, {block_state}, (b, x) -> {struct(step)}, b -> {joined}), a -> {last})"


def _found(docs: DataFrame, name: str, pattern: str, group: int, kind: int, quick: Column) -> DataFrame:
    """Adds the spans of one pattern; texts without a match skip all but the first look."""
    text = F.col("text")
    has = quick & text.rlike(pattern)
    docs = docs.withColumn("gaps", F.when(has, F.split(text, pattern, -1)))
    docs = docs.withColumn("matches", F.when(F.col("gaps").isNotNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    if group:
        docs = docs.withColumn("values", F.when(F.col("gaps").isNotNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))
    values = F.col("values") if group else F.col("matches")
    docs = docs.select(*[c for c in docs.columns if c not in ("gaps", "matches", "values")], F.struct(
        F.slice("gaps", 1, F.greatest(F.size("matches"), F.lit(0))).alias("g"), F.col("matches").alias("m"), values.alias("v")).alias("raw"))
    zipped = F.arrays_zip("raw.g", "raw.m", "raw.v")
    start = "b.at + char_length(x.g)"
    end = f"{start} + char_length(x.m)"
    span = f"named_struct('s', {start}, 'k', {kind}, 'e', {end}, 'v', x.v)"
    spans = F.expr(folded("zipped", {"at": "0", "out": NO_SPANS}, {"at": end, "out": f"array_append(b.out, {span})"}))
    docs = docs.withColumn("zipped", zipped)
    docs = docs.withColumn(name, F.when(F.size("zipped") > 0, spans).otherwise(F.expr(NO_SPANS)))
    return docs.drop("raw", "zipped")


def scanned(docs: DataFrame) -> DataFrame:
    """Adds ``base``, the spans of the patterns, and ``tokens``, long tokens that touch none of them."""
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    always = F.lit(True)
    docs = _found(docs, "assign", ASSIGN, 1, 0, always)
    docs = _found(docs, "access", ACCESS, 0, 1, F.contains(F.col("text"), F.lit("AKIA")))
    docs = _found(docs, "hex", HEX, 0, 2, always)
    docs = _found(docs, "long", TOKEN, 0, 3, always)
    assign = F.filter("assign", lambda x: F.char_length(x.v) >= LEAST_VALUE)
    docs = docs.withColumn("base", F.concat(assign, F.col("access"), F.col("hex"))).drop("assign", "access", "hex")
    both = F.array_sort(F.concat("base", "long"))
    docs = docs.withColumn("both", F.when((F.size("base") > 0) & (F.size("long") > 0), both))
    # In order of their starts: a token waits until the next span shows whether a base span cuts into it.
    waits = f"CASE WHEN b.wait IS NULL OR (x.k < 3 AND x.s < b.wait.e) THEN b.out ELSE array_append(b.out, b.wait) END"
    none = f"CAST(NULL AS {SPAN})"
    free = folded(
        "both",
        {"upto": "0", "wait": none, "out": NO_SPANS},
        {"upto": "CASE WHEN x.k < 3 THEN greatest(b.upto, x.e) ELSE b.upto END", "wait": f"CASE WHEN x.k < 3 OR b.upto > x.s THEN {none} ELSE x END", "out": waits},
        "CASE WHEN a.wait IS NULL THEN a.out ELSE array_append(a.out, a.wait) END",
    )
    return docs.withColumn("tokens", F.when(F.col("both").isNull(), F.col("long")).otherwise(F.expr(free))).drop("long", "both")


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, is_random) from all documents."""
    some = scanned(docs.select("text"))
    labelled = lambda spans, random: F.transform(spans, lambda x: F.struct(x.v.alias("token"), F.lit(random).alias("is_random")))
    return some.select(F.explode(F.concat(labelled("base", True), labelled("tokens", False))).alias("s")).select("s.*")


def train(samples: DataFrame) -> str | None:
    """Log ratios of transition probabilities, comma-joined, row by row of the alphabet; None without random samples."""
    letters = samples.select("is_random", F.split("token", "").alias("letters"))
    pairs = letters.select("is_random", F.explode(F.expr("zip_with(letters, slice(letters, 2, size(letters)), (a, b) -> concat(a, b))")).alias("pair"))
    pairs = pairs.filter(F.char_length("pair") == 2)
    n, counts = len(ALPHABET), {True: {}, False: {}}
    for random, pair, k in pairs.groupBy("is_random", "pair").count().collect():  # no more rows than two alphabets squared
        counts[random][pair] = k
    if not counts[True]:
        return None
    table = []
    for a in ALPHABET:
        totals = {r: sum(counts[r].get(a + b, 0) for b in ALPHABET) for r in counts}
        for b in ALPHABET:
            p, q = ((counts[r].get(a + b, 0) + 0.5) / (totals[r] + 0.5 * n) for r in (True, False))
            table.append(f"{math.log(p / q):.4f}")
    return ",".join(table)


def with_secrets(docs: DataFrame, table: str | None, margin: float = MARGIN) -> DataFrame:
    """Adds ``base`` and ``spans``, the latter with what the models add; both by start, then kind.

    ``docs`` has ``text`` and columns that pass through; names like those added here are the caller's to avoid.
    """
    docs = scanned(docs)
    if table is None:
        added = F.expr(NO_SPANS)
    else:
        n = len(ALPHABET)
        place = f"instr('{ALPHABET}', c)"
        score = (
            "aggregate(split(x.v, ''), named_struct('p', 0, 't', 0D), (a, c) -> named_struct("
            f"'p', {place}, 't', a.t + coalesce(CASE WHEN a.p > 0 AND {place} > 0 THEN get(ratios, (a.p - 1) * {n} + {place} - 1) END, 0D)), a -> a.t)"
        )
        docs = docs.withColumn("ratios", F.split(F.lit(table), ",").cast("array<double>"))
        added = F.expr(f"filter(tokens, x -> {score} > {margin}D)")
    docs = docs.withColumn("added", added)
    base = F.array_sort("base")
    return docs.withColumn("spans", F.array_sort(F.concat("base", "added"))).withColumn("base", base).drop("added", "tokens", "ratios")


def joined(spans: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def redacted(docs: DataFrame, table: str | None, mask: str = "[SECRET]", margin: float = MARGIN) -> DataFrame:
    """The documents with every span of a secret masked, and ``n_chars`` of the new text."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")  # own columns keep out of the way of ours
    found = with_secrets(whole, table, margin)
    # Spans cut to what no span before them covers, then the text between them, by letters: linear in text and spans.
    cut = "CASE WHEN x.e > b.at THEN array_append(b.out, named_struct('s', greatest(x.s, b.at), 'k', x.k, 'e', x.e, 'v', '')) ELSE b.out END"
    found = found.withColumn("cut", F.expr(folded("spans", {"at": "0", "out": NO_SPANS}, {"at": "greatest(b.at, x.e)", "out": cut})))
    found = found.withColumn("letters", F.when(F.size("cut") > FEW, F.split("text", "")))
    start, end = "CASE WHEN i = 0 THEN 0 ELSE get(cut, i - 1).e END", "coalesce(get(cut, i).s, char_length(text))"
    part = "CASE WHEN letters IS NULL THEN substring(text, {0} + 1, {1} - {0}) ELSE array_join(slice(letters, {0} + 1, {1} - {0}), '') END".format(f"({start})", f"({end})")
    masked = F.array_join(F.expr(f"transform(sequence(0, size(cut)), i -> {part})"), mask)
    found = found.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
