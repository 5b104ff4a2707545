"""URL rules, and host reputation where no rule fits.

All of it is built-in expressions.  Labelled outcomes of pages are summed by host, by
registered domain and by suffix.  A suffix is the last label, or the last two where these are
under ``TWO_LEVEL``; a domain has one label more; a port is no part of either, and an address is a
domain of its own.  Each level's rate is
shrunk towards the level above it by a beta-binomial prior, whose strength comes from how
far the level's groups differ beyond binomial noise: suffixes towards all pages, domains
towards their suffix, hosts towards their domain.  A host is blocked when its posterior
mean less ``z`` standard deviations is above the limit; a host without outcomes takes its
domain's.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule
and counts as a host of its own; several outcomes of one page are one, bad if any is;
repeated pages each get their verdict; empty tables give an empty result or, for labels,
verdicts from rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, small_enough

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Second labels that registries hand names out below, by their top-level domain.
TWO_LEVEL = """
uk: ac co gov ltd me net nhs org plc sch
au: com edu gov id net org
nz: ac co geek gen govt iwi net org school
jp: ac ad co ed go gr lg ne or
kr: ac co go ne or pe re
in: ac co edu firm gen gov ind net org res
cn: ac com edu gov net org
tw: com edu gov idv net org
hk: com edu gov idv net org
br: art blog com edu gov net org
ar: com edu gob gov net org
mx: com edu gob net org
tr: com edu gen gov net org web
za: ac co gov net org web
il: ac co gov muni net org
id: ac co go net or sch web
th: ac co go in net or
my: com edu gov net org
sg: com edu gov net org per
ua: com edu gov in net org
pl: com edu gov net org
es: com edu gob nom org
pt: com edu gov org
"""
LIMIT, Z = 0.5, 1.645
MOST_HOSTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``."""
    at = F.instr(F.col("url"), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    cut = pages.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumn("authority", F.regexp_extract("rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, char_length(authority) + 1)"), "^[^?#]*", 0)
    return cut.withColumn("host", F.translate("authority", UPPER, LOWER)).withColumn("path", path).drop("rest", "authority")


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$"


def two_level() -> list[str]:
    rows = [line.split(": ") for line in TWO_LEVEL.strip().splitlines()]
    return [f"{second}.{top}" for top, seconds in rows for second in seconds.split()]


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; addresses share a suffix that no name has."""
    name = F.regexp_replace(host, r":\d*$", "")
    last = lambda n: F.substring_index(name, ".", -n)
    address, two = name.rlike(ADDRESS), last(2).isin(two_level())
    return F.when(address, name).when(two, last(3)).otherwise(last(2)), F.when(address, "[]").when(two, last(2)).otherwise(last(1))


def _strength(groups: DataFrame, rate: str) -> float:
    """The prior's strength, from groups of (n, bad) around the rate of the level above."""
    m = F.col(rate)
    p = F.col("bad") / F.col("n")
    excess = F.avg((p - m) * (p - m) - m * (1 - m) / F.col("n"))
    k = F.avg(m * (1 - m)) / F.greatest(excess, F.lit(1e-6)) - 1
    return groups.filter("n > 0").agg(F.greatest(F.lit(2.0), F.least(F.lit(1e4), k))).first()[0] or 2.0


def _posterior(groups: DataFrame, prior: str, weight: str, k: float, out: str) -> DataFrame:
    """Adds mean ``out`` and weight ``out_weight``: a beta prior of strength ``k``, but never
    firmer than what is known above."""
    strength = F.least(F.lit(k), F.col(weight))
    n = F.col("n") + strength
    return groups.withColumn(out, (F.col("bad") + strength * F.col(prior)) / n).withColumn(f"{out}_weight", n)


def reputation(outcomes: DataFrame, work: Workspace, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """(host, n, bad, rate, blocked) from rows of (host, bad), where ``bad`` is null for unlabelled pages.

    What a group adds to the level above is taken out of its own prior, so that no outcome
    counts twice.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = work.table(hosts.withColumns({"domain": domain, "suffix": suffix}), "outcomes")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = (total.bad + 1) / (total.n + 2)

    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("overall", F.lit(overall))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    k_suffix = _strength(suffixes, "overall")
    rates = suffixes.select("suffix", ((F.col("bad") + k_suffix * overall) / (F.col("n") + k_suffix)).alias("above"))
    k_domain = _strength(domains.join(rates, "suffix"), "above")
    rates = domains.join(rates, "suffix").select("domain", ((F.col("bad") + k_domain * F.col("above")) / (F.col("n") + k_domain)).alias("above"))
    k_host = _strength(hosts.join(rates, "domain"), "above")

    around = suffixes.select("suffix", F.col("n").alias("all_n"), F.col("bad").alias("all_bad"))
    domains = domains.join(around, "suffix").withColumns(
        {
            "suffix_weight": F.col("all_n") - F.col("n") + k_suffix,
            "suffix_rate": (F.col("all_bad") - F.col("bad") + k_suffix * overall) / (F.col("all_n") - F.col("n") + k_suffix),
        }
    )
    around = domains.select("domain", F.col("n").alias("all_n"), F.col("bad").alias("all_bad"), "suffix_rate", "suffix_weight")
    others = hosts.join(around, "domain").withColumns({"own_n": F.col("n"), "own_bad": F.col("bad")})
    others = others.withColumns({"n": F.col("all_n") - F.col("n"), "bad": F.col("all_bad") - F.col("bad")})
    others = _posterior(others, "suffix_rate", "suffix_weight", k_domain, "domain_rate")
    rated = others.withColumns({"n": F.col("own_n"), "bad": F.col("own_bad")})
    rated = _posterior(rated, "domain_rate", "domain_rate_weight", k_host, "rate")
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("rate_weight") + 1))
    return rated.select("host", "n", "bad", "rate", (bound > limit).alias("blocked"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Every page of ``pages`` (``page_id``, ``url``) with its rule and verdict.

    ``outcomes`` has ``host`` and ``bad``.  Of the hosts only the blocked ones are joined to
    the pages, by broadcast while they are few.
    """
    work = Workspace(pages.sparkSession, "urlrep")
    name, verdict = rule_of(RULES if rules is None else rules)
    parts = with_parts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    hosts = work.table(reputation(outcomes, work), "hosts")
    blocked = hosts.filter("blocked").select(F.col("host").alias("bad_host"))
    if small_enough(blocked, MOST_HOSTS):
        blocked = F.broadcast(blocked)
    joined = parts.join(blocked, F.col("host") == F.col("bad_host"), "left")
    own = F.when(F.col("bad_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) for each page; a page's label is that of the document its path numbers."""
    number = F.regexp_extract("path", r"/(\d{1,18})(?:\D|$)", 1)
    numbered = with_parts(pages.select(F.col("url").cast("string").alias("url"))).select(
        "host", F.when(number != "", number.cast("long")).alias("of_doc")
    )
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return numbered.join(known, numbered.of_doc == known.doc_id, "left").select("host", "bad")
