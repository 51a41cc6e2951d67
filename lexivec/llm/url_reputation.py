"""URL filter: explicit rules first, else an empirical-Bayes host reputation. DataFrame functions only.

The outcome of a page is the label, good or bad, of the document it shows: the one whose number ends the
path of its url. Outcomes are counted per host. A beta-binomial prior passes down three levels: the
suffix is shrunk to the global rate, the registered domain to its suffix, the host to its domain. The
strength of each prior is estimated by moments from the spread between the groups of that level. A host
is blocked when the 5 % quantile of its posterior, a beta distribution, reaches the rate of all labelled
pages: when it is worse than the corpus with 95 % probability.

Defined cases: a null url, or one without ``://``, has empty host and path and the verdict of the
empty host; a page without a document number has no outcome and gets its host's verdict; a null or
repeated label counts once per document (bad if any is bad), a repeated page once per row, a null page_id
like any other; without labels every page without a rule is allowed; a very long url is taken whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import ascii_lower
from lexivec.session import materialise

#: (verdict, host, path), the rules of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Normal deviate of the posterior quantile: 5 % lie below.
Z = 1.645
STRENGTH = (1.0, 1000.0)
#: Hosts that are broadcast at most (about 60 bytes each); more are joined by a shuffle.
BROADCAST_HOSTS = 500_000

# Second-level labels under which two-letter top domains register names.
SECOND_LEVEL = "ac co com edu go gov net ne or org".split()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path by the contract's definition."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = verdict = None
    for what, host, path in ordered:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def shown_document(path: Column) -> Column:
    """Number of the document that a page shows: the last segment of the path, if it is a number."""
    digits = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?\z", 1)
    return F.when(digits != "", digits.cast("long"))


def outcomes(labels: DataFrame) -> DataFrame:
    """(shown, bad): one outcome per labelled document; low quality or toxic is bad."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("shown")).agg(
        F.max(bad.cast("int")).alias("bad")
    )


def registered(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host, its user and port aside; an address is its own."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    address = bare.rlike(r"^[0-9.]+$|:")
    second = bare.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    last = lambda n: F.substring_index(bare, ".", -n)
    return (F.when(address, bare).when(second, last(2)).otherwise(last(1)), F.when(address, bare).when(second, last(3)).otherwise(last(2)))


def beta_low(a: Column, b: Column) -> Column:
    """The lower quantile of Beta(a, b) at ``Z``, by the usual normal approximation for shapes from 1 on.

    A shape a under 1 has its mass at 0, which is taken; a shape b under 1 is taken as 1, which is lower.
    """
    b = F.greatest(b, F.lit(1.0))
    x, y = 1 / (2 * a - 1), 1 / (2 * b - 1)
    h = 2 / (x + y)
    slope = F.lit((Z * Z - 3) / 6)
    w = Z * F.sqrt(h + slope) / h - (y - x) * (slope + 5 / 6 - 2 / (3 * h))
    return F.when((a < 1) | (h + slope <= 0), 0.0).otherwise(a / (a + b * F.exp(2 * w)))


def _strength(table: DataFrame, prior: Column) -> float:
    """Beta-binomial concentration by moments, from (n, bad) of groups around their prior means."""
    n, p = F.col("n"), F.col("bad") / F.col("n")
    row = (
        table.where("n > 0")
        .agg(
            F.sum(n * (p - prior) * (p - prior) / (prior * (1 - prior))).alias("s"),
            F.count("*").alias("k"),
            F.sum(n).alias("total"),
            F.sum(n.cast("double") * n).alias("squares"),
        )
        .first()
    )
    if not row["k"] or row["k"] < 2 or row["s"] is None:
        return STRENGTH[1]
    spare = row["total"] - row["squares"] / row["total"] - (row["k"] - 1)
    rho = (row["s"] - (row["k"] - 1)) / spare if spare > 0 else 0.0
    return STRENGTH[1] if rho <= 0 else min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1])


def _shrunk(table: DataFrame, prior: str, strength: float, name: str) -> DataFrame:
    mean = (F.col(prior) * strength + F.col("bad")) / (F.lit(strength) + F.col("n"))
    return table.withColumn(name, mean)


def host_table(pages: DataFrame, outcome: DataFrame) -> tuple[DataFrame, float]:
    """(host, rate, low), the posterior mean and lower bound of every host's bad rate, and the rate of all.

    ``pages`` has host and shown. What is counted is stored once, a row per host.
    """
    suffix, domain = registered(F.col("host"))
    hosts = pages.join(outcome, "shown", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialise(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("bad")).first()
    if not total[0]:
        return hosts.select("host", F.lit(0.0).alias("rate"), F.lit(0.0).alias("low")), 1.0
    base = (total[1] + 0.5) / (total[0] + 1.0)
    tops = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("m0", F.lit(base))
    tops = _shrunk(tops, "m0", _strength(tops, F.col("m0")), "m1").select("suffix", "m1")
    mids = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(tops, "suffix")
    mids = _shrunk(mids, "m1", _strength(mids, F.col("m1")), "m2").select("domain", "m2")
    leaves = hosts.join(mids, "domain")
    strength = _strength(leaves, F.col("m2"))
    leaves = _shrunk(leaves, "m2", strength, "rate")
    whole = F.lit(strength) + F.col("n")
    low = beta_low(F.col("rate") * whole, (1 - F.col("rate")) * whole)
    return leaves.select("host", "rate", low.alias("low")), base


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate_low: one row per page."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts, base = host_table(parts.select("host", shown_document(F.col("path")).alias("shown")), outcomes(labels))
    hosts = materialise(hosts, "reputations")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    rule, verdict = rule_columns(rules)
    own_verdict = F.when(F.col("low") >= base, "block").otherwise("allow")
    return (
        parts.withColumns({"rule": rule, "__lx_said": verdict})
        .join(hosts, "host", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("__lx_said", own_verdict).alias("verdict"),
            F.round("low", 6).alias("bad_rate_low"),
        )
    )
