"""URL filters: prefix rules first, then empirical-Bayes host reputation.

Only DataFrame functions. Labelled page outcomes are counted per host; a beta-binomial model shrinks
each host towards its registered domain, the domain towards its suffix, the suffix towards the whole. The prior
strength of each level is the moment estimate of the variation between its groups. A page is blocked if
the lower posterior bound of its host's bad share lies above `threshold`, or its odds above `odds` times those of all pages.

Every count is aggregated before it is shuffled, so a host with a third of all pages costs one row a
task. Defined results: null url or one without `://` has an empty host and path, no rule, and takes the
verdict of the empty host; repeated rows are judged alike; an empty table gives an empty table; columns of `pages` other
than page_id and url are ignored, whatever their names. Pages without a known outcome have null there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm.common import materialise, table

#: Fixed values of the query's contract: (host and path prefix, verdict).
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
Z, THRESHOLD, ODDS = 1.0, 0.5, 3.0
#: Suffixes of two labels: these before a country's two letters. Addresses have no domain.
_SECOND = "(?:co|com|org|net|ac|gov|edu|ne|or|go)"
DOMAIN = (rf"([^.]+\.{_SECOND}\.[a-z][a-z])\z", r"([^.]+\.[^.]+)\z")
SUFFIX = (rf"[^.]+\.({_SECOND}\.[a-z][a-z])\z", r"([^.]*)\z")
ADDRESS = r"\A(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])\z"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bounds of the within-group correlation, so that a prior always counts for something.
RHO = (0.001, 0.9)


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, ASCII lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, A_TO_Z, A_TO_Z.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        which, verdict = F.when(fits, F.lit(text)).otherwise(which), F.when(fits, F.lit(says)).otherwise(verdict)
    return which, verdict


def name_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"\A[^@]*@", ""), r":[0-9]*\z", "")


def domain_of(name: Column) -> Column:
    """The registered domain: a label and the suffix behind it; the whole name if it has no more than that, or is an address."""
    parts = [F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")) for pattern in DOMAIN]
    return F.when(name.rlike(ADDRESS), name).otherwise(F.coalesce(*parts, name))


def suffix_of(name: Column) -> Column:
    """The last label, or the last two where a country's suffix has two; addresses share one suffix."""
    return F.when(name.rlike(ADDRESS), F.lit("address")).otherwise(F.coalesce(F.nullif(F.regexp_extract(name, SUFFIX[0], 1), F.lit("")), F.regexp_extract(name, SUFFIX[1], 1)))


def prior_strength(groups: DataFrame) -> float:
    """The prior's weight in pages, from how much the bad shares of the groups differ (moments)."""
    n, b, n2, q, k = groups.filter("n > 0").agg(F.sum("n"), F.sum("bad"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("bad") * F.col("bad") / F.col("n")), F.count(F.lit(1))).first()
    rho = RHO[0]
    if k > 1 and 0 < b < n and (spread := n - n2 / n - (k - 1)) > 0:
        p = b / n
        rho = (q - n * p * p - p * (1 - p) * (k - 1)) / (p * (1 - p) * spread)
    return 1 / min(RHO[1], max(RHO[0], rho)) - 1


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z, threshold: float = THRESHOLD, odds: float = ODDS) -> DataFrame:
    """host -> (bad_mean, bad_lower, blocked) for every host of pages(page_id, host).

    `outcomes` has page_id and bad (0 or 1), one row per labelled page. The tables of hosts and of domains are stored; only sums over them go to the driver.
    """
    known = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    # Pages without an outcome only name their host.
    counts = pages.join(known, "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("bad"))
    every = pages.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")).distinct()
    summed = counts.unionByName(every).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    name = name_of(F.col("host"))
    hosts = materialise(summed.withColumns({"domain": domain_of(name), "suffix": suffix_of(name)}))
    domains = materialise(hosts.groupBy("domain").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ks, kd, kh = (prior_strength(x) for x in (suffixes, domains, hosts))
    n, bad = domains.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    m0 = (bad + 1.0) / (n + 2.0)
    of_suffix = suffixes.select("suffix", ((F.col("bad") + ks * m0) / (F.col("n") + ks)).alias("ms"))
    of_domain = domains.join(of_suffix, "suffix").select("domain", ((F.col("bad") + kd * F.col("ms")) / (F.col("n") + kd)).alias("md"))
    a, b = F.col("bad") + kh * F.col("md"), F.col("n") - F.col("bad") + kh * (1 - F.col("md"))
    mean = a / (a + b)
    lower = mean - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    bar = min(threshold, odds * m0 / (1 - m0 + odds * m0))
    return materialise(hosts.join(of_domain, "domain").select("host", mean.alias("bad_mean"), lower.alias("bad_lower"), (lower > F.lit(bar)).alias("blocked")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, z: float = Z, threshold: float = THRESHOLD, odds: float = ODDS) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior for every row of pages(page_id, url)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    which, says = rule_of(F.col("host"), F.col("path"), rules)
    scored = split.join(reputation(split.select("page_id", "host"), outcomes, z, threshold, odds), "host", "left")
    verdict = F.coalesce(says, F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", which.alias("rule"), verdict.alias("verdict"), F.round("bad_mean", 6).alias("bad_mean"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: the number at the end of a page's path names the document that the page shows, and so its quality label."""
    number = F.try_to_number(F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})(?:\.html|/)?\z", 1), F.lit("9" * 18)).cast("long")
    named = pages.select("page_id", number.alias("doc_id")).filter("doc_id is not null")
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    return named.join(marks, "doc_id").select("page_id", "bad")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_outcomes(pages, table(spark, sf_dir, "labels")))


def _duck_strength(level: str, name: str) -> str:
    return f"""{name} AS (
  SELECT 1.0 / greatest({RHO[0]}, least({RHO[1]}, CASE WHEN k > 1 AND sp > 0 AND p > 0 AND p < 1 THEN (q - n * p * p - p * (1 - p) * (k - 1)) / (p * (1 - p) * sp) ELSE {RHO[0]} END)) - 1 AS v
  FROM (SELECT *, n - n2 / n - (k - 1) AS sp, b / n AS p FROM (
    SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS b, sum(n * n)::DOUBLE AS n2, sum(bad * bad / n::DOUBLE) AS q, count(*)::DOUBLE AS k FROM {level} WHERE n > 0)))"""


def _duck_rules() -> str:
    def fits(text: str) -> str:
        at, _, rest = text.partition("/")
        return f"((host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}'))"

    longest = sorted(RULES, key=lambda r: -len(r[0]))
    return "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for t, _ in longest) + " END AS rule, CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for t, v in longest) + " END AS says"


ORACLE = f"""
WITH s AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{A_TO_Z}', '{A_TO_Z.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
named AS (SELECT page_id, try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})(?:\\.html|/)?\\z', 1), '') AS BIGINT) AS doc_id FROM s),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
known AS (SELECT page_id, max(bad) AS bad FROM named JOIN marks USING (doc_id) GROUP BY 1),
named_hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad, regexp_replace(regexp_replace(host, '\\A[^@]*@', ''), ':[0-9]*\\z', '') AS name FROM s LEFT JOIN known USING (page_id) GROUP BY 1),
hosts AS (SELECT host, n, bad,
  CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name ELSE coalesce(nullif(regexp_extract(name, '{DOMAIN[0]}', 1), ''), nullif(regexp_extract(name, '{DOMAIN[1]}', 1), ''), name) END AS domain,
  CASE WHEN regexp_matches(name, '{ADDRESS}') THEN 'address' ELSE coalesce(nullif(regexp_extract(name, '{SUFFIX[0]}', 1), ''), regexp_extract(name, '{SUFFIX[1]}', 1)) END AS suffix FROM named_hosts),
domains AS (SELECT domain, min(suffix) AS suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY 1),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY 1),
{_duck_strength("suffixes", "ks")}, {_duck_strength("domains", "kd")}, {_duck_strength("hosts", "kh")},
m0 AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS v FROM suffixes),
ms AS (SELECT suffix, (bad + ks.v * m0.v) / (n + ks.v) AS v FROM suffixes, ks, m0),
md AS (SELECT domain, (bad + kd.v * ms.v) / (n + kd.v) AS v FROM domains JOIN ms USING (suffix), kd),
post AS (SELECT host, bad + kh.v * md.v AS a, n - bad + kh.v * (1 - md.v) AS b FROM hosts JOIN md USING (domain), kh)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > (SELECT least({THRESHOLD}, {ODDS} * v / (1 - v + {ODDS} * v)) FROM m0) THEN 'block' ELSE 'allow' END) AS verdict,
  round(a / (a + b), 6) AS bad_mean
FROM (SELECT *, {_duck_rules()} FROM s) JOIN post USING (host)
"""
