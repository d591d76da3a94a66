"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. Each
level is a beta-binomial whose prior mean is its parent's posterior mean and whose
concentration comes from the spread between siblings (method of moments), so a
host with few labels leans on its domain, and that on its suffix. A host is
blocked if the lower posterior bound of its bad rate is above a limit.

Domain and suffix are taken from the host without user and port; an address, or a
host of one label, is a domain of its own.

Defined results: a null url, or one without ``://``, has empty host and path and
the verdict of the empty host; outcomes that are null are ignored; no labels at
all give every host the verdict allow; repeated pages give repeated rows, and a page
id that stands more than once counts once for each of its hosts; of rules of equal
length the first in alphabetical order counts; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, ascii_lower

NAME = "op1_url_reputation"

#: (verdict, rule) in the contract's order.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Suffixes of more than one label that are known without a table of them; any other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.kr", "co.in", "com.cn")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user and port, and without a dot at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"(?<!:):[0-9]*\z", ""), r"\.\z", "")


def is_address(name: Column) -> Column:
    """Whether the name is an IPv4 or IPv6 address, which has no domain above it."""
    return name.rlike(r"(?s)^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)\z")


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The public suffix; of an address the whole name."""
    name = name_of(host)
    last2 = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(last2.isin(*long_suffixes), last2).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The suffix and the label before it; an address or a single label is its own."""
    name = name_of(host)
    last2 = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(last2.isin(*long_suffixes), F.substring_index(name, ".", -3)).otherwise(last2)


#: Suffixes that a table may have to become a literal list; a public suffix list has some ten thousand.
MOST_SUFFIXES = 20_000


def listed(suffixes: DataFrame | None) -> tuple[str, ...]:
    """The suffixes with a dot of a table suffix(suffix), of checked size; the default ones without a table."""
    if suffixes is None:
        return LONG_SUFFIXES
    found = [r[0] for r in suffixes.filter("contains(suffix, '.')").select("suffix").distinct().limit(MOST_SUFFIXES + 1).collect()]
    if len(found) > MOST_SUFFIXES:
        raise ValueError(f"more than {MOST_SUFFIXES} suffixes")
    return tuple(sorted(found))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else of nulls.

    A rule is host and path prefix; it fits its host and all subdomains. The rules
    are a short literal list and become one CASE, longest first.
    """
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    nothing = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return nothing if chain is None else chain.otherwise(nothing)


def _concentration(children: DataFrame) -> float:
    """kappa, from the spread of children (n, bad) about their parents' rate m.

    With within-group correlation rho, the expected sum of n (p - m)^2 is the sum
    of m (1 - m) (1 + (n - 1) rho); kappa is 1 / rho - 1, with rho held inside
    [0.001, 0.5]. Two sums come to the driver.
    """
    v = F.col("m") * (1 - F.col("m"))
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)
    top, bottom = children.filter("n > 0").agg(F.sum(spread - v), F.sum((F.col("n") - 1) * v)).first()
    rho = top / bottom if top is not None and bottom else 0.001
    return 1 / min(max(rho, 0.001), 0.5) - 1


def host_reputation(hosts: DataFrame, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """hosts(host, n, bad) with one row per host, n = 0 allowed, to posterior alpha and beta.

    Adds domain, suffix, a and b: the host's bad rate is Beta(a, b). hosts is read
    once for each level, so it should be a saved table.
    """
    h = hosts.select("host", "n", "bad", domain_of(F.col("host"), long_suffixes).alias("domain"), suffix_of(F.col("host"), long_suffixes).alias("suffix"))
    domains = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()

    def shrunk(level: DataFrame) -> Column:
        """The posterior mean with prior mean m."""
        kappa = _concentration(level)
        return (F.col("bad") + kappa * F.col("m")) / (F.col("n") + kappa)

    s = suffixes.withColumn("m", F.lit(((bad or 0) + 1) / ((n or 0) + 2)))
    s = s.select("suffix", shrunk(s).alias("m"))
    d = domains.join(s, "suffix")
    d = d.select("domain", "suffix", shrunk(d).alias("m"))
    children = h.join(d, ["domain", "suffix"])
    kappa = _concentration(children)
    return children.select(
        "host", "domain", "suffix", "n", "bad",
        (F.col("bad") + kappa * F.col("m")).alias("a"), (F.col("n") - F.col("bad") + kappa * (1 - F.col("m"))).alias("b"),
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, z: float = 1.645, limit: float = 0.5, suffixes: DataFrame | None = None) -> DataFrame:
    """Every page with host, path, rule and verdict.

    outcomes(page_id, bad): bad is 1, 0 or null. The method blocks a host if mean
    minus z standard deviations of its posterior is above limit. suffixes(suffix), a
    public suffix list, replaces the default ones.
    """
    p = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    o = outcomes.select(F.col(page_id).alias("page_id"), F.col("bad").cast("long").alias("bad")).filter("bad IS NOT NULL AND page_id IS NOT NULL")
    o = o.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    per_page = p.select("page_id", "host").distinct().join(o, "page_id", "left")
    hosts = per_page.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rep = host_reputation(Scratch(pages.sparkSession, "urls").save(hosts, "hosts"), listed(suffixes))  # read once for each level
    mean = F.col("a") / (F.col("a") + F.col("b"))
    low = mean - z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    judged = rep.select("host", F.col("n").alias("host_labels"), F.col("bad").alias("host_bad"), F.when(low > limit, F.lit("block")).otherwise(F.lit("allow")).alias("reputation"))
    hit = match_rule(F.col("host"), F.col("path"), rules)
    return (
        p.join(judged, "host")
        .withColumn("_hit", hit)
        .select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce(F.col("_hit.verdict"), F.col("reputation")).alias("verdict"), "host_labels", "host_bad", "reputation")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; a page's outcome is the label of the same number: bad if toxic or of low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.greatest(F.col("toxic"), 1 - F.col("quality")).alias("bad"))
    return judge_urls(pages, outcomes)


ORACLE = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(greatest(toxic, 1 - quality)) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND greatest(toxic, 1 - quality) IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad
       FROM (SELECT DISTINCT page_id, host FROM p) q LEFT JOIN o USING (page_id) GROUP BY host),
g AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), '(^|[^:]):[0-9]*$', '\1'), '\.$', '') AS name FROM h0),
h1 AS (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)$', 's') AS address FROM g),
h AS (SELECT host, n, bad,
        CASE WHEN address THEN name WHEN array_to_string(parts[-2:], '.') IN ('co.uk','org.uk','ac.uk','com.au','com.br','co.jp','co.kr','co.in','com.cn')
             THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
        CASE WHEN address THEN name WHEN array_to_string(parts[-2:], '.') IN ('co.uk','org.uk','ac.uk','com.au','com.br','co.jp','co.kr','co.in','com.cn')
             THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM h1),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY ALL),
t AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE AS m FROM s0),
s1 AS (SELECT s0.*, m FROM s0, t),
ks AS (SELECT 1 / least(greatest(coalesce(sum(n * (bad / n::DOUBLE - m) ** 2 - m * (1 - m)) / nullif(sum((n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.5) - 1 AS kappa FROM s1 WHERE n > 0),
s2 AS (SELECT suffix, (bad + kappa * m) / (n + kappa) AS m FROM s1, ks),
d1 AS (SELECT d0.*, m FROM d0 JOIN s2 USING (suffix)),
kd AS (SELECT 1 / least(greatest(coalesce(sum(n * (bad / n::DOUBLE - m) ** 2 - m * (1 - m)) / nullif(sum((n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.5) - 1 AS kappa FROM d1 WHERE n > 0),
d2 AS (SELECT domain, suffix, (bad + kappa * m) / (n + kappa) AS m FROM d1, kd),
h2 AS (SELECT h.*, m FROM h JOIN d2 USING (domain, suffix)),
kh AS (SELECT 1 / least(greatest(coalesce(sum(n * (bad / n::DOUBLE - m) ** 2 - m * (1 - m)) / nullif(sum((n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.5) - 1 AS kappa FROM h2 WHERE n > 0),
r AS (SELECT host, n, bad, bad + kappa * m AS a, n - bad + kappa * (1 - m) AS b FROM h2, kh),
v AS (SELECT host, n, bad, CASE WHEN a / (a + b) - 1.645 * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS reputation FROM r),
j AS (SELECT page_id, host, path, reputation, v.n AS host_labels, v.bad AS host_bad,
        CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
             WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
             WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
      FROM p JOIN v USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE reputation END AS verdict,
       CAST(host_labels AS BIGINT) AS host_labels, CAST(host_bad AS BIGINT) AS host_bad, reputation FROM j
"""
