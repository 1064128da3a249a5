"""URL filter by rules and, where no rule fits, by the reputation of the host.

Every page is an outcome of its host: bad if a block rule judges it, else good. The rate of bad pages is shrunk step by step: a suffix towards all
pages, a registered domain towards its suffix, a host towards its domain. At each step the posterior
of the wider group is the prior: its mean, and as spread its own uncertainty together with how far the groups
of that step differ from their parents, which is fitted. A host is blocked when even the lower bound of its posterior is above the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, UPPER, lookup
from factloom.session import cut_lineage

BLOCK_ABOVE = 0.2        # bad rate that the lower bound must exceed: surely more than one page in five
DEVIATIONS = 1.64        # of the posterior below its mean: a one-sided bound of about 95 %
STRENGTHS = (1.0, 500.0)     # least and largest strength that is fitted, in pages

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.kr",
    "com.br", "com.cn", "com.mx", "com.tr", "com.ar", "com.sg", "com.tw", "com.hk",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none fits. Equally long rules: the longer host."""
    fit = None
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        got = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        fit = F.when(fits, got) if fit is None else fit.when(fits, got)
    return fit if fit is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where names are registered below both."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    deep = F.size(F.split(suffix, r"\.")) > 1
    return F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def reputation(outcomes: DataFrame) -> DataFrame:
    """`host, rate, low`: posterior mean and lower bound of the bad rate of every host.

    `outcomes` has `host`, `n` (pages with a known outcome, maybe 0) and `bad`, one row per host. A group without known pages takes its
    parent's rate and is less sure of it than the parent is.
    """
    hosts = cut_lineage(outcomes.withColumn("suffix", suffix_of(F.col("host")))
                        .withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    a, b = (total.bad or 0) + 1.0, (total.n or 0) - (total.bad or 0) + 1.0
    level, parent = None, None
    for name in ("suffix", "domain", "host"):
        keys = {"suffix": ["suffix"], "domain": ["domain", "suffix"], "host": ["host", "domain"]}[name]
        own = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if level is None:
            prior = own.withColumn("prior", F.lit(a / (a + b))).withColumn("var", F.lit(a * b / ((a + b) * (a + b) * (a + b + 1))))
        else:
            above = level.select(F.col(parent).alias("_above"), F.col("rate").alias("prior"), (F.col("sd") * F.col("sd")).alias("var"))
            prior = lookup(own.withColumn("_above", F.col(parent)), above, ["_above"], name).drop("_above")
        prior = cut_lineage(prior)
        single = F.col("prior") * (1 - F.col("prior"))
        spread = F.col("var") + single / (_strength(prior) + 1)       # what the parent doesn't know, and what its groups differ by
        k = single / spread - 1
        up, down = F.col("prior") * k + F.col("bad"), (1 - F.col("prior")) * k + F.col("n") - F.col("bad")
        shrunk = prior.select(*keys, up.alias("a"), down.alias("b"))
        level = cut_lineage(shrunk.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), F.sqrt(
            F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1))).alias("sd")))
        parent = name
    return level.select("host", "rate", (F.col("rate") - DEVIATIONS * F.col("sd")).alias("low"))


def _strength(groups: DataFrame) -> float:
    """The beta prior's strength by moments: how much less the groups differ from their priors than single pages would."""
    p = F.col("prior")
    got = groups.filter("n > 0").agg(
        F.sum((F.col("bad") - F.col("n") * p) * (F.col("bad") - F.col("n") * p) / F.col("n")).alias("q"),
        F.sum(p * (1 - p)).alias("v"), F.sum(p * (1 - p) * (F.col("n") - 1)).alias("w")).first()
    if not got.w:
        return STRENGTHS[0]
    rho = ((got.q or 0.0) - got.v) / got.w          # correlation of the pages of a group
    return STRENGTHS[1] if rho <= 0 else min(max(1 / rho - 1, STRENGTHS[0]), STRENGTHS[1])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`id, host, path, rule, verdict, rate` for every row.

    The verdict is that of the longest fitting rule, else block if the lower bound of the host's bad rate is above BLOCK_ABOVE, else allow. Pages that
    a block rule judges are the bad ones. A null url or one without :// has an empty host and path and is a host like any other. Rows
    are judged one by one; null ids and repeated rows stay. With no pages there are no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    outcomes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("by.verdict") == "block", 1)).alias("bad"))
    hosts = reputation(outcomes)
    judged = lookup(rows.withColumn("spread", F.struct("id", "path")), hosts, ["host"], "spread")
    own = F.when(F.col("low") > BLOCK_ABOVE, "block").otherwise("allow")
    return judged.select("id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", own).alias("verdict"), "rate")


def _level_sql(name: str, keys: str, above: str | None) -> str:
    """The SQL of one step: group, take the parent's rate and variance as prior, fit the strength, shrink."""
    prior = "(SELECT overall FROM total) AS prior, (SELECT var FROM total) AS var" if above is None else "u.rate AS prior, u.sd * u.sd AS var"
    join = "" if above is None else f" JOIN {above}_rate u ON u.{above} = g.{above}"
    return f"""
{name}_own AS (SELECT {keys}, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
{name}_prior AS (SELECT g.*, {prior} FROM {name}_own g{join}),
{name}_m AS (SELECT sum((bad - n * prior) * (bad - n * prior) / n) AS q, sum(prior * (1 - prior)) AS v,
  sum(prior * (1 - prior) * (n - 1)) AS w FROM {name}_prior WHERE n > 0),
{name}_k AS (SELECT CASE WHEN w IS NULL OR w = 0 THEN 1.0 WHEN q - v <= 0 THEN 500.0
  ELSE least(greatest(w / (q - v) - 1, 1.0), 500.0) END AS fitted FROM {name}_m),
{name}_s AS (SELECT p.*, prior * (1 - prior) / (var + prior * (1 - prior) / (fitted + 1)) - 1 AS k FROM {name}_prior p, {name}_k),
{name}_rate AS (SELECT *, a / (a + b) AS rate, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd FROM (
  SELECT *, prior * k + bad AS a, (1 - prior) * k + n - bad AS b FROM {name}_s))"""


_SQL_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
parts AS (
  SELECT host, string_split(host, '.') AS l, count(*) AS n, count(*) FILTER (WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/')) AS bad
  FROM r GROUP BY host),
suffixed AS (
  SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({_SQL_TWO}) THEN 2 ELSE 1 END AS deep FROM parts),
hosts AS (
  SELECT host, n, bad, array_to_string(l[-deep:], '.') AS suffix, array_to_string(l[-(deep + 1):], '.') AS domain FROM suffixed),
total AS (
  SELECT a / (a + b) AS overall, a * b / ((a + b) * (a + b) * (a + b + 1)) AS var FROM (
    SELECT coalesce(sum(bad), 0) + 1.0::DOUBLE AS a, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 1.0::DOUBLE AS b FROM hosts)),
{_level_sql("suffix", "suffix", None)},
{_level_sql("domain", "domain, suffix", "suffix")},
{_level_sql("host", "host, domain", "domain")}
SELECT r.page_id, r.host, r.path, r.rule,
  CASE WHEN r.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block'
    WHEN h.rate - 1.64::DOUBLE * h.sd > 0.2 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN host_rate h USING (host)
"""
