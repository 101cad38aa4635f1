"""URL filter: rules first, then the reputation of the host.

Reputation: pages with a labelled outcome are counted by host. The rate of bad outcomes is shrunk down a tree: the
registered domain's rate is the prior mean of its hosts, the suffix's that of its domains, and the overall rate that of
the suffixes. The strength of each level's beta prior comes from the data by moments: the spread of the children's
rates around their parents' beyond what binomial noise explains. A host is blocked if the lower bound of its posterior
(mean less `z` standard deviations of the beta posterior) exceeds `limit`. Hosts without labels have their prior only.

Everything is DataFrame operations; the counts are pre-aggregated by host, so pages are shuffled by host only as counts
and for the join with the verdicts, where adaptive execution splits a hot host.

Defined cases: a null url, or one without `://`, has empty host and path, and an empty host is a host like any other;
null labels don't count; of repeated labels of a document the worst counts; repeated pages count each; without labels
nothing is blocked by reputation; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT, Z = 0.3, 1.645
LEVELS = ["suffix", "domain", "host"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. `rules`: host and path as one string -> allow or block."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        base, _, rest = rule.partition("/")
        fits = ((host == base) | host.endswith("." + base)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, rules[rule]).otherwise(verdict)
    return name, verdict


def reputations(counts: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """`counts` (host, n, k) with the bound of each host's bad rate and `blocked`."""
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    rows = counts.withColumn("domain", F.when(domain == "", F.col("host")).otherwise(domain))
    rows = rows.withColumn("suffix", F.regexp_extract("domain", r"([^.]*)$", 1))
    top = rows.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).select(F.when(F.col("n") > 0, (F.col("k") + 0.5) / (F.col("n") + 1.0)).otherwise(0.0).alias("mean"))
    above = None
    for depth, level in enumerate(LEVELS):
        keys = LEVELS[: depth + 1]
        nodes = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        nodes = nodes.join(above, LEVELS[:depth]) if depth else nodes.withColumn("mean", top.scalar())
        seen = F.col("n") > 0
        noise = F.col("mean") * (1 - F.col("mean"))
        spread = nodes.where(seen).agg(
            F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("mean"), 2) - noise).alias("excess"), F.sum(noise * (F.col("n") - 1)).alias("room"))
        share = F.when(F.col("room") > 0, F.col("excess") / F.col("room")).otherwise(0.0)
        strength = spread.select((1 / F.least(F.greatest(share, F.lit(0.001)), F.lit(0.5)) - 1).alias("strength"))
        nodes = nodes.withColumn("strength", strength.scalar())
        mean = (F.col("k") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))
        nodes = nodes.withColumn("mean", F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6)))
        above = nodes.select(*keys, "mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return nodes.select("host", "n", "k", (F.col("mean") - z * deviation).alias("bound")).withColumn("blocked", F.col("bound") > limit)


def judge_pages(pages: DataFrame, outcomes: DataFrame, outcome_id: Column, rules: dict[str, str]) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled and n_bad of the page's host.

    `outcomes`: doc_id and bad (0 or 1); `outcome_id` takes the doc_id from a page's row.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), outcome_id.cast("long").alias("doc_id"))
    known = outcomes.where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    labelled = rows.where("doc_id is not null").groupBy("host", "doc_id").agg(F.count("*").alias("pages")).join(known, "doc_id")
    seen = labelled.groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("k"))
    every = rows.select("host").distinct().join(seen, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    judged = rows.join(reputations(every), "host")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        F.col("n").cast("long").alias("n_labelled"), F.col("k").cast("long").alias("n_bad"))


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def judge_corpus(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The pages table; a page was made from the document whose number ends the first two parts of its path."""
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    number = F.regexp_extract(F.coalesce("url", F.lit("")), "://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1)
    return judge_pages(pages, labels.select("doc_id", bad.alias("bad")), F.when(number != "", number), RULES)


# The prior means need one step for each level: mean and strength of a level, then those below.
_LEVEL_SQL = """
{level}_n AS (SELECT {keys}, sum(n) AS n, sum(k) AS k FROM counts GROUP BY ALL),
{level}_p AS (SELECT c.*, p.mean AS prior FROM {level}_n c JOIN {parent} p {on}),
{level}_s AS (SELECT 1 / least(greatest(CASE WHEN room > 0 THEN excess / room ELSE 0 END, 0.001), 0.5) - 1 AS strength FROM (
  SELECT coalesce(sum(n * pow(k / n - prior, 2) - prior * (1 - prior)), 0) AS excess, coalesce(sum(prior * (1 - prior) * (n - 1)), 0) AS room
  FROM {level}_p WHERE n > 0)),
{level}_m AS (SELECT p.*, strength, least(greatest((k + strength * prior) / (n + strength), 1e-6), 1 - 1e-6) AS mean FROM {level}_p p, {level}_s)"""

ORACLE = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
    nullif(regexp_extract(coalesce(url, ''), '://[^/?#]*/[^/?#]*/([0-9]{{1,18}})', 1), '') AS number FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, CAST(number AS BIGINT) AS doc_id FROM parts),
known AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY doc_id),
seen AS (SELECT host, count(*) AS n, sum(bad) AS k FROM split JOIN known USING (doc_id) WHERE bad IS NOT NULL GROUP BY host),
named AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k,
    CASE WHEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+\.[^.]+)$', 1) END AS domain
  FROM (SELECT DISTINCT host FROM split) LEFT JOIN seen USING (host)),
counts AS (SELECT *, regexp_extract(domain, '([^.]*)$', 1) AS suffix FROM named),
top AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 0.5) / (sum(n) + 1.0) ELSE 0 END AS mean FROM counts),
{_LEVEL_SQL.format(level="suffix", keys="suffix", parent="top", on="ON true").strip()},
{_LEVEL_SQL.format(level="domain", keys="suffix, domain", parent="suffix_m", on="USING (suffix)").strip()},
{_LEVEL_SQL.format(level="host", keys="suffix, domain, host", parent="domain_m", on="USING (suffix, domain)").strip()},
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM split)
SELECT page_id, r.host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN mean - {Z} * sqrt(mean * (1 - mean) / (n + strength + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n AS BIGINT) AS n_labelled, CAST(k AS BIGINT) AS n_bad
FROM ruled r JOIN host_m h ON r.host = h.host
"""
