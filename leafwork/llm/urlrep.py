"""URL rules and empirical-Bayes host reputation, in DataFrame functions alone."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import written

#: (host, path prefix, verdict) of the production rule list.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Normal quantile of the posterior's one-sided 95 % bound, and the rate it has to pass.
Z, BAD = 1.645, 0.5
#: Range of a level's prior weight, in pages.
WEIGHTS = (1.0, 1000.0)
#: Suffixes of two labels that names are registered under; a host of another ending is registered under its last label.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "or.jp", "org.au", "org.uk")


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? #, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last label, or the last two where they are one of suffixes."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(suffixes)), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix and the label before it: what is registered."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(suffixes)), F.substring_index(host, ".", -3)).otherwise(two)


def _level(df: DataFrame) -> tuple[float, float]:
    """(mean rate, prior weight) of groups (n, bad), by the moments of the beta-binomial.

    The weight is that of a beta prior with the variance between the groups'
    rates that is left when binomial noise is taken off. Four sums reach the driver.
    """
    r = df.agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("xx"),
    ).first()
    if not r["n"]:
        return 0.0, WEIGHTS[1]
    m = r["bad"] / r["n"]
    spread, room = r["xx"] - r["n"] * m * m - (r["groups"] - 1) * m * (1 - m), r["n"] - r["nn"] / r["n"]
    if spread <= 1e-9 or room <= 0:
        return m, WEIGHTS[1]
    return m, min(WEIGHTS[1], max(WEIGHTS[0], m * (1 - m) * room / spread - 1))


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Posterior of each host's rate of bad pages: (host, n, bad, mean, lower, upper).

    outcomes has host and bad (0 or 1; null: no outcome, though the host is
    still scored). A host's beta prior is centred on its registered domain's
    posterior mean, that on its suffix's, and that on the mean of all pages;
    each level's weight is fitted to the spread between its groups. The suffix is the last label, or the last two where
    suffixes has them, and the registered domain has one label more.
    A host's pages are summed before they are shuffled.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = written(hosts.select("*", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix")), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    (overall, wide), (_, middle), (_, near) = (_level(x.where("n > 0")) for x in (suffixes, domains, hosts))
    by_suffix = suffixes.select("suffix", ((F.col("bad") + wide * overall) / (F.col("n") + wide)).alias("prior"))
    by_domain = domains.join(by_suffix, "suffix")
    by_domain = by_domain.select("domain", ((F.col("bad") + middle * F.col("prior")) / (F.col("n") + middle)).alias("prior"))
    out = hosts.join(written(by_domain, "priors"), "domain")
    total = F.col("n") + near
    mean = (F.col("bad") + near * F.col("prior")) / total
    out = out.select("host", "n", "bad", mean.alias("mean"))
    half = Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + near + 1))
    return out.select("*", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", page_id: str = "page_id", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    A rule (host, path) fits its host and all subdomains where the path starts
    with its path; the longest decides. Where none fits, the host's reputation
    does: each page that a rule fits is labelled by it, as bad if it blocks it, others say nothing about their host, and a host is
    blocked when the lower bound of its posterior rate of bad pages passes BAD. A null url, or
    one without ://, has empty host and path and is judged as host "". Rows
    may repeat; other columns are not read; an empty table gives none.
    """
    urls = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = urls.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    bad = (F.col("fits.verdict") == "block").cast("int")
    scored = reputations(urls.select("host", bad.alias("bad")), suffixes)
    blocked = written(scored.where(F.round("lower", 9) > BAD).select("host", F.lit("block").alias("by_host")), "blocked")
    return urls.join(blocked, "host", "left").select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", "by_host", F.lit("allow")).alias("verdict"))


def judge_sql(rules: list[tuple[str, str, str]] = RULES, suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """DuckDB SQL of judge over pages."""
    known = ", ".join(f"'{x}'" for x in suffixes)
    two = "array_to_string(string_split(host, '.')[-2:], '.')"
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    low, high = WEIGHTS

    def level(name: str) -> str:
        return f"""
  SELECT m, CASE WHEN n IS NULL OR xx - n*m*m - (g-1)*m*(1-m) <= 1e-9 OR n - nn/n <= 0 THEN {high}
    ELSE least({high}, greatest({low}, m*(1-m)*(n - nn/n) / (xx - n*m*m - (g-1)*m*(1-m)) - 1)) END AS k
  FROM (SELECT count(*) AS g, sum(n) AS n, sum(bad)/sum(n) AS m, sum(n::DOUBLE*n) AS nn, sum(bad::DOUBLE*bad/n) AS xx FROM {name} WHERE n > 0)"""

    return f"""
WITH rules(h, p, v) AS (VALUES {values}),
parts AS (SELECT rowid AS row, page_id,
    translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path
  FROM (SELECT *, row_number() OVER () AS rowid FROM pages)),
urls AS (SELECT row, any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path,
    arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row),
hosts AS (SELECT host, count(verdict) AS n, count(*) FILTER (verdict = 'block') AS bad,
    CASE WHEN {two} IN ({known}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE {two} END AS domain,
    CASE WHEN {two} IN ({known}) THEN {two} ELSE string_split(host, '.')[-1] END AS suffix FROM urls GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
l1 AS ({level("suffixes")}), l2 AS ({level("domains")}), l3 AS ({level("hosts")}),
p1 AS (SELECT suffix, (bad + k*m) / (n + k) AS prior FROM suffixes, l1),
p2 AS (SELECT domain, (bad + k*prior) / (n + k) AS prior FROM domains JOIN p1 USING (suffix), l2),
p3 AS (SELECT host, n, k, (bad + k*prior) / (n + k) AS mean FROM hosts JOIN p2 USING (domain), l3),
blocked AS (SELECT host FROM p3 WHERE round(mean - {Z} * sqrt(mean*(1-mean) / (n + k + 1)), 9) > {BAD})
SELECT page_id, urls.host, path, rule, coalesce(verdict, CASE WHEN blocked.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM urls LEFT JOIN blocked ON urls.host = blocked.host"""


