"""URL filter: rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host. A host's rate of bad pages is shrunk towards
its registered domain's, that towards its suffix's, that towards the whole table's, by
beta-binomial priors whose strength at each level is fitted to the spread between that
level's members (method of moments). A page is blocked if the lower posterior bound
(mean - BOUND_SD standard deviations) of its host's rate exceeds BLOCK_RATE.

Only DataFrame functions are used. Hosts meet their pages through SALTS copies of each
host's verdict, so a host with a third of all pages is spread.

Edge cases: a null url or one without `://` has empty host and path and is judged by the
whole table's rate; outcomes that are null do not count; a host without outcomes gets its
domain's rate; repeated rows count and return as often as they occur; only the key, url
and outcome columns are read; without outcomes every rate is 0 and pages are allowed;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_RATE, BOUND_SD = 0.25, 1.645
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
SALTS = 16

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
                      "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "net.au", "or.jp", "org.au", "org.uk"]

# Rules of the registered query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain; a bare suffix is its own domain."""
    two = F.substring_index(host, ".", -2)
    suffix = F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))
    labels = F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)
    return suffix, labels


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> DataFrame:
    """One row k: how many outcomes the prior of these groups' level is worth.

    groups: n, bad per group. Moments of the beta-binomial: the spread of the groups' rates
    beyond what chance gives sets the correlation within a group.
    """
    sums = groups.filter("n > 0").agg(
        F.count("*").alias("i"), F.sum("n").cast("double").alias("t"), F.sum("bad").cast("double").alias("b"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("q"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("s"))
    p = F.col("b") / F.col("t")
    excess = (F.col("s") - F.col("b") * p) / (p * (1 - p)) - (F.col("i") - 1)
    rho = excess / (F.col("t") - F.col("q") / F.col("t") - (F.col("i") - 1))
    known = (F.col("i") > 1) & (F.col("b") > 0) & (F.col("b") < F.col("t")) & (F.col("t") > F.col("q") / F.col("t") + F.col("i") - 1)
    k = F.when(known & (rho > 0), F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), 1 / F.when(rho != 0, rho) - 1))).otherwise(
        F.lit(MAX_STRENGTH))
    return sums.select(k.alias("k"))


def reputation(hosts: DataFrame) -> DataFrame:
    """hosts (host, n, bad) with rate, bound: posterior mean and lower bound of the bad rate."""
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = hosts.select("host", "n", "bad", suffix.alias("suffix"), domain.alias("domain"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))

    def shrunk(level, prior):
        return ((F.col(f"{level}.bad") + F.col("k") * prior) / (F.col(f"{level}.n") + F.col("k"))).alias("p")

    everything = total.select(F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(0.0).alias("p0"))
    of_suffix = suffixes.alias("s").join(F.broadcast(_strength(suffixes))).join(F.broadcast(everything)).select(
        F.col("s.suffix"), shrunk("s", F.col("p0")))
    of_domain = domains.alias("d").join(of_suffix.alias("s"), "suffix").join(F.broadcast(_strength(domains))).select(
        "suffix", "domain", shrunk("d", F.col("s.p")))
    a = F.col("bad") + F.col("k") * F.col("p")
    b = F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("p"))
    posterior = hosts.join(of_domain, ["suffix", "domain"]).join(F.broadcast(_strength(hosts))).select(
        "host", "n", "bad", a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return posterior.select("host", "n", "bad", mean.alias("rate"), (mean - BOUND_SD * sd).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url",
          block_rate: float = BLOCK_RATE) -> DataFrame:
    """Columns key, host, path, rule, verdict, rate of every page.

    outcomes: url and bad (1 or 0) of the labelled pages.
    """
    host, path = host_and_path(F.col(url))
    pages = pages.select(F.col(key), host.alias("host"), path.alias("path"), F.pmod(F.xxhash64(key, url), F.lit(SALTS)).alias("salt"))
    seen = outcomes.filter("bad is not null").select(host_and_path(F.col("url"))[0].alias("host"), F.col("bad").cast("long").alias("bad"))
    every = pages.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    counted = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = every.unionByName(counted).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    known = reputation(hosts).select("host", "rate", F.when(F.col("bound") > block_rate, "block").otherwise("allow").alias("says"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return pages.join(known, ["host", "salt"]).select(
        key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("says")).alias("verdict"), "rate")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad of the pages whose path names a labelled document: toxic or of low quality is bad."""
    number = F.regexp_extract(host_and_path(F.col("url"))[1], r"^/[a-z]{2}/([0-9]{1,18})", 1)
    asked = pages.select("url", number.alias("number")).filter("number <> ''").select("url", F.col("number").cast("long").alias("doc_id"))
    bad = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)).alias("bad"))
    return asked.join(bad, "doc_id").select("url", "bad")


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(pages, page_outcomes(pages, labels), RULES).drop("rate")


ORACLE = r"""
with rest as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
p as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
l as (
  select doc_id, max(case when toxic = 1 or quality = 0 then 1 when toxic is not null or quality is not null then 0 end) as bad
  from labels where doc_id is not null group by doc_id),
seen as (
  select p.host, l.bad from p join l on l.doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]{2}/([0-9]{1,18})', 1), '') as bigint)
  where l.bad is not null),
h0 as (select host, count(bad) as n, coalesce(sum(bad), 0) as bad from
       (select distinct host, null::int as bad from p union all select host, bad from seen) group by host),
h as (select host, n, bad, string_split(host, '.') as parts,
      array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as two from h0),
hosts as (
  select host, n, bad, case when two in (TWO) then two else parts[-1] end as suffix,
         case when two in (TWO) then array_to_string(list_slice(parts, -3, -1), '.') else two end as domain from h),
domains as (select suffix, domain, sum(n) as n, sum(bad) as bad from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by all),
levels as (
  select 'h' as level, n, bad from hosts union all select 'd', n, bad from domains union all select 's', n, bad from suffixes),
m as (
  select level, count(*) filter (n > 0)::double as i, sum(n)::double as t, sum(bad)::double as b,
         sum(n::double * n) as q, sum(case when n > 0 then bad::double * bad / n end) as s from levels group by level),
rho as (
  select level, i, t, b, q, case when i > 1 and b > 0 and b < t and t > q / t + i - 1 then
    ((s - b * (b / t)) / ((b / t) * (1 - b / t)) - (i - 1)) / (t - q / t - (i - 1)) end as rho from m),
k as (select level, case when rho > 0 then greatest(1.0, least(1000.0, 1 / rho - 1)) else 1000.0 end as k from rho),
total as (select coalesce(sum(bad)::double / nullif(sum(n), 0), 0) as p0 from hosts),
ps as (select suffix, (bad + k * p0) / (n + k) as p from suffixes, total, k where level = 's'),
pd as (select d.suffix, domain, (bad + k * ps.p) / (n + k) as p from domains d join ps using (suffix), k where level = 'd'),
ab as (select host, bad + k * p as a, n - bad + k * (1 - p) as b from hosts join pd using (suffix, domain), k where level = 'h'),
known as (
  select host, a / (a + b) - 1.645 * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) as bound from ab),
ruled as (
  select p.*, case
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from p)
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when bound > 0.25 then 'block' else 'allow' end as verdict
from ruled join known using (host)
""".replace("TWO", ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES))
