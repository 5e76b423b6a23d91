"""Mixing of sources to target weights by Poisson replication.

A source's repetition rate is its share of the target size divided by its own size. Every
row draws its number of copies from the Poisson law with that mean, by inverting the
distribution function at a number in (0, 1) that is a hash of the seed and the row, so the
draw depends on nothing else and a lost task draws it again. Rows are exploded by their
counts and dealt out by a hash of row and copy, sorted by it within each partition:
a global shuffle that needs no order of arrival.

A row is the digest of all its columns and its occurrence. That is 1 for a row without an
equal; rows that are equal in every column take the place they are stored at, so they draw
apart from each other. Whether there are any is counted on digests only.

Means above MAX_MEAN are drawn as sums of equal parts, so that no term underflows.

Without given weights a source's target share is proportional to its size to the power
TEMPERATURE, and the target size is the size of all sources together. Sizes are characters.

Edge cases: null sources are one source of their own; a source of size zero (null and empty
texts only) is repeated at rate one; sources missing from given weights get rate zero; null
and repeated keys do not matter, as every row draws for itself; no rate is capped; `mix`
replaces columns named copy and shuffle_key, `replicated` leaves a row's columns together
in `doc`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog.llm._graph import saved

TEMPERATURE, SEED, MAX_MEAN = 0.5, 17, 32.0
#: Most sources whose rates are sent to every task; beyond, rates are joined with SALTS copies. Salts of repeated rows too.
BROADCAST_SOURCES, SALTS = 100_000, 64


def hash_unit(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def distribution(mean: Column) -> Column:
    """Distribution function of the Poisson law at 0, 1, ... to far beyond its mean."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), start, lambda acc, k: F.struct(
        (acc["term"] * mean / k).alias("term"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["term"] * mean / k)).alias("cdf")))["cdf"]


def rates(docs: DataFrame, weights: dict | None = None, target: float | None = None, temperature: float = TEMPERATURE,
          text: str = "text", source: str = "source") -> DataFrame:
    """source, size, rate of every source; one row per source."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    sizes = saved(sizes.withColumn("share", F.when(F.col("size") > 0, share).otherwise(0.0)))
    total = sizes.agg(F.sum("size").alias("all"), F.sum("share").alias("shares"))
    goal = F.lit(float(target)) if target is not None else F.col("all").cast("double")
    rate = F.when(F.col("size") == 0, 1.0).otherwise(
        F.when(F.col("shares") > 0, F.col("share") / F.col("shares") * goal / F.col("size")).otherwise(0.0))
    return sizes.join(F.broadcast(total)).select("source", "size", rate.alias("rate"))


def _occurrence(rows: DataFrame) -> DataFrame:
    """rows (doc, source, row) with `occurrence`: 1, or for rows with an equal the place they are stored at."""
    repeats = saved(rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row"))
    if repeats.isEmpty():
        return rows.withColumn("occurrence", F.lit("1"))
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    salted = repeats.select(F.col("row").alias("again"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own_salt = F.pmod(F.col("place"), F.lit(SALTS)).cast("int")
    both = placed.join(salted, (F.col("row") == F.col("again")) & (own_salt == F.col("salt")), "left")
    occurrence = F.when(F.col("again").isNull(), "1").otherwise(F.concat(F.lit("at "), F.col("place").cast("string")))
    return both.select(*rows.columns, occurrence.alias("occurrence"))


def replicated(docs: DataFrame, weights: dict | None = None, target: float | None = None, temperature: float = TEMPERATURE,
               seed: int = SEED, text: str = "text", source: str = "source") -> DataFrame:
    """doc (a struct of the columns of docs), copy (from 1) and shuffle_key, once per copy, globally shuffled."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN).cast("int"))
    table = saved(rates(docs, weights, target, temperature, text, source).select(
        F.col("source").alias("of_source"), draws.alias("draws"), distribution(F.col("rate") / draws).alias("cdf")))
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in docs.columns]
    row = F.md5(F.concat_ws("\x1f", *columns).cast("binary"))
    own = _occurrence(docs.select(F.struct(*docs.columns).alias("doc"), F.col(source).alias("source"), row.alias("row")))
    if table.count() <= BROADCAST_SOURCES:
        joined = own.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("of_source")))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own_salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
        joined = own.join(salted, F.col("source").eqNullSafe(F.col("of_source")) & (own_salt == F.col("salt")))

    def drawn(j):
        u = hash_unit(str(seed), F.col("row"), F.col("occurrence"), j)
        return F.size(F.filter("cdf", lambda c: c < u))

    count = F.aggregate(F.sequence(F.lit(0), F.col("draws") - 1), F.lit(0), lambda acc, j: acc + drawn(j))
    copies = joined.select("doc", "row", "occurrence", count.alias("n")).filter("n > 0")
    copies = copies.withColumn("copy", F.explode(F.expr("sequence(1, n)")))
    place = F.md5(F.concat_ws(":", F.lit("shuffle"), F.lit(str(seed)), "row", "occurrence", F.col("copy")).cast("binary"))
    out = copies.select("doc", "copy", place.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, weights: dict | None = None, target: float | None = None, temperature: float = TEMPERATURE,
        seed: int = SEED, text: str = "text", source: str = "source") -> DataFrame:
    """docs with copy (from 1) and shuffle_key, once per copy, globally shuffled."""
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in ("copy", "shuffle_key")]
    return replicated(docs, weights, target, temperature, seed, text, source).select(*kept, "copy", "shuffle_key")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: For rows without an equal, as in the given tables.
ORACLE = """
with sizes as (select source, coalesce(sum(length(text)), 0) as size from documents group by source),
total as (select sum(size) as everything, sum(sqrt(size::double)) as shares from sizes),
rate as (
  select source, case when size = 0 then 1.0 else sqrt(size::double) / shares * everything::double / size end as rate from sizes, total),
parts as (select source, rate / greatest(1, ceil(rate / 32)) as mean, greatest(1, ceil(rate / 32))::int as draws from rate),
law as (
  select source, draws, mean, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) over (partition by source order by k) as cdf
  from parts, range(120) r(k) where k <= ceil(mean + 12 * sqrt(mean) + 20)),
laws as (select source, draws, list(cdf order by k) as cdf from law group by source, draws),
named as (
  select *, md5(concat_ws(chr(31), coalesce(doc_id::varchar, '\\N'), coalesce(text, '\\N'), coalesce(lang, '\\N'),
    coalesce(source, '\\N'), coalesce(n_chars::varchar, '\\N'))) as row from documents),
drawn as (
  select d.*, list_sum(list_transform(range(draws), lambda j: len(list_filter(cdf, lambda c: c <
    ((('0x' || substr(md5('17:' || row || ':1:' || j), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0)))) as n
  from named d join laws l on d.source is not distinct from l.source)
select doc_id, text, lang, source, n_chars, copy::int as copy,
       md5('shuffle:17:' || row || ':1:' || copy) as shuffle_key
from (select *, unnest(range(1, n::bigint + 1)) as copy from drawn)
"""
