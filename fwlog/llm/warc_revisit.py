"""Not-modified revisits of web archives resolved to the full response they stand for.

A revisit takes the latest strictly earlier response of its canonical URL. Its validators
are checked against that response's (entity tag first, by weak comparison, then the
modification time, then the payload digest); if they hold, the headers a not-modified
answer may update are merged over the stored ones.

Records are range-sorted by canonical URL and time. Within a range the latest response is
a running window; what a range starts with is the last response of the ranges before it, of
which there is one per range. A URL with a third of all records is cut over many ranges;
only records of one URL and one second stay together.

Edge cases: records with a null URL or time are `missing` (responses stay `response`);
responses of one second: the larger record id counts; repeated rows resolve alike; null
headers are none; of header names equal but for case or blanks the first counts; a revisit
without any validator is `unverified` and merges nothing; of other columns only the ones
named are read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fwlog.llm._graph import saved

# Headers that a not-modified answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that do not select content.
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host lower-cased without `www.` and a default port, no fragment, tracking
    parameters or closing slash; other parameters sorted."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def tidy_headers(headers: Column) -> Column:
    """Names trimmed and lower-cased; the first of equal names stays."""
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                        lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), e["value"].alias("v")))
    names = F.transform(pairs, lambda e: e["k"])
    return F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(names, e["k"]) == i + 1))


def merged_headers(stored: Column, update: Column) -> Column:
    new = F.map_filter(update, lambda k, _: k.isin(PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False))), new)


def resolve(records: DataFrame) -> DataFrame:
    """record_id, canonical, source_id, status, headers of every record.

    records: record_id, url, ts (seconds), kind (`response` or `revisit`), digest, headers.
    A response is its own source. status: response, resolved, mismatch, unverified or missing.
    """
    rec = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), "kind",
                         "digest", tidy_headers(F.col("headers")).alias("headers"))
    ranged = saved(rec.repartitionByRange("canonical", "ts").withColumn("range", F.spark_partition_id()))
    stored = F.struct("record_id", "canonical", "digest", "headers")
    full = F.when((F.col("kind") == "response") & F.col("canonical").isNotNull() & F.col("ts").isNotNull(), stored)
    at = F.struct("ts", "record_id")

    tails = ranged.filter(full.isNotNull()).groupBy("range").agg(F.max_by(stored, F.struct("canonical", "ts", "record_id")).alias("tail"))
    every = ranged.select("range").distinct().join(tails, "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = every.select("range", F.last("tail", ignorenulls=True).over(before).alias("carried"))

    earlier = Window.partitionBy("range", "canonical").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    here = F.max_by(full, F.when(full.isNotNull(), at)).over(earlier)
    rows = ranged.withColumn("here", here).join(F.broadcast(carried), "range", "left")
    source = F.when(F.col("ts").isNotNull(), F.coalesce("here", F.when(F.col("carried.canonical") == F.col("canonical"), F.col("carried"))))
    rows = rows.withColumn("source", F.when(F.col("kind") == "revisit", source))

    def tag(headers):
        return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")

    mine, theirs = F.col("headers"), F.col("source.headers")
    checks = F.when(tag(mine).isNotNull(), F.coalesce(tag(mine) == tag(theirs), F.lit(False))).when(
        F.element_at(mine, "last-modified").isNotNull(),
        F.coalesce(F.element_at(mine, "last-modified") == F.element_at(theirs, "last-modified"), F.lit(False))).when(
        F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("source.digest"), F.lit(False)))
    status = F.when(F.col("kind") == "response", "response").when(F.col("source").isNull(), "missing").when(
        checks.isNull(), "unverified").when(checks, "resolved").otherwise("mismatch")
    rows = rows.withColumn("status", status)
    return rows.select(
        "record_id", "canonical",
        F.when(F.col("kind") == "response", F.col("record_id")).otherwise(F.col("source.record_id")).alias("source_id"), "status",
        F.when(F.col("status") == "resolved", merged_headers(theirs, mine)).otherwise(mine).alias("headers"))


# Four captures of every page as records; the text is both Spark SQL and DuckDB SQL.
_CAPTURES = """
select page_id * 4 + k as record_id, url,
       case when page_id % 11 = 0 and k < 2 then 1000 else k * 86400 + page_id % 1000 end as ts,
       case when k = 0 or (k = 2 and page_id % 3 = 0) then 'response' else 'revisit' end as kind,
       md5(html) as digest,
       case when page_id % 7 = 6 and k > 0 then null
            when k = 1 and page_id % 5 = 0 then concat('"x', page_id % 97, '"')
            when k = 1 and page_id % 5 = 1 then concat('W/"t', page_id % 97, '"')
            when k = 3 and page_id % 3 = 0 then concat('"u', page_id % 97, '"')
            when k = 2 and page_id % 3 = 0 then concat('"u', page_id % 97, '"')
            else concat('"t', page_id % 97, '"') end as etag,
       case when page_id % 7 = 6 and k > 0 and page_id % 2 = 0 then null
            else concat('day ', page_id % 28 + case when k >= 2 and page_id % 3 = 0 then 1 else 0 end) end as modified,
       concat('max-age=', k * 60) as cache,
       case when k = 0 then 'text/html' else 'text/plain' end as type
from pages cross_k
"""


def captures(pages: DataFrame) -> DataFrame:
    """Archive records derived from a page table: page_id, url, html."""
    rows = pages.select("page_id", "url", "html", F.explode(F.expr("sequence(0, 3)")).alias("k"))
    sql = _CAPTURES.replace("pages cross_k", "{pages}")
    rec = pages.sparkSession.sql(sql, pages=rows)
    headers = F.map_filter(F.create_map(F.lit("ETag"), "etag", F.lit("Last-Modified"), "modified", F.lit("Cache-Control"), "cache",
                                        F.lit("Content-Type"), "type"), lambda _, v: v.isNotNull())
    return rec.select("record_id", "url", F.col("ts").cast("long"), "kind", "digest", headers.alias("headers"))


def op3_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return done.select("record_id", "canonical", F.coalesce("source_id", F.lit(-1)).alias("source_id"), "status", F.array_join(lines, "\n").alias("headers"))


ORACLE = r"""
with rec as (CAPTURES),
u as (
  select *, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g') as bare from rec),
c as (
  select *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
    || case when len(kept) > 0 then '?' || array_to_string(list_sort(kept), '&') else '' end as canonical
  from (select *, list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
          lambda p: p <> '' and not (split_part(p, '=', 1) in (TRACKING))) as kept from u)),
r as (select canonical, ts, record_id, etag, modified, cache, type, digest from c where kind = 'response'
      qualify row_number() over (partition by canonical, ts order by record_id desc) = 1),
j as (
  select c.*, r.record_id as src, r.etag as s_etag, r.modified as s_modified, r.cache as s_cache, r.type as s_type, r.digest as s_digest
  from c asof left join r on c.canonical = r.canonical and c.ts > r.ts),
s as (
  select *, case when kind = 'response' then 'response' when src is null then 'missing'
    when etag is not null then case when regexp_replace(etag, '^W/', '') = regexp_replace(s_etag, '^W/', '') then 'resolved' else 'mismatch' end
    when modified is not null then case when modified = s_modified then 'resolved' else 'mismatch' end
    when digest is not null then case when digest = s_digest then 'resolved' else 'mismatch' end
    else 'unverified' end as status from j)
select record_id, canonical, coalesce(case when kind = 'response' then record_id else src end, -1) as source_id, status,
  concat_ws(chr(10), 'cache-control: ' || cache,
    'content-type: ' || case when status = 'resolved' then s_type else type end,
    'etag: ' || case when status = 'resolved' then coalesce(etag, s_etag) else etag end,
    'last-modified: ' || case when status = 'resolved' then coalesce(modified, s_modified) else modified end) as headers
from s
""".replace("CAPTURES", _CAPTURES.replace("pages cross_k", "pages, range(4) g(k)")).replace("TRACKING", ", ".join(f"'{t}'" for t in TRACKING))
