"""What each document filter does alone, after others, and on average over all orders.

Every document becomes one mask with a bit per filter it fails. Documents are counted per
part and mask, so a part has at most 2^5 cells whatever its size. Each cell then folds
across the array of all orders: `transform` walks the orders, `aggregate` the filters of an
order, carrying whether the cell's documents are still there. That gives 120 x 5 structs
weighted with the cell's counts, and a part's cells are merged by elementwise sums.

The orders are a literal of 120 arrays that travels with the plan; it depends on the number
of filters only. Texts stay in the scan: behind it a document is a digest, its mask and
flags. The first row of equal texts is the smallest doc_id per 256-bit digest, found by a
minimum that combines below the shuffle, and joined back on digest and doc_id together, so
neither a text with very many copies nor a large part is gathered in one task.

Edge cases: a null text counts as empty, a null part as the empty string; documents without
a label row are neither good nor toxic, several label rows of a document count as one that
has any of their ones; a null doc_id is not smaller or larger than any, so it neither fails
nor causes a failure of the copy filter and has no labels; rows that repeat a doc_id with its
text do not fail for each other; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog.llm._graph import saved

#: Words are what blanks do not split (fixed by the query's contract, as are the limits of A to D).
BLANKS = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D over a text without nulls: failure conditions by letter."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < 50,
        "B": F.lit(100) * distinct < F.lit(65) * n,
        "C": F.lit(100) * capitals > F.lit(5) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def with_copies(rows: DataFrame, digest: str = "digest", key: str = "doc_id", fails: str = "copy") -> DataFrame:
    """Adds whether a row with the same digest has a smaller key. `rows` is read twice."""
    firsts = rows.groupBy(F.col(digest).alias("first_digest")).agg(F.min(key).alias("first_key"))
    own = (F.col(digest) == F.col("first_digest")) & (F.col(key) == F.col("first_key"))
    found = F.col("first_key").isNull() & F.col(key).isNotNull()
    return rows.join(firsts, own, "left").select(*rows.columns, found.alias(fails))


def cells(rows: DataFrame, failures: list[Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """Documents per part and mask (bit i: fails filter i): n, good, toxic."""
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(failures)), F.lit(0))
    flagged = rows.select(part.alias("part"), mask.cast("int").alias("mask"), good.alias("good"), toxic.alias("toxic"))
    return flagged.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _fold(cell: Column, orders: Column) -> Column:
    """The structs of one cell over all orders, order by order and step by step."""
    zero = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails = F.call_function("shiftright", cell["mask"], bit).bitwiseAND(1) == 1
        here, alone = state["there"] & fails, cell["mask"] == F.call_function("shiftleft", F.lit(1), bit)
        row = F.struct(
            bit.alias("bit"),
            F.when(state["there"] & ~fails, cell["n"]).otherwise(zero).alias("kept"),
            F.when(here, cell["n"]).otherwise(zero).alias("removed"),
            F.when(fails & ~state["there"], cell["n"]).otherwise(zero).alias("redundant"),
            F.when(alone, cell["n"]).otherwise(zero).alias("unique_fails"),
            F.when(here, cell["good"]).otherwise(zero).alias("good_lost"),
            F.when(here, cell["toxic"]).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct((state["there"] & ~fails).alias("there"), F.concat(state["rows"], F.array(row)).alias("rows"))

    fields = ", ".join(f"{c}: bigint" for c in COUNTS)
    start = F.struct(F.lit(True).alias("there"), F.array().cast(f"array<struct<bit: int, {fields}>>").alias("rows"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["rows"])))


def _summed(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        x["bit"].alias("bit"), *[(x[c] + y[c]).alias(c) for c in COUNTS]))


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from `cells`."""
    ways = [list(p) for p in permutations(range(len(letters)))]
    orders = F.lit(ways)
    of_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    folded = of_part.select("part", F.transform("cells", lambda c: _fold(c, orders)).alias("folds"))
    first, rest = F.get("folds", F.lit(0)), F.slice("folds", F.lit(2), F.size("folds"))
    merged = folded.select("part", F.aggregate(rest, first, _summed).alias("rows"))
    # a filter's removals over all orders: its Shapley value times the number of orders
    def removals_of(bit: int) -> Column:
        return F.aggregate(F.filter("rows", lambda r: r["bit"] == bit), F.lit(0).cast("long"), lambda s, r: s + r["removed"])

    removals = F.array(*map(removals_of, range(len(letters))))
    out = merged.select("part", removals.alias("removals"), F.posexplode("rows").alias("at", "row"))
    names = F.lit(["".join(letters[i] for i in way) for way in ways])
    order = (F.col("at") / len(letters)).cast("int")
    return out.select(
        "part", F.get(names, order).alias("filter_order"), (F.col("at") % len(letters) + 1).cast("int").alias("step"),
        *[F.col("row")[c].alias(c) for c in COUNTS], F.get("removals", F.col("row")["bit"]).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Filters A to E in all 120 orders, per part."""
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    fails = text_failures(F.col("text"))
    thin = saved(own.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[f.alias(n) for n, f in fails.items()]))
    marks = labels.groupBy(F.col(key).alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = with_copies(thin, fails="E").join(marks, "doc_id", "left")
    flags = (F.coalesce(c, F.lit(False)) for c in ("good", "toxic"))
    return interactions(cells(rows, [F.col(c) for c in "ABCDE"], F.col("part"), *flags), "ABCDE")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the documents by source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs, labels)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY t) AS first
  FROM d
), f AS (
  SELECT doc_id, part,
    (len(words) < 50)::INT AS a, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
    (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT AS c,
    regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(first < doc_id, false)::INT AS e
  FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cell AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n,
    coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), bit AS (SELECT i, substr('ABCDE', i + 1, 1) AS letter FROM range(5) r(i)
), way AS (
  SELECT p.letter || q.letter || r.letter || s.letter || u.letter AS filter_order,
    [p.i, q.i, r.i, s.i, u.i] AS bits
  FROM bit p, bit q, bit r, bit s, bit u
  WHERE list_unique([p.i, q.i, r.i, s.i, u.i]) = 5
), place AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own,
    coalesce(list_sum(list_transform(bits[1:step - 1], lambda x: 1 << x)), 0)::BIGINT AS before
  FROM way, range(1, 6) g(step)
), audit AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & before = 0 AND (mask >> own) & 1 = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND (mask >> own) & 1 = 1 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND (mask >> own) & 1 = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = 1 << own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND (mask >> own) & 1 = 1 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND (mask >> own) & 1 = 1 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cell, place GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM audit
"""
