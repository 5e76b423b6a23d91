"""Exact top-k search by distributed histogram selection.

Queries go in blocks of about QUERY_BLOCK against all rows. Every row is scored; each
task counts its scores in BINS bins per query, the counts are summed, and the bin that
holds the query's kth score is refined until it is one score wide. A last pass keeps the
rows that reach the kth score, and ties go to the smaller id.

A task passes on only its highest bins, until they hold k scores of its own: the kth
score of all lies in none of the lower ones.

Components are floor(256 x); scores are exact integers. Vectors are compared only with
vectors of their length.

Edge cases: vectors that are null, empty, or hold null or non-finite components, and rows
with a null id, take no part; rows with the query's id are its own and no candidates;
repeated rows are candidates of their own; with fewer than k candidates all are returned;
only the id and vector columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, QUERY_EVERY = 5, 50
QUERY_BLOCK, BINS, TILE_ROWS = 4096, 512, 512
_OUT = "query_id long, rank int, vec_id long, score long"


def valid(vec: Column) -> Column:
    """Not null, not empty, all components finite."""
    fine = F.forall(vec, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False))


def by_length(ids: pa.Array, vecs: pa.Array):
    """Pairs (positions, ids, float64 matrix), one for each vector length."""
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    flat, ends = vecs.flatten().to_numpy(zero_copy_only=False), np.cumsum(vecs.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.diff(np.r_[0, ends])
    ids = ids.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, ids[at], flat[(ends[at] - d)[:, None] + np.arange(d)].astype(np.float64)


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x)


class Block:
    """Scores of one block of queries against rows, exact while they stay below 2**53."""

    def __init__(self, ids: pa.Array, vecs: pa.Array):
        self.parts = {m.shape[1]: (at, own, whole(m)) for at, own, m in by_length(ids, vecs)}
        self.n = len(ids)
        self.ids = ids.to_numpy(zero_copy_only=False)

    def tiles(self, batches):
        """(query positions, row ids, score matrix, mask of candidates) for tiles of rows."""
        for batch in batches:
            for _, ids, m in by_length(batch.column(0), batch.column(1)):
                if m.shape[1] not in self.parts:
                    continue
                at, own, q = self.parts[m.shape[1]]
                for lo in range(0, len(ids), TILE_ROWS):
                    rows = ids[lo:lo + TILE_ROWS]
                    yield at, rows, q @ whole(m[lo:lo + TILE_ROWS]).T, own[:, None] != rows[None, :]

    def reach(self) -> float:
        return max([float(np.abs(q).sum(axis=1).max()) for _, _, q in self.parts.values()], default=0.0)


def _counts(rows: DataFrame, block: Block, low: np.ndarray, width: int, need: np.ndarray) -> DataFrame:
    """Columns q, bin, n: scores of each query in the BINS bins of this width from `low` up."""

    def run(batches):
        hist = np.zeros((block.n, BINS), np.int64)
        for at, _, scores, ok in block.tiles(batches):
            b = np.floor((scores - low[at][:, None]) / width)
            ok &= (b >= 0) & (b < BINS)
            key = (np.arange(len(at))[:, None] * BINS + b)[ok].astype(np.int64)
            hist[at] += np.bincount(key, minlength=len(at) * BINS).reshape(-1, BINS)
        above = hist[:, ::-1].cumsum(axis=1)[:, ::-1] - hist
        q, b = np.nonzero((hist > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(hist[q, b])], names=["q", "bin", "n"])

    return rows.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _search_block(rows: DataFrame, block: Block, top: float, k: int) -> DataFrame:
    bound = block.reach() * top + 1
    low = np.full(block.n, -np.ceil(bound))
    width = 1
    while width * BINS < 2 * bound + 2:
        width *= BINS
    need = np.full(block.n, k, np.int64)  # how many of the k best lie in the bins or below
    few = np.zeros(block.n, bool)
    while True:
        seen = _counts(rows, block, low, width, need).toPandas().sort_values(["q", "bin"], ascending=[True, False])
        up = seen.groupby("q").n.cumsum()
        hit = seen[up.to_numpy() >= need[seen.q.to_numpy()]].groupby("q").first()
        before = (up - seen.n)[up.to_numpy() >= need[seen.q.to_numpy()]].groupby(seen.q).first()
        found = hit.index.to_numpy()
        few |= ~np.isin(np.arange(block.n), found)  # fewer than k candidates: all are kept
        low[found] += hit.bin.to_numpy() * width
        need[found] -= before.to_numpy()
        if width == 1:
            break
        width = max(1, width // BINS)
    least = np.where(few, -np.inf, low)

    def keep(batches):
        best: list = [np.empty(0, np.int64)] * 3
        for at, ids, scores, ok in block.tiles(batches):
            q, r = np.nonzero(ok & (scores >= least[at][:, None]))
            got = [at[q], ids[r], scores[q, r].astype(np.int64)]
            best = [np.concatenate(x) for x in zip(best, got)]
            if len(best[0]) > 8 * k * block.n:
                best = _first(best, k)
        q, ids, s = _first(best, k)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(keep, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first(best: list, k: int) -> list:
    """The k best rows of each query."""
    q, ids, s = best
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return [x[place < k] for x in (q, ids, s)]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k best rows for every row that is_query holds for."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"), is_query.alias("ask"))
    rows = rows.filter(F.col("id").isNotNull() & valid(F.col("v")))
    asked = rows.filter("ask").select("id", "v").dropDuplicates(["id"])
    rows = rows.select("id", "v")
    n = asked.count()
    size = F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: F.greatest(a, F.abs(F.floor(x.cast("double") * 256)).cast("double")))
    top = rows.agg(F.max(size)).first()[0] or 0.0
    blocks = -(-n // QUERY_BLOCK)
    found = vectors.sparkSession.createDataFrame([], _OUT)
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            found = found.unionByName(_search_block(rows, Block(own.column(0).combine_chunks(), own.column(1).combine_chunks()), top, k))
    return found


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
