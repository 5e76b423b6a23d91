"""Nearest neighbours by inner product, by counting collisions on single projections.

A block of vectors has PROJECTIONS random directions and, per direction, its vectors sorted
by their projection. A query opens a window around its own projection in each sorted array.
The windows widen by WIDER at a time (virtual rehashing: nothing is hashed anew, only what
enters the windows is counted), and vectors in at least THRESHOLD of the windows are
verified by their exact inner product. A query stops when a share VERIFIED of the block and
LEAST_VERIFIED + k more have come so far, or when its windows are SURE times as wide as its kth distance, so
that hardly anything nearer can be left. If the last widening brings too many vectors, the
threshold rises as far as leaves enough; vectors with the same count are taken together.

The largest inner product is the smallest distance once a vector has a further component
that lifts it to the sphere of the largest norm. For vectors of one block to be of about one
norm, blocks are made within bands of the norm (a ratio of BAND).

Vectors are dealt to blocks of about BLOCK_ROWS and queries to blocks of about QUERY_ROWS, by
a hash of where a row is stored, so that neither a repeated id nor copies of a vector make a
block larger. Every block of queries meets every block of vectors in one task, which returns
the k best of the block; the k best of those are the result. A block's quality depends on
its size only, so the recall does not fall as vectors are added.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and
rows with a null id, take no part; vectors are compared only with vectors of their length;
rows with the query's id are its own and no candidates; repeated rows are candidates and
queries of their own; a query without candidates returns no row; only the id and vector
columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fwlog.llm._graph import saved

K, QUERY_EVERY = 20, 20
PROJECTIONS, THRESHOLD, VERIFIED, LEAST_VERIFIED = 96, 0.6, 0.08, 500
FIRST_WIDTH, WIDER, SURE = 0.2, 1.6, 1.5
BLOCK_ROWS, QUERY_ROWS, BAND = 1 << 14, 1 << 12, 1.2
SEED = 13
_OUT = "asked long, query_id long, vec_id long, score double"


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, one of them not 0."""
    fine = F.forall(vec, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(vecs: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    flat = pa.chunked_array([c.flatten() for c in vecs.chunks], vecs.type.value_type)
    return flat.to_numpy().astype(np.float64).reshape(len(vecs), -1)


def directions(length: int) -> np.ndarray:
    """Random directions in orthogonal groups: together those of a group lose nothing of a distance."""
    random, found = np.random.default_rng(SEED), []
    while sum(map(len, found)) < PROJECTIONS:
        found.append(np.linalg.qr(random.standard_normal((length, length)))[0] * np.sqrt(length))
    return np.concatenate(found)[:PROJECTIONS]


class SortedProjections:
    """The vectors of one block, sorted along every direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        norms = np.sqrt((vectors * vectors).sum(1))
        self.top = norms.max()
        self.directions = directions(vectors.shape[1] + 1)
        lifted = np.c_[vectors / self.top, np.sqrt(np.maximum(0, 1 - (norms / self.top) ** 2))]
        projected = np.ascontiguousarray((self.directions @ lifted.T).astype(np.float32))
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def _window(self, at: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the windows: arrays (queries, directions)."""
        ends = [(np.searchsorted(s, a - width, "left"), np.searchsorted(s, a + width, "right")) for s, a in zip(self.sorted, at)]
        return np.array([e[0] for e in ends]).T, np.array([e[1] for e in ends]).T

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the places of its k best verified vectors, best first, and their inner products."""
        found = []
        for lo in range(0, len(queries), 256):
            found += self._batch(query_ids[lo:lo + 256], queries[lo:lo + 256], k)
        return found

    def _batch(self, query_ids, queries, k):
        n, least = len(self.ids), int(np.ceil(THRESHOLD * PROJECTIONS))
        budget = min(n, LEAST_VERIFIED + int(VERIFIED * n) + k + 1)
        norms = np.sqrt((queries * queries).sum(1))
        at = (self.directions[:, :-1] @ (queries / norms[:, None]).T).astype(np.float32)
        low, high = self._window(at, 0.0)
        high = low.copy()
        counts = np.zeros((len(queries), n), np.int16)
        seen = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        active, width = np.arange(len(queries)), FIRST_WIDTH
        while len(active):
            new_low, new_high = self._window(at[:, active], width)
            going = []
            for q, a, b in zip(active.tolist(), new_low, new_high):
                entered = [o[x:y] for o, x, y in zip(self.order, a, low[q])] + [o[x:y] for o, x, y in zip(self.order, high[q], b)]
                counts[q] += np.bincount(np.concatenate(entered), minlength=n).astype(np.int16)
                low[q], high[q] = a, b
                enough = np.flatnonzero(counts[q] >= least)
                done = len(enough) >= budget
                if done:  # only as low as the budget asks
                    rise = np.partition(counts[q][enough], len(enough) - budget)[len(enough) - budget]
                    enough = enough[counts[q][enough] >= rise]
                fresh = np.setdiff1d(enough, seen[q][0], assume_unique=True)
                fresh = fresh[self.ids[fresh] != query_ids[q]]
                scores = (self.vectors[fresh] * queries[q]).sum(1)
                places, values = np.r_[seen[q][0], fresh], np.r_[seen[q][1], scores]
                seen[q] = places, values
                if not done and len(values) >= k:
                    kth = np.partition(values, len(values) - k)[len(values) - k]
                    distance = np.sqrt(max(0.0, 2 - 2 * kth / (norms[q] * self.top)))
                    done = width >= SURE * distance
                if not done:
                    going.append(q)
            active, width = np.array(going, np.int64), width * WIDER
        best = []
        for places, values in seen:
            order = np.lexsort((self.ids[places], -values))[:k]
            best.append((places[order], values[order]))
        return best


def _searched(k: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["asked", "query_id", "vec_id", "score"]
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        index = SortedProjections(rows["id"].to_numpy(), matrix(rows["vec"]))
        asked, own = queries["place"].to_numpy(), queries["id"].to_numpy()
        found = index.nearest(own, matrix(queries["vec"]), k)
        sizes = [len(p) for p, _ in found]
        places = np.concatenate([p for p, _ in found])
        return pa.table([
            np.repeat(asked, sizes), np.repeat(own, sizes), index.ids[places], np.concatenate([s for _, s in found])], names=names)

    return search


def _dealt(rows: DataFrame, kind: list[str], size: int, number: str) -> DataFrame:
    """Adds the block of a row: about `size` rows of one kind, whatever they hold."""
    blocks = rows.groupBy(*[F.col(c).alias(f"of_{c}") for c in kind]).agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    same = [F.col(c) == F.col(f"of_{c}") for c in kind]
    block = F.pmod(F.xxhash64(F.lit(size), "place"), F.col("blocks")).alias(number)
    return rows.join(blocks, same).select(*rows.columns, "blocks", block)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: per query the k best found by inner product, ties to smaller ids."""
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vec))).select(
        F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"), F.size(vec).alias("length"), is_query.alias("is_query"))
    rows = saved(rows.select("*", F.monotonically_increasing_id().alias("place")))
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    banded = rows.select("*", F.floor(F.log(squares) / (2 * np.log(BAND)) + 0.5).alias("band"))
    data = _dealt(banded, ["length", "band"], BLOCK_ROWS, "block")
    asked = _dealt(rows.filter("is_query"), ["length"], QUERY_ROWS, "query_block")
    # every block of queries of a length to every block of vectors of that length, and back
    query_blocks = asked.groupBy("length").agg(F.max("blocks").alias("query_blocks"))
    vector_blocks = data.groupBy("length", "band").agg(F.max("blocks").alias("vector_blocks"))
    left = data.join(F.broadcast(query_blocks), "length").select(
        "length", "band", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("query_block"), "id", "vec")
    right = asked.join(F.broadcast(vector_blocks), "length").select(
        "length", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vector_blocks") - 1)).alias("block"), "query_block", "id", "vec", "place")
    cell = ["length", "band", "block", "query_block"]
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))  # columns of their own
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_searched(k), _OUT)
    best = Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.select("*", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % QUERY_EVERY == 0)
