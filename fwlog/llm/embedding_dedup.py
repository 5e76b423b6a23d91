"""Embedding near duplicates by sorted projection passes.

Equal vectors of a label collapse first. In each pass a vector's key is the string of its
signs under 64 random directions; all vectors are range-sorted by label and key, every
vector is compared with the WINDOW next ones of its label, and pairs that reach the cosine
are tied. The ties of all passes are united into components by joins. Links exist only
inside components, so each vector's links are then counted there exactly, in blocks, so
that no component is gathered in one task and no pair is written out.

A pass misses pairs that the sort parts and pairs across a task's border; the passes have
directions and borders of their own. Recall against brute force is tested.

Edge cases: rows whose vector is null, zero, empty or holds null or non-finite components,
or whose label is null, link with nothing and are components of their own; vectors of
different lengths never link; rows with a null id are left out; rows that repeat an id are
repeated vectors; only the id, label and vector columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog.llm._graph import components, saved
from fwlog.llm.topk_search import by_length, valid

MIN_COSINE, PASSES, WINDOW = 0.98, 16, 48
#: Vectors of a component that are compared with each other at once; small components share a task.
BLOCK_ROWS = 1024


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def directions(length: int, run: int) -> np.ndarray:
    return np.random.default_rng([length, run]).standard_normal((length, 64))


def sign_keys(m: np.ndarray, run: int) -> np.ndarray:
    """Signs under the run's directions, the first in the highest bit."""
    signs = np.packbits(m @ directions(m.shape[1], run) > 0, axis=1)
    return signs.view(">u8").ravel().astype(np.uint64).view(np.int64)


def tied(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the pairs tie it to."""
    root = np.arange(n)
    while len(i) and (root[i] != root[j]).any():
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def pass_links(reps: DataFrame, passes: int, window: int, cosine: float) -> DataFrame:
    """Columns a, b: ties found in all passes. reps: id, label, v."""

    def keys(batches):
        for batch in batches:
            for at, ids, m in by_length(batch.column(0), batch.column(2)):
                rows = pa.array(at)
                for run in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), run, np.int32)), batch.column(1).take(rows), pa.array(sign_keys(m, run)),
                         batch.column(0).take(rows), batch.column(2).take(rows)], names=["run", "label", "key", "id", "v"])

    def compare(batches):
        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = pa.Table.from_batches([batch.slice(lo, 4096)])
                part = part if held is None else pa.concat_tables([held, part])
                fresh = 0 if held is None else held.num_rows
                ids = part.column("id").to_numpy()
                group = part.select(["run", "label"]).to_pandas()
                group = group.ne(group.shift()).any(axis=1).to_numpy().cumsum()
                vecs = part.column("v").combine_chunks()
                sizes = vecs.value_lengths().to_numpy()
                x = np.zeros((len(ids), int(sizes.max())))
                for at, _, m in by_length(part.column("id").combine_chunks(), vecs):
                    x[at, :m.shape[1]] = unit(m)
                left, right = [], []
                for step in range(1, min(window, len(ids) - 1) + 1):
                    j = np.arange(max(step, fresh), len(ids))
                    i = j - step
                    near = (group[i] == group[j]) & (sizes[i] == sizes[j])
                    i, j = i[near], j[near]
                    link = (x[i] * x[j]).sum(axis=1) >= cosine
                    left.append(i[link])
                    right.append(j[link])
                if left:
                    root = tied(len(ids), np.concatenate(left), np.concatenate(right))
                    own = np.flatnonzero(root != np.arange(len(ids)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])
                held = part.slice(max(0, part.num_rows - window))

    kinds = {f.name: f.dataType.simpleString() for f in reps.schema}
    keyed = reps.select("id", "label", "v").mapInArrow(keys, f"run int, label {kinds['label']}, key long, id long, v {kinds['v']}")
    order = ["run", "label", "key", "id"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def _count_links(members: DataFrame, cosine: float) -> DataFrame:
    """Columns id, n: rows that each member's vector links to. members: id, v, copies, component."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    shared = -(-members.count() // BLOCK_ROWS)
    m = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    small = F.col("blocks") == 1
    m = m.select(
        "id", "v", "copies", "component", "block",
        F.when(small, F.pmod(F.xxhash64("component"), F.lit(max(1, shared)))).otherwise(F.col("component")).alias("g"),
        F.when(small, -1).otherwise(F.least("block", "other")).alias("lo"),
        F.when(small, -1).otherwise(F.greatest("block", "other")).alias("hi"))

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["component", "block", "id"], ignore_index=True)
        sizes = pdf.v.map(len).to_numpy()
        x = np.zeros((len(pdf), sizes.max()))
        for d in np.unique(sizes):
            x[sizes == d, :d] = unit(np.stack(pdf.v[sizes == d].to_list()).astype(np.float64))
        copies, out = pdf.copies.to_numpy(), np.zeros(len(pdf), np.int64)

        def linked(a, b):
            return (x[a] @ x[b].T >= cosine) & (sizes[a][:, None] == sizes[b][None, :])

        if key[1] == key[2]:  # whole components, or one block with itself
            first = np.flatnonzero(np.r_[True, np.diff(pdf.component.to_numpy()) != 0])
            for lo, hi in zip(first, np.r_[first[1:], len(pdf)]):
                rows = np.arange(lo, hi)
                near = linked(rows, rows)
                np.fill_diagonal(near, False)
                out[rows] = near @ copies[rows]
        else:
            a, b = (np.flatnonzero(pdf.block.to_numpy() == k) for k in key[1:])
            near = linked(a, b)
            out[a], out[b] = near @ copies[b], near.T @ copies[a]
        return pd.DataFrame({"id": pdf.id, "n": out})

    return m.groupBy("g", "lo", "hi").applyInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", label: str = "label", vec: str = "embedding",
                    cosine: float = MIN_COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """Columns key, n_links, component_id, kept of every row with an id."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vec).alias("v")).filter("id is not null")
    part = F.col("label").isNotNull() & valid(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    compared = rows.filter(F.coalesce(part, F.lit(False)))
    alone = rows.filter(~F.coalesce(part, F.lit(False)))
    reps = saved(compared.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    joined = saved(components(pass_links(reps, passes, window, cosine)))
    members = saved(reps.join(joined, reps.id == joined.node).select("id", "v", "copies", "component"))
    counts = _count_links(members, cosine).select(F.col("id").alias("rep"), "n")
    found = reps.join(joined, reps.id == joined.node, "left").join(counts, F.col("id") == F.col("rep"), "left").select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = compared.join(found, ["label", "v"]).select("id", "n_links", "component_id").unionByName(
        alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
