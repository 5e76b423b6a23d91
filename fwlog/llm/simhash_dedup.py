"""SimHash near duplicates: fingerprints linked by tables of shared blocks and vantage-point trees.

A fingerprint's bit is set if it is set in over half of the hashes of the text's word
shingles. Equal fingerprints collapse first. The bits are cut into as many blocks as the
link distance plus a few more; two linked fingerprints differ in at most as many blocks as
the distance, so they agree in all others. There is a table for every choice of so many
others; its key is the bits of these blocks, and rows of equal key meet. So every linked pair
meets in some table, and the rows dealt are in proportion to the fingerprints: cutting them
into shards by vantage points alone left about half of them, which lie near a middle
distance from any point, in one shard. A run of equal keys is compared pairwise, a
long one through a vantage-point tree of its own, and reports a spanning forest instead of
all pairs. Components follow by joins.

In such a tree a fingerprint is inside if its Hamming distance to the vantage point is at
most the radius. By the triangle inequality, of two linked fingerprints on different sides
both lie within the link distance of the boundary; the ones of one side (the side with
fewer) are sent to both.

Edge cases: null and wordless texts have fingerprint zero and are linked like any other;
rows with a null key get a fingerprint and no component; repeated rows give repeated
result rows; only the key and the text column are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog.llm._batches import pieces
from fwlog.llm._graph import components, saved

SHINGLE_WORDS, MAX_BITS = 3, 3
#: Tables that a fingerprint is dealt to at most, unless the margin is 64 bits or more.
MAX_TABLES = 64
#: Fingerprints that are compared pairwise at once.
LEAF_ROWS = 768


def shingle_hashes(raw: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of all word shingles of a text in UTF-8; blanks are the ASCII ones."""
    words = raw.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[len(words) - n:] - 1).tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts with so many hashes each: the bits set in over half of them."""
    owner = np.repeat(np.arange(len(counts)), counts)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    out = np.zeros(len(counts), np.uint64)
    for k in range(8):
        seen = np.bincount(owner * 256 + by_byte[:, k], minlength=256 * len(counts)).reshape(-1, 256)
        over = (2 * (seen @ bits) > counts[:, None]).astype(np.uint64)
        for j in range(8):
            out |= over[:, j] << np.uint64(8 * k + j)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """Columns key, fp (64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                hashes, counts = [], []
                for raw in part.column(text).cast(pa.binary()).to_pylist():
                    own = shingle_hashes(raw or b"", width)
                    hashes.append(np.array(own, np.uint64))
                    counts.append(len(own))
                flat = np.concatenate(hashes)
                fp = majority(flat, np.array(counts, np.int64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(fp)], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def _cut(x: np.ndarray, margin: int, tries: int = 12):
    """Vantage point, radius and shared side of a good cut of these fingerprints, or None.

    Good: few are sent to both sides for the evenness gained.
    """
    best = None
    for vp in x[np.linspace(0, len(x) - 1, tries).astype(int)]:
        upto = np.cumsum(np.bincount(np.bitwise_count(x ^ vp), minlength=65)) / len(x)
        for r in range(64):
            p = upto[r]
            if not 0.08 <= p <= 0.92:
                continue
            inner = p - (upto[r - margin] if r >= margin else 0)
            outer = upto[min(64, r + margin)] - p
            both = min(inner, outer)
            if both > 0.5:
                continue
            cost = math.log1p(both) / -(p * math.log(p) + (1 - p) * math.log(1 - p))
            if best is None or cost < best[0]:
                best = (cost, vp, r, inner <= outer)
    return best and best[1:]


def _sides(x: np.ndarray, vp, r: int, inner_shared: bool, margin: int):
    """Masks of those sent inside and of those sent outside."""
    d = np.bitwise_count(x ^ vp)
    inside, outside = d <= r, d > r
    return (inside, outside | (d > r - margin)) if inner_shared else (inside | (d <= r + margin), outside)


def grow(sample: np.ndarray, leaf: int, margin: int) -> list:
    """Tree as rows (vp, radius, inner shared, inside node, outside node); leaves have no vp."""
    nodes, todo = [None], [(0, sample, 0)]
    while todo:
        at, x, depth = todo.pop()
        cut = _cut(x, margin) if len(x) > leaf and depth < 40 else None
        if cut is None:
            nodes[at] = None
            continue
        a, b = _sides(x, *cut, margin)
        nodes[at] = (*cut, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(len(nodes) - 2, x[a], depth + 1), (len(nodes) - 1, x[b], depth + 1)]
    return nodes


def route(nodes: list, x: np.ndarray, margin: int):
    """Pairs (leaf, indices into x) of all leaves that fingerprints are sent to."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if nodes[at] is None:
            if len(rows):
                yield at, rows
            continue
        vp, r, shared, i, o = nodes[at]
        a, b = _sides(x[rows], vp, r, shared, margin)
        todo += [(i, rows[a]), (o, rows[b])]


def _tie(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of these pairs; a root is the smallest index of its tree."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def forest(x: np.ndarray, margin: int) -> np.ndarray:
    """For each fingerprint the smallest index that it is linked to through these."""
    root = np.arange(len(x))
    leaves = route(grow(x, LEAF_ROWS, margin), x, margin) if len(x) > LEAF_ROWS else [(0, root.copy())]
    for _, rows in leaves:
        for lo in range(0, len(rows), LEAF_ROWS):  # blocks, so that an uncut leaf stays small
            own = rows[lo:lo + LEAF_ROWS]
            for hi in range(lo, len(rows), LEAF_ROWS):
                other = rows[hi:hi + LEAF_ROWS]
                if (root[own] == root[own[0]]).all() and (root[other] == root[own[0]]).all():
                    continue  # all of one tree already
                i, j = np.nonzero(np.bitwise_count(x[own][:, None] ^ x[other][None, :]) <= margin)
                i, j = own[i], other[j]
                _tie(root, i[i != j], j[i != j])
    return root


def tables(margin: int) -> list[int]:
    """Bits compared by each table: any two fingerprints within margin bits agree in all of some table's."""
    spare = max((k for k in range(1, margin + 1) if margin + k <= 64 and math.comb(margin + k, k) <= MAX_TABLES), default=1)
    n = margin + spare
    blocks = [(1 << 64 * (b + 1) // n) - (1 << 64 * b // n) for b in range(n)]
    return [sum(chosen) for chosen in combinations(blocks, spare)]


def _whole_runs(batches):
    """Columns of the sorted batches, cut only between two values of the first."""
    held = []

    def all_held():
        return [np.concatenate(c) for c in zip(*held)]

    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not batch.num_rows:
            continue
        if held and held[-1][0][-1] != columns[0][0]:
            yield all_held()
            held = []
        last = np.searchsorted(columns[0], columns[0][-1])
        if last:
            held.append([c[:last] for c in columns])
            yield all_held()
            held = []
        held.append([c[last:] for c in columns])
    if held:
        yield all_held()


def run_forest(key: np.ndarray, fp: np.ndarray, margin: int) -> np.ndarray:
    """For each row the smallest index that it is linked to within its run of equal keys."""
    root = np.arange(len(key))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    lengths = np.diff(np.r_[starts, len(key)])
    for start, length in zip(starts[lengths > LEAF_ROWS], lengths[lengths > LEAF_ROWS]):
        root[start:start + length] = start + forest(fp[start:start + length], margin)
    short = lengths <= LEAF_ROWS
    i, end = np.flatnonzero(np.repeat(short, lengths)), np.repeat((starts + lengths)[short], lengths[short])
    for step in range(1, LEAF_ROWS):
        inside = i + step < end
        i, end = i[inside], end[inside]
        if not len(i):
            break
        hit = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= margin]
        _tie(root, hit, hit + step)
    return root


def links(distinct: DataFrame, margin: int = MAX_BITS) -> DataFrame:
    """Columns a, b: a forest over ids that joins all fingerprints within margin bits.

    distinct: saved rows (fp, id), one per fingerprint.
    """

    def search(batches):
        for key, fp, ids in _whole_runs(batches):
            same = np.r_[False, key[1:] == key[:-1], False]
            met = np.flatnonzero(same[1:] | same[:-1])
            met = met[np.lexsort((ids[met], key[met]))]
            root = run_forest(key[met], fp[met].view(np.uint64), margin)
            tied, own = root != np.arange(len(met)), ids[met]
            if tied.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[tied]), pa.array(own[root[tied]])], names=["a", "b"])

    # tables that happen to share a key only compare more; as one long, the keys are sorted by radix
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(int(np.uint64(bits).view(np.int64)))))
            for t, bits in enumerate(tables(margin))]
    dealt = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp", "id")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")


def groups(prints: DataFrame, key: str = "doc_id", margin: int = MAX_BITS) -> DataFrame:
    """prints (key, fp) with component_id: the smallest key reachable by links."""
    distinct = saved(prints.filter(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).cast("long").alias("id")))
    joined = components(links(distinct, margin))
    of_print = distinct.join(joined, distinct.id == joined.node, "left").select(
        "fp", F.coalesce("component", "id").alias("component_id"))
    component = F.when(F.col(key).isNotNull(), F.col("component_id"))
    return prints.join(of_print, "fp", "left").select(key, "fp", component.alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    width: int = SHINGLE_WORDS, margin: int = MAX_BITS) -> DataFrame:
    """Columns key, fp, component_id of every row of docs."""
    return groups(saved(fingerprints(docs, key, text, width)), key, margin)


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest key of each group of near duplicates, with its own columns; a null key counts as the largest.

    Rows are told apart by 128 bits of all their columns; of rows that agree in every column one stays.
    """
    rest = F.to_json(F.struct(*[c for c in docs.columns if c != text]))
    row = F.struct(F.xxhash64(rest, F.col(text)).alias("a"), F.xxhash64(F.lit(1), rest, F.col(text)).alias("b"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), row.alias("row_key"))
    own = F.struct(F.col(f"doc.{key}").isNull().alias("last"), F.col(f"doc.{key}").alias("key"), "row_key")
    prints = saved(fingerprints(keyed.select(own.alias("own"), F.col(f"doc.{text}").alias("text")), "own", "text"))
    shared = groups(prints.select("fp", F.col("fp").alias("id")).distinct(), "id")
    first = prints.join(shared, "fp").groupBy("component_id").agg(F.min("own").alias("own")).select("own.row_key")
    return keyed.join(first, "row_key", "left_semi").dropDuplicates(["row_key"]).select("doc.*")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
