import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fwlog.llm import embedding_dedup, simhash_dedup, topk_search
from fwlog.llm._graph import components

SMALL = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def smallest_reachable(n, pairs):
    lab = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(lab[a], lab[b])
            if lab[a] != low or lab[b] != low:
                lab[a] = lab[b] = low
                changed = True
    return lab


def test_components_against_brute_force(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400)]
    df = spark.createDataFrame([*pairs, (None, 3), (3, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    lab = smallest_reachable(401, pairs)
    assert got == {i: lab[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash_against_brute_force(spark, odd_documents, no_documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id >= 10").unionByName(odd_documents)
    rows = docs.select("doc_id", "text").collect()
    got = simhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in got}
    want = [(r["doc_id"], fingerprint(r["text"])) for r in rows]
    assert set(prints) == set(want)
    known = sorted({w for w in want if w[0] is not None})
    pairs = [(i, j) for i, a in enumerate(known) for j in range(i) for b in [known[j]] if a[0] == b[0] or (a[1] ^ b[1]).bit_count() <= 3]
    lab = smallest_reachable(len(known), pairs)
    for i, w in enumerate(known):
        assert prints[w] == known[lab[i]][0], w
    assert simhash_dedup.near_duplicates(no_documents).count() == 0


def test_shards_lose_no_pair():
    """Every pair within the margin meets in a leaf, whatever sample the tree is drawn from."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([[1 << b for b in rng.integers(0, 64, 3)] for _ in range(3000)], dtype=np.uint64)
    x = np.unique(centres[rng.integers(0, 60, 3000)] ^ flips[:, 0] ^ flips[:, 1] ^ np.where(rng.random(3000) < 0.5, flips[:, 2], 0))
    nodes = simhash_dedup.grow(rng.choice(x, 400, replace=False), 16, 3)
    met = set()
    for _, rows in simhash_dedup.route(nodes, x, 3):
        i, j = np.nonzero(np.bitwise_count(x[rows][:, None] ^ x[rows][None]) <= 3)
        met.update(zip(rows[i].tolist(), rows[j].tolist()))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
    assert met == set(zip(i.tolist(), j.tolist())) and len(nodes) > 10
    root = simhash_dedup.forest(x, 3)
    assert root.tolist() == smallest_reachable(len(x), list(zip(i.tolist(), j.tolist())))


def test_tables_hold_every_link_and_no_large_share():
    rng = np.random.default_rng(5)
    for margin in (0, 1, 2, 3, 5, 9, 63, 70):
        masks = simhash_dedup.tables(margin)
        assert len(masks) <= max(simhash_dedup.MAX_TABLES, margin + 1)
        for _ in range(200):
            bits = sum(1 << int(b) for b in rng.choice(64, min(64, margin), replace=False))
            assert any(bits & mask == 0 for mask in masks)
    x = rng.integers(0, 1 << 64, 200_000, dtype=np.uint64)  # as fingerprints of unlike texts are
    for mask in simhash_dedup.tables(simhash_dedup.MAX_BITS):
        assert np.unique(x & np.uint64(mask), return_counts=True)[1].max() < 10


def test_links_of_long_runs_against_brute_force(spark):
    """A group that agrees in most tables and is longer than a block and than an Arrow batch, beside pairs and single ones."""
    rng = np.random.default_rng(6)
    low = rng.choice(1 << 20, 12_000, replace=False).astype(np.uint64)
    pairs = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    x = np.unique(np.concatenate([low, pairs, pairs ^ np.uint64(0b111 << 40), rng.integers(0, 1 << 64, 3000, dtype=np.uint64)]))
    rng.shuffle(x)
    ids = rng.permutation(len(x)) * 7 - 500
    got = simhash_dedup.links(spark.createDataFrame([*zip(x.view(np.int64).tolist(), ids.tolist())], "fp long, id long").repartition(4))
    at = {v: k for k, v in enumerate(ids.tolist())}
    found = [(at[r["a"]], at[r["b"]]) for r in got.collect()]
    assert len(found) > 10_000

    def labels(i, j):
        root = np.arange(len(x))
        simhash_dedup._tie(root, np.array(i), np.array(j))
        return root

    linked = [np.nonzero(np.bitwise_count(x[k:k + 500, None] ^ x[None]) <= 3) for k in range(0, len(x), 500)]
    want = labels(np.concatenate([i + 500 * k for k, (i, _) in enumerate(linked)]), np.concatenate([j for _, j in linked]))
    assert (labels(*zip(*found)) == want).all()


def vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(600):
        v = base[i % 40] + rng.standard_normal(16) * (0.02 if i % 3 else 0.2)
        rows.append((i, [float(np.float32(x)) for x in v], i % 4))
    rows += [(600 + i, rows[0][1], 0) for i in range(30)]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, [1.0, None], 1), (704, [], 1),
             (705, rows[1][1], None), (706, [float("inf")] * 16, 1), (707, [1.0, 2.0], 1), (750, [0.5] * 16, 2), (750, [0.5] * 16, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def test_embedding_dedup_against_brute_force(spark):
    df, rows = vectors(spark)
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    ok = [usable(v) and any(v) and lab is not None for _, v, lab in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    pairs.append((i, j))
    links = np.zeros(len(rows), int)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    lab = smallest_reachable(len(rows), pairs)
    found = sum(r["n_links"] for r in got)
    assert 0.99 * links.sum() <= found <= links.sum() and links.sum() > 1000
    want = {rows[i][0]: rows[lab[i]][0] for i in range(len(rows))}
    same = [want[r["vec_id"]] == r["component_id"] for r in got]
    assert np.mean(same) > 0.99 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_topk_against_brute_force(spark):
    df, rows = vectors(spark)
    got = {}
    for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ints = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if usable(v)]
    for q, x in {i: x for i, x in ints if i % 50 == 0}.items():
        best = sorted((-int(x @ y), i) for i, y in ints if i != q and len(y) == len(x))[:5]
        assert got.get(q, {}) == {n: (i, -s) for n, (s, i) in enumerate(best, 1)}, q
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
