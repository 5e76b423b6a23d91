"""The filter audit, importance resampling and collision-counting search against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fwlog.llm import collision_search, filter_audit, importance_resampling as resampling

BLANK = re.compile("[ \t-\r]+")


def masks(docs):
    """Filters a document fails, by plain loops."""
    found = []
    for doc_id, text in docs:
        t = text or ""
        words = [w for w in BLANK.split(t) if w]
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        if doc_id is not None and any(i is not None and i < doc_id and (o or "") == t for i, o in docs):
            fails += "E"
        found.append(fails)
    return found


def audited(docs, sources, quality, toxic):
    fails = masks(docs)
    rows = {}
    for part in {s or "" for s in sources}:
        own = [(i, f) for (i, _), f, s in zip(docs, fails, sources) if (s or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                kept = [x for x in left if letter not in x[1]]
                rows[part, "".join(order), step] = [
                    len(kept), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == letter for _, f in own),
                    sum(i in quality for i, _ in gone), sum(i in toxic for i, _ in gone)]
                left = kept
        for letter in "ABCDE":
            mine = [k for k in rows if k[0] == part and k[1][k[2] - 1] == letter]
            total = sum(rows[k][1] for k in mine)
            for k in mine:
                rows[k].append(total)
    return rows


def result(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in df.collect()}


def test_audit_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 0, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    extra = odd_documents.withColumn("part", F.lit("x")).withColumn("A", F.lit(True)).withColumn("mask", F.lit(3))
    rows = odd_documents.collect()
    want = audited([(r.doc_id, r.text) for r in rows], [r.source for r in rows], {1}, {1, 4})
    assert result(filter_audit.audit(extra, labels)) == want
    assert filter_audit.audit(no_documents, labels).count() == 0
    assert result(filter_audit.audit(odd_documents, labels.limit(0)))["a", "ABCDE", 1][4:6] == [0, 0]


def test_audit_of_mixed_texts(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["ab", "Cd", "e#", "x", "YY", "long"], k=rnd.choice([3, 49, 50, 60]))) for _ in range(12)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (49, 50, 80)]
    docs = [(i, rnd.choice(texts)) for i in range(80)]
    sources = [rnd.choice(["s", "s", "t", None]) for _ in docs]
    quality, toxic = set(range(0, 80, 3)), set(range(0, 80, 7))
    df = spark.createDataFrame([(i, t, s) for (i, t), s in zip(docs, sources)], "doc_id long, text string, source string").repartition(5)
    labels = spark.createDataFrame([(i, int(i in quality), int(i in toxic)) for i in range(80)], "doc_id long, quality int, toxic int")
    assert result(filter_audit.audit(df, labels)) == audited(docs, sources, quality, toxic)


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").encode().lower())
    runs = [b" ".join(words[i:i + r]) for r in (1, 2, 3) for i in range(len(words) - r + 1)]
    return len(words), [zlib.crc32(x) % 10_000 for x in runs]


def resampled(docs, target):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    rows = []
    for i, n, found in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[:5 * len(able) // 100])]
    kept = able[len(drawn):] + [r for r in rows if r[4] < 20]
    return Counter(drawn) + Counter((*r[:4], None) for r in kept)


def ranks(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_resampling_by_brute_force(spark):
    rnd = random.Random(5)
    words = ["alpha", "Beta", "x" * 70, "y" * 300, "née", "日本", "a1"] + [f"w{i}" for i in range(60)]
    docs = [(i if i % 11 else None, rnd.choice([" ", ", ", "--"]).join(rnd.choices(words, k=rnd.choice([0, 1, 2, 19, 20, 40])))) for i in range(400)]
    docs += [(5, docs[5][1])] * 3 + [(400, None), (401, ""), (402, "... !!!")]
    target = [" ".join(rnd.choices(words[:20], k=30)) for _ in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumn("rank", F.lit(1)).withColumn("place", F.lit("x"))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert ranks(resampling.resample(df, bench)) == resampled(docs, target)
    empty = df.limit(0)
    assert resampling.resample(empty, bench).count() == 0
    assert ranks(resampling.resample(df, bench.limit(0))) == resampled(docs, [])


def test_radix_places_of_wide_keys(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_BITS", 5)
    rnd = random.Random(9)
    edge = [-(1 << 63), (1 << 63) - 1, 0, -1, 1]
    rows = [(rnd.choice([*edge, rnd.randrange(-1000, 1000)]), rnd.choice([*edge, rnd.getrandbits(62)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "a long, b long, i long").repartition(6)
    got = resampling.radix_places(df, [(F.col("a"), True), (F.col("b"), False)]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(600))
    assert [(r.a, r.b) for r in got] == sorted(((a, b) for a, b, _ in rows), key=lambda x: (-x[0], x[1]))
    assert sorted(r.i for r in got) == list(range(600))


def best(ids, x, query, k):
    scores = (x * x[query]).sum(1)
    return np.sort(scores[ids != ids[query]])[::-1][:k]


@pytest.mark.parametrize("kind", ["random", "cluster", "norms"])
def test_search_recall(spark, kind):
    rng = np.random.default_rng(2)
    n, d = 24_000, 32
    x = rng.standard_normal((n, d))
    if kind == "cluster":  # a third of all rows are near copies
        x[: n // 3] = x[0] + 0.05 * rng.standard_normal((n // 3, d))
    if kind == "norms":
        x *= np.exp(rng.standard_normal(n))[:, None]
    ids = rng.permutation(n)
    df = spark.createDataFrame(zip(ids.tolist(), x.tolist()), "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in collision_search.nearest(df, F.col("vec_id") % 400 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    at = {int(i): p for p, i in enumerate(ids)}
    hits = 0
    for q in range(0, n, 400):
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(f[2] - (x[at[f[1]]] * x[at[q]]).sum()) < 1e-9 for f in found)
        hits += sum(f[2] >= best(ids, x, at[q], 20)[-1] - 1e-9 for f in found)
    assert hits / (20 * len(got)) >= 0.9


def test_search_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, []),
        (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (40, [1.0, 1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in collision_search.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == sorted([
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 2, 0.5), (20, 1, 40, 3.0), (40, 1, 20, 3.0)])
    assert collision_search.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
