import hashlib
import math
import os
from collections import Counter

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from fwlog.llm import language_id, sentencepiece_bpe, simhash_dedup, source_mixing, toxicity, url_reputation, warc_revisit


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.com/de/x?y#z"), (4, "https://a.example.net/en/1"), (4, "https://a.example.net/en/1"),
            (None, "http://b.example.org/fr/2"), (6, "http://spam.test/xx"), (7, "http://x.net"), (8, "http://x.net/"), (9, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = spark.createDataFrame([("http://spam.test/1", 1)] * 60 + [("http://fine.test/1", 0)] * 60 + [("http://spam.test/2", None)], "url string, bad int")
    got = url_reputation.judge(pages, bad, url_reputation.RULES).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["host"]): r for r in got}
    assert by[1, ""]["path"] == "" and by[2, ""]["rule"] is None
    assert (by[3, "example.com"]["rule"], by[3, "example.com"]["verdict"], by[3, "example.com"]["path"]) == ("example.com/de/", "block", "/de/x")
    assert by[4, "a.example.net"]["verdict"] == "allow" and by[None, "b.example.org"]["rule"] == "org/fr/"
    assert by[6, "spam.test"]["verdict"] == "block" and by[7, "x.net"]["rule"] is None and by[8, "x.net"]["rule"] == "net/"
    assert url_reputation.judge(pages.limit(0), bad, []).count() == 0
    assert {r["verdict"] for r in url_reputation.judge(pages, bad.limit(0), []).collect()} == {"allow"}


def test_revisits(spark):
    h = lambda **k: {n.replace("_", "-"): v for n, v in k.items()}
    rows = [
        (1, "http://WWW.a.com/x/?b=2&a=1&utm_source=z#t", 10, "response", "d1", {" ETag": '"1"', "etag": '"1"', "Content-Type": "html"}),
        (2, "https://a.com:443/x?a=1&b=2", 20, "revisit", None, h(etag='W/"1"', date="now", content_type="other")),
        (3, "http://a.com/x?a=1&b=2", 10, "revisit", None, h(etag='"1"')),
        (4, "http://a.com/x?a=1&b=2", 30, "response", "d2", None),
        (5, "http://a.com/x?a=1&b=2", 40, "revisit", "d2", None),
        (6, "http://a.com/x?a=1&b=2", 41, "revisit", None, None),
        (7, "http://a.com/x?a=1&b=2", 42, "revisit", None, h(etag='"9"')),
        (8, None, 50, "revisit", "d2", None), (9, "http://b.com", None, "revisit", "d2", None), (10, "http://b.com", 1, "revisit", "d", None),
    ]
    rec = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, digest string, headers map<string,string>")
    got = {r["record_id"]: r for r in warc_revisit.resolve(rec).collect()}
    assert {i: (r["status"], r["source_id"]) for i, r in got.items()} == {
        1: ("response", 1), 2: ("resolved", 1), 3: ("missing", None), 4: ("response", 4), 5: ("resolved", 4), 6: ("unverified", 4),
        7: ("mismatch", 4), 8: ("missing", None), 9: ("missing", None), 10: ("missing", None)}
    assert got[2]["headers"] == {"etag": 'W/"1"', "date": "now", "content-type": "html"}
    assert warc_revisit.resolve(rec.limit(0)).count() == 0


def test_revisits_of_one_hot_url_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rec = spark.range(6000).select(
            F.col("id").alias("record_id"), F.lit("http://hot.test/").alias("url"), (F.col("id") % 3000).alias("ts"),
            F.when(F.col("id") % 97 == 0, "response").otherwise("revisit").alias("kind"), F.lit("d").alias("digest"),
            F.lit(None).cast("map<string,string>").alias("headers"))
        got = {r["record_id"]: r["source_id"] for r in warc_revisit.resolve(rec).select("record_id", "source_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    full = sorted((i % 3000, i) for i in range(0, 6000, 97))
    for i in range(6000):
        if i % 97:
            before = [r for t, r in full if t < i % 3000]
            assert got[i] == (before[-1] if before else None), i


def test_mixing_rates_and_edges(spark, odd_documents, no_documents):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.lit("en").alias("lang"),
                                     F.when(F.col("id") % 3 == 0, "small").otherwise("big").alias("source"), F.lit(4).alias("copy"))
    out = source_mixing.mix(docs, weights={"small": 3.0, "big": 1.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert abs(n["small"] - 15000) < 500 and abs(n["big"] - 5000) < 300
    many = source_mixing.mix(docs.limit(50), weights={"small": 100.0, "big": 100.0}, target=4 * 50 * 100.0).count()
    assert abs(many - 5000) < 400
    rows = source_mixing.mix(odd_documents).collect()
    assert {r["source"] for r in rows} <= {"a", "b", "c", None}
    keys = [r["shuffle_key"] for r in rows]
    assert len(keys) >= len(set(keys))
    assert source_mixing.mix(no_documents).count() == 0


def test_rows_without_a_key_draw_apart(spark, monkeypatch):
    rows = spark.range(0, 40000, numPartitions=8).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("place"),
        F.lit("own").alias("copy"))
    copies = source_mixing.replicated(rows)
    n = copies.count()
    assert abs(n - 40000) < 4 * 200
    assert copies.select("shuffle_key").distinct().count() == n
    spread = copies.groupBy(F.pmod(F.hash("shuffle_key"), F.lit(8)).alias("p")).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 1.2 * n / 8
    assert {(r.place, r["copy"]) for r in copies.select("doc.*").distinct().collect()} == {(1, "own")}
    # one id, different texts: every row draws for itself
    texts = rows.select(F.lit(7).alias("doc_id"), F.concat(F.lit("t"), F.monotonically_increasing_id()).alias("text"), "source").limit(4000)
    drawn = dict(source_mixing.mix(texts.repartition(4)).groupBy("text").count().groupBy("count").count().collect())
    assert 1200 < drawn[1] < 1750 and drawn[2] > 500
    # the plan for very many sources finds the same
    monkeypatch.setattr(source_mixing, "BROADCAST_SOURCES", 0)
    again = dict(source_mixing.mix(texts.repartition(4)).groupBy("text").count().groupBy("count").count().collect())
    assert again == drawn


def test_equal_texts_are_scored_once(spark):
    long = "the cat and the dog ran with the bird over the hill " * 1200
    docs = spark.createDataFrame([(i, "der hund und die katze " * (i + 1), "de") for i in range(30)], "doc_id long, text string, lang string")
    docs = docs.unionByName(docs.limit(1).select(
        F.explode(F.sequence(F.lit(100).cast("long"), F.lit(2099).cast("long"))).alias("doc_id"), F.lit(long).alias("text"), F.lit("en").alias("lang"))).repartition(8)
    blocks = language_id._blocks(docs, "text")
    assert blocks.count() == 31 and blocks.agg(F.max(F.octet_length("text"))).first()[0] == len(long)
    found = language_id.learn_and_identify(docs, F.lit(True)).groupBy("lang", "lang_pred").count().collect()
    assert sorted((r.lang, r.lang_pred, r["count"]) for r in found) == [("de", "de", 30), ("en", "en", 2000)]


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    odd = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select(
        "*", F.lit("r").alias("row_key"), F.lit("c").alias("copy"), F.lit("a").alias("text_a"), F.lit("s").alias("score"), F.lit("d").alias("doc"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, "/root/testdata/sf0.001")
        assert kept.schema == odd.schema
        values = kept.select("row_key", "copy", "text_a", "score", "doc").distinct().collect()
        assert [tuple(r) for r in values] in ([("r", "c", "a", "s", "d")], [])


def test_pipeline_stages_against_the_operators(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near duplicates", "mixing", "tokens"]
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf).write.parquet(os.fspath(tmp_path / str(k)))
        frames.append(spark.read.parquet(os.fspath(tmp_path / str(k))))
    assert all(f.columns == docs.columns for f in frames[1:-1])
    ids = [sorted(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    assert ids[1] == sorted(r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 0").select("doc_id").collect())
    assert ids[2] == sorted(r["doc_id"] for r in language_id.learn_and_identify(frames[1], ~language_id.held_out()).filter("not rejected").select("doc_id").collect())
    groups = simhash_dedup.near_duplicates(frames[2]).collect()
    assert ids[3] == sorted({r["component_id"] for r in groups})
    assert poisson_copies(frames[3].collect()) == Counter(map(tuple, frames[4].collect()))
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.model_path())
    tokens = Counter(map(tuple, frames[5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert tokens == Counter(tokenised(library, r.doc_id, r.text) for r in frames[4].select("doc_id", "text").collect())


def tokenised(library, doc_id, text):
    ids = library.encode(text or "")
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids)))
    return doc_id, len(ids), *digests


def poisson_copies(rows):
    """Every row as often as its Poisson draw says, by plain inversion."""
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(r.text or "")
    shares = sum(math.sqrt(n) for n in sizes.values())
    found = Counter()
    for r in rows:
        rate = math.sqrt(sizes[r.source]) / shares * sum(sizes.values()) / sizes[r.source]
        draws = max(1, math.ceil(rate / 32))
        digest = hashlib.md5("\x1f".join("\\N" if v is None else str(v) for v in r).encode()).hexdigest()
        for j in range(draws):
            u = (int(hashlib.md5(f"17:{digest}:1:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            mean = rate / draws
            n, term = 0, math.exp(-mean)
            total = term
            while total < u:
                n += 1
                term *= mean / n
                total += term
            found[tuple(r)] += n
    return +found


def test_pipeline_edges(spark, odd_documents, no_documents, tmp_path):
    spark.createDataFrame([(1, 0), (8, 1), (2, 0)], "doc_id long, toxic int").write.parquet(os.fspath(tmp_path / "labels.parquet"))
    for docs in (odd_documents, no_documents):
        docs = docs.withColumn("score", F.lit("own"))
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, os.fspath(tmp_path))
            assert kept.count() >= 0 and (kept.columns == docs.columns or "ids_sha256" in kept.columns)
            docs = kept


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Also if ids are null or repeat: by the texts, not by the ids."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in ("apple", "river", "stone", "cloud"))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (None, c, "x"), (None, c, "x"), (None, c, "y"), (None, a, "x"), (3, d, "x"), (3, d, "x"), (2, d, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["text"], r["doc_id"] or 0) for r in kept) == sorted([(a, 1), (b, 1), (c, 0), (d, 2)])
    assert set(map(tuple, kept)) <= set(rows)
