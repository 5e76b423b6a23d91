"""Draw documents that look like a target collection, by importance weights and Gumbel noise.

Features of a text are its runs of 1 to MAX_RUN words, hashed to BUCKETS buckets. All texts
of both collections are counted; a bucket's gain is the scaled log ratio of its shares. The
gains are one array of BUCKETS integers that every task holds, and a text's weight is the sum
over its features. Words are found on the bytes of a whole Arrow batch; the crc32 of a run
follows from those of its words, as crc32 is linear: crc(xy) = shift(crc(x), |y|) ^ crc(y).

The order of the scores comes from a distributed radix sort, least significant digit first.
Rows lie in blocks of at most BLOCK_ROWS places. A pass counts the rows per block and digit,
turns the counts into global prefix offsets (smaller digits first, then earlier blocks), and
each block sorts its own rows by digit, stably, and sends them to offset + place within the
digit. After the last digit of the composite key (score downwards, doc_id upwards) a row's
place is its rank. A pass shuffles thin rows once and is written to the shared folder; no
task sees more than a block, and the offsets of a digit are one row per block.

Edge cases: a null text has no words; texts without a feature weigh 0; texts under the least
number of words are never drawn but are returned; a null doc_id draws its noise as the empty
text and comes after all others among ties; rows that agree in score and doc_id keep the
order they were read in; every repeated row counts and is ranked on its own; with an empty
target all its counts are 0; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fwlog.llm._batches import pieces
from fwlog.llm._graph import saved

BUCKETS, MAX_RUN = 10_000, 3
SEED, PERCENT, LEAST_WORDS = 42, 5, 20
DIGIT_BITS, BLOCK_BITS = 11, 17
BLOCK_ROWS = 1 << BLOCK_BITS

_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IN_WORD = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


class Crc:
    """crc32 of joined texts from the crc32 of the parts."""

    DIRECT = 64

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)  # the polynomial of crc32
        self._byte = byte
        # _by[n, k, b]: register b << 8k after n zero bytes
        tables = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
        for _ in range(self.DIRECT):
            last = tables[-1]
            tables.append((last >> 8) ^ byte[last & 255])
        self._by = np.stack(tables)

    def _apply(self, table, crc):
        return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]

    def joined(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """crc32 of left and right texts joined; `length` is the right texts' in bytes."""
        short, by = np.minimum(length, self.DIRECT), self._by
        out = (by[short, 0, left & 255] ^ by[short, 1, (left >> 8) & 255]
               ^ by[short, 2, (left >> 16) & 255] ^ by[short, 3, left >> 24])
        rest = length - short
        if rest.any():  # words longer than DIRECT bytes: by the bits of what is left
            table = self._by[1]
            while rest.any():
                odd = (rest & 1).astype(bool)
                out[odd] = self._apply(table, out[odd])
                rest, table = rest >> 1, self._apply(table, table)
        return out ^ right


_CRC = Crc()


def word_runs(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words per text, and per run length the crc32 at every word and whether a run of the text starts there."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "").cast(pa.large_binary())
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = np.r_[False, _IN_WORD[raw], False]
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    n_words = np.diff(np.searchsorted(starts, ends))
    if not len(starts):
        return n_words, [np.zeros(0, np.uint32)] * MAX_RUN, [np.zeros(0, bool)] * MAX_RUN
    sizes = stops - starts
    letters = _FOLDED[raw[inside[1:-1]]]
    offsets = np.r_[0, np.cumsum(sizes)]
    words = pa.Array.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    which, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
    alone = np.array([zlib.crc32(w) for w in distinct], np.uint32)[which]
    spaced = np.array([zlib.crc32(b" " + w) for w in distinct], np.uint32)[which]
    text = np.repeat(np.arange(len(n_words)), n_words)
    crcs, there = [alone], [np.ones(len(alone), bool)]
    for run in range(1, MAX_RUN):
        crc, own = np.zeros_like(alone), np.zeros(len(alone), bool)
        if len(alone) > run:
            crc[:-run] = _CRC.joined(crcs[-1][:-run], spaced[run:], sizes[run:] + 1)
            own[:-run] = text[:-run] == text[run:]
        crcs.append(crc)
        there.append(own)
    return n_words, crcs, there


def feature_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features per bucket over all texts; a task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in pieces(batch, text):
                _, crcs, there = word_runs(part.column(text))
                for crc, own in zip(crcs, there):
                    total += np.bincount(crc[own] % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.collect():  # at most BUCKETS rows
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) per bucket."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features and weight of every text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                n_words, crcs, there = word_runs(part.column(text))
                worth, features = np.zeros(len(crcs[0]), np.int64), np.zeros(len(crcs[0]), np.int64)
                for crc, own in zip(crcs, there):
                    worth += np.where(own, gain[crc % BUCKETS], 0)
                    features += own
                ends = np.r_[0, np.cumsum(n_words)]
                sums = [np.r_[0, np.cumsum(x)] for x in (features, worth)]
                columns = [pa.array(n_words.astype(np.int64)), *(pa.array(np.diff(s[ends])) for s in sums)]
                yield pa.RecordBatch.from_arrays([part.column(key), *columns], names=[key, "n_words", "n_features", "weight"])

    own = docs.select(key, text)
    kind = own.schema[key].dataType.simpleString()
    return own.mapInArrow(weigh, f"`{key}` {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) for u from the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("long")


def _digits(rows: DataFrame, keys: list[tuple[Column, bool]]) -> list[Column]:
    """Digit columns of the composite key, the least significant first; none for bits in which no row differs."""
    bounds = rows.agg(*[f(k).alias(f"{n}{i}") for i, (k, _) in enumerate(keys) for n, f in (("low", F.min), ("high", F.max))]).first()
    found = []
    for i, (k, down) in reversed(list(enumerate(keys))):
        low, high = bounds[f"low{i}"], bounds[f"high{i}"]
        if low is None or low == high:
            continue
        if high - low < 1 << 63:
            part, bits = (F.lit(high) - k if down else k - F.lit(low)), (high - low).bit_length()
        else:  # the difference does not fit a long: the bits themselves, negative numbers first
            part, bits = k.bitwiseXOR(F.lit(-1 << 63)), 64
            part = F.bitwise_not(part) if down else part
        for at in range(0, bits, DIGIT_BITS):
            found.append(F.shiftrightunsigned(part, at).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int"))
    return found


def _placed(rows: pa.Table, offsets: pa.Table) -> pa.Table:
    """The rows of one block with their places after the pass."""
    if not rows.num_rows:
        return rows.drop_columns(["digit", "block"])
    rows = rows.take(pa.array(np.argsort(rows["place"].to_numpy())))
    digit = rows["digit"].to_numpy()
    order = np.argsort(digit.astype(np.uint16), kind="stable")  # a counting sort on small integers
    counts = np.bincount(digit, minlength=1 << DIGIT_BITS)
    first = np.zeros(1 << DIGIT_BITS, np.int64)
    first[offsets["digit"].to_numpy()] = offsets["offset"].to_numpy()
    sorted_digit = digit[order]
    within = np.arange(len(order)) - (np.cumsum(counts) - counts)[sorted_digit]
    place = np.empty(len(order), np.int64)
    place[order] = first[sorted_digit] + within
    rows = rows.drop_columns(["digit", "block"])
    return rows.set_column(rows.schema.get_field_index("place"), "place", pa.array(place))


def radix_places(rows: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    """The rows with `place`, their position from 0 by integer keys (column, whether downwards), ties as stored.

    Keys are over columns of `rows` without nulls; `rows` has no columns place, block, digit.
    """
    rows = saved(rows.select("*", F.monotonically_increasing_id().alias("place")))
    schema = rows.schema
    for digit in _digits(rows, keys) or [F.lit(0)]:  # one pass at least: it makes the places dense
        dealt = rows.select("*", F.shiftright("place", BLOCK_BITS).alias("block"), digit.alias("digit"))
        counts = saved(dealt.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")))
        # at most 2^DIGIT_BITS rows
        smaller = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", (
            F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("smaller"))
        earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        offsets = counts.select("block", "digit", (F.sum("n").over(earlier) - F.col("n")).alias("earlier")).join(
            F.broadcast(smaller), "digit").select("block", "digit", (F.col("earlier") + F.col("smaller")).alias("offset"))
        rows = saved(dealt.groupBy("block").cogroup(offsets.groupBy("block")).applyInArrow(_placed, schema))
    return rows


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's key, n_words, n_features, weight, score, and its rank if it is drawn."""
    gain = gains(feature_counts(docs, text), feature_counts(target, text))
    scored = weighed(docs, gain, key, text).select("*", (F.col("weight") + noise(F.col(key), seed)).alias("score"))
    scored = saved(scored)
    rest, able = scored.filter(F.col("n_words") < least_words), scored.filter(F.col("n_words") >= least_words)
    placed = radix_places(able, [
        (F.col("score"), True), (F.col(key).isNull().cast("long"), False), (F.coalesce(key, F.lit(0)), False)])
    drawn = percent * able.count() // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    return placed.select(*scored.columns, rank).unionByName(rest.select("*", F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, ranks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The drawn documents themselves with their rank, for keys that do not repeat."""
    return docs.join(ranks.filter(F.col("rank").isNotNull()).select(key, "rank"), key)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five in a hundred of the documents, by their likeness to the benchmark texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH polynomial AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) r(i)
), texts AS (
  SELECT true AS source, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark
), worded AS (
  SELECT source, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT source, row, unnest(
    w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
      || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f
  FROM worded
), counted AS (SELECT source, row, f, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT f, xor(4294967295, list_reduce([4294967295] || list_transform(range(octet_length(encode(f))),
    lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), polynomial
), bucketed AS (SELECT source, row, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL
), shares AS (
  SELECT bucket, coalesce(sum(n) FILTER (source), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT source), 0)::DOUBLE AS t FROM bucketed GROUP BY bucket
), totals AS (SELECT sum(s) + 10000 AS s_all, sum(t) + 10000 AS t_all FROM shares
), gain AS (SELECT bucket, floor(1000 * ln((t + 1) * s_all / ((s + 1) * t_all)))::BIGINT AS g FROM shares, totals
), weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM bucketed JOIN gain USING (bucket) WHERE source GROUP BY row
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (row) WHERE source
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored
), able AS (SELECT count(*) * 5 // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM placed, able
"""
