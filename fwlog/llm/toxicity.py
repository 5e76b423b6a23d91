"""Toxicity: maximal scoring segments of token log-odds with extreme-value calibration.

Every token has the log-odds of standing in a labelled toxic text, with a Dirichlet prior
of PRIOR tokens. The prior of a word is split as the estimate for its stem of 8 letters, that
one's as for its stem of 7, and so on down to 3 letters and to the classes' share of all
tokens, so forms that were never seen count like their stem. Odds that are not clear of
zero count as none, and every token loses DRIFT, so that passages end. One linear scan finds all
maximal scoring segments of a text. For chance segments Karlin-Altschul statistics hold:
about K n exp(-lambda S) of n words reach score S, where lambda solves the moment equation
of the clean texts' tokens and K is fitted to the maxima of clean texts (a Gumbel law). A
text's evidence is the sum over its significant segments of lambda S - ln(K n); a logistic
curve turns it into a probability.

Words and stems are hashed to BUCKETS, which bounds the model. The classifier is fitted on a sample
of about MAX_LABELLED labelled texts, chosen by a hash of the key; of texts with one label and the
same smallest hash of three adjacent words (copies, and most near copies) one is learned
from, and a word counts once per text, so that copied or repetitive texts do not lend
their other words a class.

Edge cases: null and empty texts have no evidence and get the score of a text without any
passage; rows with a null key or label are never learned from; of several labels of a key
the largest counts; without both classes in the labels no text is predicted toxic; whole
texts are scanned; repeated rows get equal scores; existing columns named like the outputs
are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fwlog.llm._batches import out_schema, pieces, with_columns
from fwlog.llm._graph import saved

BUCKETS, MAX_LABELLED = 1 << 19, 30_000
PRIOR, CLEAR_SD, DRIFT = 4.0, 2.5, 0.03
STEMS = range(3, 9)
#: Chance segments expected in a text at which a passage counts as significant.
SIGNIFICANT = 1.0
_EULER = 0.5772156649
_WORD = re.compile(r"\w+")
#: Distinct words a task remembers before it starts afresh.
CACHED_WORDS = 500_000


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def stems(word: str) -> list[str]:
    """Stems shorter than the word, shortest first; marked, so that none equals a word."""
    return [f"{word[:k]}*" for k in STEMS if k < len(word)]


class WordScores(dict):
    """Score of each word, computed once for words of usual length."""

    def __init__(self, clean: np.ndarray, toxic: np.ndarray, share: float):
        self.clean, self.toxic, self.share = clean, toxic, share

    def __reduce__(self):
        return WordScores, (self.clean, self.toxic, self.share)

    def __missing__(self, word):
        part = self.share
        for form in (*stems(word), word):
            b = bucket(form)
            y1, y0 = self.toxic[b] + PRIOR * part, self.clean[b] + PRIOR * (1 - part)
            part = y1 / (y1 + y0)
        odds = math.log(y1 / y0) - math.log(self.share / (1 - self.share))
        value = (odds if abs(odds) > CLEAR_SD * math.sqrt(1 / y1 + 1 / y0) else 0.0) - DRIFT
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        words = _WORD.findall(text.lower())
        scores = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        for i in np.flatnonzero(scores > 0).tolist():  # a word said again at once adds nothing
            if i and words[i] == words[i - 1]:
                scores[i] = -DRIFT
        return scores


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, start, end), in one scan.

    A segment is maximal if its score grows by no change of its ends and it lies in no
    larger such segment. The stack holds open candidates with the totals left and right of
    them; each is merged at most once.
    """
    stack, total = [], 0.0
    for i, x in enumerate(scores):
        left = total
        total += x
        if x <= 0:
            continue
        lo, new = i, (left, total)
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= new[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= new[1]:
                break
            new, lo = (stack[j][0], new[1]), stack[j][2]
            del stack[j:]
        # link to the next candidate to the left with a smaller left total
        j = len(stack) - 1
        while j >= 0 and stack[j][0] >= new[0]:
            j = stack[j][4]
        stack.append((new[0], new[1], lo, i + 1, j))
    return [(r - l, a, b) for l, r, a, b, _ in stack]


def passages(values: np.ndarray) -> list[tuple[float, int, int]]:
    """Maximal scoring segments of a text's token scores; runs without gain are folded first."""
    gain = values > 0
    if not gain.any():
        return []
    edge = np.flatnonzero(np.diff(gain.astype(np.int8))) + 1
    starts = np.r_[0, edge]
    sums = np.add.reduceat(values, starts)
    ends = np.r_[edge, len(values)]
    return [(s, int(starts[a]), int(ends[b - 1])) for s, a, b in segments(sums.tolist())]


@dataclass
class Model:
    words: WordScores
    rate: float  # lambda
    log_k: float
    offset: float
    slope: float

    def evidence(self, values: np.ndarray) -> tuple[float, list]:
        """Summed significance in nats, and the significant passages as (start, end, nats)."""
        found, noise = [], self.log_k + math.log(max(1, len(values)))
        for s, a, b in passages(values):
            bits = self.rate * s - noise
            if bits > -math.log(SIGNIFICANT):
                found.append((a, b, bits))
        return sum(x[2] for x in found), found

    def score(self, evidence: float) -> float:
        z = self.offset + self.slope * evidence
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _learned(sample: DataFrame) -> DataFrame:
    """One text (columns text, toxic) per label and smallest hash of three adjacent words."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                keys = []
                for text in part.column("text").to_pylist():
                    words = _WORD.findall((text or "").lower())
                    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
                    if len(h) > 2:
                        h = (h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
                    keys.append(int(h.min() >> np.uint64(1)) if len(h) else 0)
                yield with_columns(part, near=pa.array(keys, pa.int64()))

    keyed = sample.mapInArrow(run, "text string, toxic int, near long")
    return saved(keyed.dropDuplicates(["near", "toxic"]).select("text", "toxic"))


def _token_counts(sample: DataFrame) -> DataFrame:
    """Columns bucket, clean, toxic: words and stems of each class."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                own = (Counter(), Counter())
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    own[toxic].update(set(_WORD.findall((text or "").lower())))
                for c in (0, 1):
                    for word, n in own[c].items():
                        for form in (*stems(word), word):
                            counts[c][bucket(form)] += n
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "clean", "toxic"])

    return sample.mapInArrow(run, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def moment_rate(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1 for scores s of frequency p."""
    if not len(scores) or (scores * p).sum() >= 0 or scores.max() <= 0:
        return 1.0
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(mid * scores)).sum() > 1 else (mid, hi)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a ridge-bound logistic fit by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(2), np.array([1e-6, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, trains: Column | None = None, key: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model | None:
    """Model of the labelled texts for which `trains` (over the key) holds; None without both classes."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    known = (known.filter(trains) if trains is not None else known).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select(key, F.col(text).alias("text")).join(F.broadcast(known), key).select("text", "toxic")
    sample = _learned(sample)
    counts = _token_counts(sample).toPandas()
    clean, toxic = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    clean[counts.bucket], toxic[counts.bucket] = counts.clean, counts.toxic
    if not clean.sum() or not toxic.sum():
        return None
    words = WordScores(clean, toxic, float(toxic.sum() / (clean.sum() + toxic.sum())))

    def clean_texts(batches):  # token scores in hundredths, and the sums a Gumbel fit needs
        tokens, tops, logs, n = Counter(), 0.0, 0.0, 0
        for batch in batches:
            for part in pieces(batch, "text"):
                for text in part.column("text").to_pylist():
                    v = words.of(text or "")
                    tokens.update(dict(zip(*map(np.ndarray.tolist, np.unique(np.round(v * 100), return_counts=True)))))
                    tops += max([s for s, _, _ in passages(v)], default=0.0)
                    logs, n = logs + math.log(max(1, len(v))), n + 1
        rows = [("token", k / 100, float(m)) for k, m in tokens.items()] + [("top", 0.0, tops), ("log", 0.0, logs), ("n", 0.0, float(n))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["kind", "s", "v"])

    seen = sample.filter("toxic = 0").mapInArrow(clean_texts, "kind string, s double, v double").groupBy("kind", "s").agg(
        F.sum("v").alias("v")).toPandas()
    of = {k: seen[seen.kind == k] for k in ("token", "top", "log", "n")}
    rate = moment_rate(of["token"].s.to_numpy(), of["token"].v.to_numpy() / max(1.0, of["token"].v.sum()))
    gumbel = (rate * of["top"].v.sum() - of["log"].v.sum()) / max(1.0, of["n"].v.sum())
    model = Model(words, rate, gumbel - _EULER, 0.0, 1.0)

    def evidence(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([model.evidence(model.words.of(t or ""))[0] for t in part.column("text").to_pylist()]), part.column("toxic")],
                    names=["x", "toxic"])

    seen = sample.mapInArrow(evidence, "x double, toxic int").toPandas()
    model.offset, model.slope = _logistic(np.minimum(seen.x.to_numpy(), 50), seen.toxic.to_numpy().astype(float))
    return model


_PASSAGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("nats", T.DoubleType())])


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with score, predicted and the significant passages (words from start up to end)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("nats", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                rows = [model.evidence(model.words.of(t or "")) if model else (0.0, []) for t in part.column(text).to_pylist()]
                scores = [model.score(min(x, 50.0)) if model else 0.0 for x, _ in rows]
                yield with_columns(part, score=pa.array(scores, pa.float64()), predicted=pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                                   passages=pa.array([[dict(zip(("start", "end", "nats"), p)) for p in ps] for _, ps in rows], kind))

    return docs.mapInArrow(run, out_schema(docs, score=T.DoubleType(), predicted=T.IntegerType(), passages=T.ArrayType(_PASSAGE)))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
