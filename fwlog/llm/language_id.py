"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-cased letters with single blanks between words. Every training text
adds its character 4-grams to its language's counts; the lower orders count distinct left
neighbours, as Kneser-Ney smoothing asks. The models are a table: per n-gram the languages
that have it, each with its log probability and its log back-off weight as a context. The
language with the lowest cross-entropy per character wins; a text is rejected if even that
is far above what training texts of that language and about its length have.

All training texts are counted, and the models keep every n-gram: discounts, context totals
and probabilities of all orders are joins and sums over the whole counts. No task holds the
models. Every distinct text (by a 128-bit key) is scored once, whatever the number of its
copies, and the answers are joined back by that key. Distinct texts are dealt to blocks of
about BLOCK_BYTES by their key; a block's distinct n-grams are joined to the table, and the
block is scored with the rows found. Letters beyond the basic plane are folded onto it.
The rejection limits come from all training texts: mean and deviation per predicted language
and octave of the length. An octave with under LEAST_TEXTS texts takes the limit of the
nearest octave of its language, a language without any such octave the highest limit that
another has at that octave; if no language has one, nothing but `und` is rejected.

Edge cases: null texts and texts without a letter get `und`, score 0 and are rejected;
rows with a null lang are never learned from; without any training text all are `und`;
ties go to the language that comes first in order; repeated rows count as often as they
occur; existing columns named like the outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog.llm._batches import pieces
from fwlog.llm._graph import saved

ORDER = 4
#: Training texts of a language and length octave that make a limit of their own.
LEAST_TEXTS = 20
#: Bytes of text that are scored together.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are cut into n-grams at once.
PART_BYTES = 1 << 20
#: n-grams a task holds before it passes its counts on.
HELD_GRAMS = 500_000
#: A text is rejected above mean + REJECT_SD standard deviations + REJECT_MARGIN nats per character.
REJECT_SD, REJECT_MARGIN = 8.0, 0.25
#: Characters of evidence a confidence is worth at most.
EVIDENCE = 100
UND = "und"
#: Keys of texts that a task remembers in order to pass copies on once.
HELD_KEYS = 1 << 20


def letter_table() -> np.ndarray:
    """Per code point of the basic plane the lower-case letter, or a blank."""
    out = np.full(0x10000, 32, np.uint16)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, flat, each text with ORDER - 1 blanks before and one after it; lengths."""
    flat = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)
    high = flat > 0xFFFF
    out = table[np.where(high, 0, flat)]
    for c in np.unique(flat[high]).tolist():  # letters beyond the basic plane are folded into it
        if chr(c).isalpha():
            out[flat == c] = 0xE020 if c & 0xFFFF == 32 else c & 0xFFFF  # never a blank
    blank = out == 32
    keep = ~(blank & np.r_[False, blank[:-1]])
    keep[np.r_[0, ends]] = True  # text borders
    total = np.cumsum(keep)
    inner = total[ends] - total[np.r_[0, ends[:-1]]]  # a text's letters and its closing blank
    body = out[keep][1:]
    # a blank at a text's start or end beside the border counts once
    starts = np.cumsum(inner) - inner
    width = inner + ORDER - 1
    at = np.cumsum(width) - width
    padded = np.full(int(width.sum()), 32, np.uint16)
    dest = np.repeat(at + ORDER - 1 - starts, inner) + np.arange(len(body))
    padded[dest] = body
    return padded, inner


def grams(padded: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each letter of the texts, packed in 64 bits."""
    p = padded.astype(np.uint64)
    packed = np.zeros(len(p), np.uint64)
    for k in range(ORDER):
        packed[ORDER - 1:] |= p[ORDER - 1 - k:len(p) - k] << np.uint64(16 * k)
    real = np.ones(len(p), bool)
    width = inner + ORDER - 1
    at = np.cumsum(width) - width
    for k in range(ORDER - 1):
        real[at + k] = False
    return packed[real]


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns lang, gram, n over all texts whose language is known."""
    table = letter_table()

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            for name, parts in held.items():
                keys, inv = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(inv, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for part in pieces(batch, text, PART_BYTES):
                own = pd.Series(part.column(text).to_pylist(), dtype=object)
                for name, texts in own.groupby(part.column(lang).to_pandas()):
                    texts = [t for t in texts if t]
                    if texts:
                        keys, n = np.unique(grams(*normalised(texts, table)), return_counts=True)
                        held.setdefault(name, []).append((keys, n))
                        size += len(keys)
                if size > HELD_GRAMS:
                    yield from out()
                    size = 0
        yield from out()

    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Seen:
    """What the models know of some n-grams: by length the sorted n-grams, and per language log probability (NaN if the
    language has it not) and log back-off weight (0 if it never saw the context)."""

    keys: list[np.ndarray]  # index: length - 1
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray  # log probability of a letter that no text had, per language

    @classmethod
    def of(cls, found: pa.Table, unseen: np.ndarray) -> Seen:
        """From joined rows size, key, lang, logp, backoff, one for each n-gram asked for."""
        out = cls([], [], [], unseen)
        found = found.combine_chunks()
        sizes = found["size"].to_numpy()
        for size in range(1, ORDER + 1):
            rows = found.filter(pa.array(sizes == size))
            key = rows["key"].to_numpy().view(np.uint64)
            by = np.argsort(key)
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            lists = [rows[c].combine_chunks() for c in ("lang", "logp", "backoff")]
            lang, logp, backoff = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            at = np.repeat(place, pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False))
            p = np.full((len(key), len(unseen)), np.nan, np.float32)
            weight = np.zeros((len(key), len(unseen)), np.float32)
            p[at, lang], weight[at, lang] = logp, backoff
            out.keys.append(key[by])
            out.logp.append(p)
            out.backoff.append(weight)
        return out

    def _rows(self, key: np.ndarray, size: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys[size - 1], key), len(self.keys[size - 1]) - 1)
        if (self.keys[size - 1][at] != key).any():
            raise ValueError("a block's texts changed between asking for their n-grams and scoring them")
        return at

    def logs(self, packed: np.ndarray) -> np.ndarray:
        """Log probability of the last letter of each 4-gram, per language."""
        out = np.broadcast_to(self.unseen.astype(np.float32), (len(packed), len(self.unseen)))
        if not len(packed):
            return out
        for size in range(1, ORDER + 1):
            own = self.logp[size - 1][self._rows(packed & _mask(size), size)]
            if size > 1:  # not seen in this language: its context's weight and the shorter n-gram
                out = self.backoff[size - 2][self._rows((packed >> np.uint64(16)) & _mask(size - 1), size - 1)] + out
            out = np.where(np.isnan(own), out, own)
        return out


def asked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and keys of all n-grams and contexts that scoring distinct 4-grams needs."""
    sizes, keys = [], []
    for size in range(1, ORDER + 1):
        own = packed & _mask(size)
        if size < ORDER:
            own = np.r_[own, (packed >> np.uint64(16)) & _mask(size)]
        keys.append(pd.unique(own))
        sizes.append(np.full(len(keys[-1]), size, np.int32))
    return np.concatenate(sizes), np.concatenate(keys).view(np.int64)


@dataclass
class Models:
    """The table of all languages' n-grams: size, key, and by language number `lang` the arrays logp and backoff."""

    langs: list[str]
    table: np.ndarray
    rows: DataFrame
    unseen: np.ndarray  # log probability of a letter that no text had, per language
    limits: np.ndarray | None = None  # highest accepted cross-entropy by language and log2 of the length

    def logs(self, packed: np.ndarray) -> np.ndarray:
        """Log probability of the last letter of each 4-gram, per language."""
        size, key = asked(packed)
        keys = self.rows.sparkSession.createDataFrame(pa.table({"size": size, "key": key}))
        return Seen.of(keys.join(self.rows, ["size", "key"], "left").toArrow(), self.unseen).logs(packed)


def _mask(order: int):
    return np.uint64((1 << 16 * order) - 1)


def _low(column: str, order: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << 16 * order) - 1))


def kneser_ney(counts: DataFrame) -> tuple[list[str], DataFrame, np.ndarray]:
    """Languages, table (see Models) and unseen letters of a saved table lang, gram, n; joins and sums only."""
    orders = [counts.select("lang", "gram", F.col("n").cast("long"))]
    for order in range(ORDER - 1, 0, -1):  # distinct left neighbours
        orders.append(orders[-1].groupBy("lang", _low("gram", order).alias("gram")).agg(F.count("*").alias("n")))
    every = None
    for order, t in zip(range(ORDER, 0, -1), orders):
        t = t.select(F.lit(order).alias("size"), "*")
        every = t if every is None else every.unionByName(t)
    every = saved(every)
    steps = every.groupBy("size", "lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
    d = F.when(F.col("once") > 0, F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.5)
    steps = steps.select("size", "lang", F.greatest(F.lit(0.1), F.least(F.lit(0.9), d)).alias("d"))
    langs = sorted(r[0] for r in steps.filter("size = 1").select("lang").collect())
    if not langs:
        return [], every, np.zeros(0)
    letters = every.filter("size = 1").select("gram").distinct().count()
    every = every.withColumn("context", F.shiftrightunsigned("gram", 16))
    contexts = every.groupBy("size", "lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    contexts = saved(contexts.join(F.broadcast(steps), ["size", "lang"])
                     .select("size", "lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("gamma")))
    own = every.join(contexts, ["size", "lang", "context"]).select(
        "size", "lang", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"), "gamma")
    own = saved(own)
    lower, rows = None, []
    for order in range(1, ORDER + 1):
        t = own.filter(F.col("size") == order)
        if order == 1:
            p = t.select("lang", "gram", (F.col("own") + F.col("gamma") / (letters + 1)).alias("p"))
        else:
            below = lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("q"))
            p = (t.withColumn("short", _low("gram", order - 1)).join(below, ["lang", "short"])
                 .select("lang", "gram", (F.col("own") + F.col("gamma") * F.col("q")).alias("p")))
        lower = p
        rows.append(p.select(F.lit(order).alias("size"), F.col("gram").alias("key"), "lang",
                             F.log("p").cast("float").alias("logp"), F.lit(None).cast("float").alias("backoff")))
    rows.append(contexts.filter("size > 1").select(
        (F.col("size") - 1).alias("size"), F.col("context").alias("key"), "lang",
        F.lit(None).cast("float").alias("logp"), F.log("gamma").cast("float").alias("backoff")))
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    number = counts.sparkSession.createDataFrame(list(zip(langs, range(len(langs)))), "lang string, at int")
    table = table.groupBy("size", "key", "lang").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff"))
    table = table.join(F.broadcast(number), "lang").groupBy("size", "key").agg(F.collect_list(F.struct(
        "at", F.coalesce("logp", F.lit(float("nan")).cast("float")).alias("logp"),
        F.coalesce("backoff", F.lit(0).cast("float")).alias("backoff"))).alias("s"))
    table = saved(table.select("size", "key", F.col("s.at").alias("lang"), F.col("s.logp").alias("logp"), F.col("s.backoff").alias("backoff")))
    gamma = dict(contexts.filter("size = 1").select("lang", "gamma").collect())
    return langs, table, np.log(np.array([gamma[name] for name in langs]) / (letters + 1))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Models | None:
    """Models of the texts, without limits; None if there are no texts with a language."""
    langs, rows, unseen = kneser_ney(saved(gram_counts(docs, text, lang)))
    return Models(langs, letter_table(), rows, unseen) if langs else None


def fit(docs: DataFrame, trains: Column | None = None, text: str = "text", lang: str = "lang") -> Models | None:
    """Models of the texts for which `trains` holds, with their limits; None if there are none."""
    train = docs.filter(trains) if trains is not None else docs
    models = learn(train, text, lang)
    if models is not None:
        _set_limits(models, saved(_scored(train, models, text)), train, text, lang)
    return models


def _set_limits(models: Models, answers: DataFrame, train: DataFrame, text: str, lang: str) -> None:
    known = train.filter(F.col(lang).isNotNull()).select(*_key(F.col(text)))
    models.limits = _limits(known.join(answers, KEY), models.langs)


def _limits(found: DataFrame, langs: list[str]) -> np.ndarray:
    """Highest accepted cross-entropy per language for texts of 2**k to 2**(k+1) letters, from scored training texts."""
    seen = found.filter("letters > 0").groupBy("lang_pred", F.floor(F.log2("letters")).cast("int").alias("k")).agg(
        F.count("*").alias("n"), F.avg("entropy").alias("m"), F.stddev_pop("entropy").alias("s")).toPandas()
    out = np.full((len(langs), 64), np.nan)
    for r in seen[seen.n >= LEAST_TEXTS].itertuples():
        out[langs.index(r.lang_pred), r.k] = r.m + REJECT_SD * r.s + REJECT_MARGIN
    for row in out:
        own = np.flatnonzero(~np.isnan(row))
        if len(own):
            row[:] = row[own[np.abs(np.arange(64)[:, None] - own).argmin(axis=1)]]
    known = ~np.isnan(out[:, 0])
    out[~known] = out[known].max(axis=0) if known.any() else np.inf
    return out


def _judged(found: DataFrame, models: Models | None) -> DataFrame:
    """Scored texts, also rejected where the cross-entropy is above the limit."""
    if models is None or models.limits is None:
        return found
    limits = found.sparkSession.createDataFrame(pd.DataFrame({
        "lang_pred": np.repeat(models.langs, 64), "language_octave": np.tile(np.arange(64, dtype=np.int32), len(models.langs)),
        "language_limit": models.limits.ravel()}), "lang_pred string, language_octave int, language_limit double")
    both = found.withColumn("language_octave", F.floor(F.log2("letters")).cast("int")).join(
        F.broadcast(limits), ["lang_pred", "language_octave"], "left")
    over = F.coalesce(F.col("entropy") > F.col("language_limit"), F.lit(False))
    return both.withColumn("rejected", F.col("rejected") | over).select(*found.columns)


KEY = ["text_a", "text_b"]


def _key(text: Column) -> list[Column]:
    """128 bits of a text, as columns named KEY."""
    text = F.coalesce(text, F.lit(""))
    return [c.alias(n) for c, n in zip((F.xxhash64(text), F.xxhash64(F.lit(1), text)), KEY)]


def _once(batches):
    """Rows whose text the task has not passed on before."""
    seen: set = set()
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in KEY)))
        fresh = np.zeros(len(keys), bool)
        for i, k in enumerate(keys):
            if k not in seen:
                fresh[i] = True
                if len(seen) < HELD_KEYS:
                    seen.add(k)
        yield batch.filter(pa.array(fresh))


def _blocks(docs: DataFrame, text: str) -> DataFrame:
    """Distinct texts: block, key, text. Copies meet one per task, and one by one, before the blocks are formed."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    keyed = docs.select(*_key(F.col(text)), F.coalesce(text, F.lit("")).alias("text"))
    one = keyed.mapInArrow(_once, keyed.schema)
    block = F.pmod(F.col(KEY[0]), F.lit(max(1, -(-size // BLOCK_BYTES)))).alias("block")
    return one.select(block, "*").repartition("block").groupBy("block", *KEY).agg(F.first("text").alias("text"))


def _scored(docs: DataFrame, models: Models, text: str) -> DataFrame:
    """Per distinct text its key, lang_pred, score, rejected, entropy and letters."""
    schema = f"{KEY[0]} long, {KEY[1]} long, lang_pred string, score double, rejected boolean, entropy double, letters long"
    table, langs, unseen = models.table, models.langs, models.unseen

    def ask(block: pa.Table) -> pa.Table:
        held = np.zeros(0, np.uint64)
        for part in _parts(block):
            held = pd.unique(np.r_[held, pd.unique(grams(*normalised(part.column("text").to_pylist(), table)))])
        size, key = asked(held)
        return pa.table({"block": np.full(len(size), block["block"][0].as_py(), np.int64), "size": size, "key": key})

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        seen = Seen.of(found, unseen)
        every = seen.logs(seen.keys[ORDER - 1])
        out = []
        for part in _parts(block):
            padded, inner = normalised(part.column("text").to_pylist(), table)
            packed = grams(padded, inner)
            at, own = pd.factorize(packed)
            logs = every[seen._rows(own, ORDER)]
            ends = np.cumsum(inner)
            letters = np.diff(np.r_[0, np.cumsum((packed & _mask(1)) != 32)][np.r_[0, ends]])
            h = np.stack([-np.add.reduceat(logs[at, j], ends - inner, dtype=np.float64) / inner for j in range(len(langs))], axis=1)
            best = h.argmin(axis=1)
            low = h[np.arange(len(h)), best]
            worth = np.minimum(letters, EVIDENCE)[:, None]
            share = 1 / np.exp(-(h - low[:, None]) * worth).sum(axis=1)
            ok = letters > 0
            out.append(pa.table({
                **{c: part.column(c) for c in KEY}, "lang_pred": pa.array(np.where(ok, np.array(langs, object)[best], UND), pa.string()),
                "score": np.where(ok, share, 0.0), "rejected": ~ok, "entropy": low, "letters": letters.astype(np.int64)}))
        return pa.concat_tables(out)

    blocks = _blocks(docs, text)
    keys = blocks.groupBy("block").applyInArrow(ask, "block long, size int, key long")
    found = keys.join(models.rows, ["size", "key"], "left").select("block", "size", "key", "lang", "logp", "backoff")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)


def _parts(block: pa.Table):
    for batch in block.to_batches():
        yield from pieces(batch, "text", PART_BYTES)


def _joined(docs: DataFrame, answers: DataFrame | None, text: str) -> DataFrame:
    """docs with the answers for their texts; columns of the same names are replaced."""
    names = {"lang_pred": "string", "score": "double", "rejected": "boolean", "entropy": "double", "letters": "long"}
    kept = [c for c in docs.columns if c not in names]
    if answers is None:  # nothing was learned
        none = dict(zip(names, (F.lit(UND), F.lit(0.0), F.lit(True), F.lit(None), F.lit(0))))
        return docs.select(*kept, *[none[n].cast(t).alias(n) for n, t in names.items()])
    own = docs.select(F.struct(*[F.col(c) for c in kept]).alias("doc"), *_key(F.col(text)))
    return own.join(answers, KEY).select("doc.*", *names)


def identify(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, rejected, entropy (nats per character) and letters."""
    answers = None if models is None else _judged(_scored(docs, models, text), models)
    return _joined(docs, answers, text)


def _learned_answers(docs: DataFrame, trains: Column, text: str, lang: str) -> DataFrame | None:
    """The judged answers for all texts, by models of the docs for which `trains` holds; every text is scored once."""
    train = docs.filter(trains)
    models = learn(train, text, lang)
    if models is None:
        return None
    answers = saved(_scored(docs, models, text))
    _set_limits(models, answers, train, text, lang)
    return _judged(answers, models)


def learn_and_identify(docs: DataFrame, trains: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """As `identify` with models of the docs for which `trains` holds."""
    return _joined(docs, _learned_answers(docs, trains, text, lang), text)


def accepted(docs: DataFrame, trains: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """The docs whose language those models accept, with their own columns."""
    answers = _learned_answers(docs, trains, text, lang)
    if answers is None:
        return docs.limit(0)
    names = [f"__accepted_{c}" for c in KEY]
    keys = answers.filter("not rejected").select(*[F.col(c).alias(n) for c, n in zip(KEY, names)])
    same = [k == F.col(n) for k, n in zip(_key(docs[text]), names)]
    return docs.join(keys, same, "left_semi")


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = learn_and_identify(docs, ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
