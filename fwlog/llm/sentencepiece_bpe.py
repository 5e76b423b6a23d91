"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut at its blanks into words; no piece of the vocabulary reaches over a blank's
left side, so words are independent. The distinct words of a slice are laid out as one
flat symbol array. In a round every word finds its smallest pair rank by a segmented
minimum, merges all leftmost occurrences of it at once, and the array is compacted; words
without a pair are done. Simultaneous merges equal the library's one-by-one order unless
a merge creates a pair that would come before the word's next merge; such a word merges
only its leftmost pair in that round. Runs of blanks all tie at the lowest rank and close
from the left into the longest blank pieces, which is done in one step.

Edge cases: null text counts as empty; the empty text has no ids; repeated rows and ties
give equal results; whole texts are encoded, whatever their length; existing columns named
like the outputs are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from fwlog.llm._batches import out_schema, pieces, ragged, with_columns

BLANK = "▁"
NONE = np.int32(2**31 - 1)
#: Distinct words whose pieces a worker remembers before it starts afresh, and the longest of them.
CACHED_WORDS, CACHED_CHARS = 400_000, 4_000_000


@dataclass
class Pieces:
    """Vocabulary tables; all arrays are bounded by the vocabulary."""

    chars: np.ndarray  # code point -> symbol, -1 if no piece has it
    keys: np.ndarray  # sorted left * n + right of every pair that makes a piece
    ranks: np.ndarray  # its rank: 0 merges first, equal scores have equal ranks
    made: np.ndarray  # the piece it makes
    n_symbols: int
    n_ids: int
    byte_ids: np.ndarray  # id of each byte's piece, all unk_id without byte fallback
    byte_fallback: bool
    unk_id: int
    blank_id: int  # piece of one blank
    blank_long: int  # blanks of the longest blank piece, which every run of that length makes
    blank_long_id: int
    tails: np.ndarray  # ids of shorter runs, one run after the other
    tail_starts: np.ndarray  # by run length
    tail_lengths: np.ndarray
    text: np.ndarray  # bytes of all pieces as decoded
    starts: np.ndarray
    lengths: np.ndarray
    blank_first: np.ndarray  # piece starts with a blank
    is_byte: np.ndarray
    prefix: bool


def load(path: str) -> Pieces:
    """Tables of a SentencePiece BPE model with identity normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if (model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces
            or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix):
        raise ValueError("only BPE models with identity normalisation are read")
    kinds = type(model.pieces[0])
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
    if any(BLANK in p.lstrip(BLANK) or (p[:2] == BLANK * 2 and set(p) != {BLANK}) for p in ids):
        raise ValueError("a piece reaches over a blank")
    if any(model.pieces[i].score != min(x.score for x in model.pieces) for p, i in ids.items()
           if set(p) == {BLANK} and len(p) > 1):
        raise ValueError("blank pieces do not come last")
    symbols = dict(ids)
    for p in list(ids):
        for c in p:  # characters that occur in pieces only
            symbols.setdefault(c, len(model.pieces) + len(symbols) - len(ids))
    n = len(model.pieces) + len(symbols) - len(ids)
    order = {s: r for r, s in enumerate(sorted({-model.pieces[i].score for i in ids.values()}))}
    pairs = {}
    for p, i in ids.items():
        if set(p) == {BLANK}:
            continue  # closed in one step
        for k in range(1, len(p)):
            a, b = symbols.get(p[:k]), symbols.get(p[k:])
            if a is not None and b is not None:
                pairs[a * n + b] = (order[-model.pieces[i].score], i)
    keys = np.array(sorted(pairs), np.int64)
    chars = np.full(0x110000, -1, np.int32)
    for s, i in symbols.items():
        if len(s) == 1:
            chars[ord(s)] = i
    fallback = model.trainer_spec.byte_fallback
    unk = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
    byte_ids, texts, is_byte = np.full(256, unk, np.int32), [], np.zeros(len(model.pieces), bool)
    for i, p in enumerate(model.pieces):
        if p.type == kinds.BYTE:
            byte = int(p.piece[3:5], 16)
            byte_ids[byte], is_byte[i] = i, True
            texts.append(bytes([byte]))
        elif p.type == kinds.CONTROL:
            texts.append(b"")
        elif p.type == kinds.UNKNOWN:
            texts.append(model.trainer_spec.unk_surface.encode())
        else:
            texts.append(p.piece.replace(BLANK, " ").encode())
    lengths = np.array([len(t) for t in texts], np.int64)
    sizes = {len(p) for p in ids if set(p) == {BLANK}}
    most = max(sizes)
    if any(_close(most * q + r, sizes) != [most] * q + _close(r, sizes) for q in (1, 2, 3) for r in range(most)):
        raise ValueError("long runs of blanks do not close piece by piece")
    tails = [[ids[BLANK * k] for k in _close(r, sizes)] for r in range(most)]
    tail_lengths = np.array([len(x) for x in tails], np.int64)
    return Pieces(
        chars, keys, np.array([pairs[k][0] for k in keys], np.int32), np.array([pairs[k][1] for k in keys], np.int32),
        n, len(model.pieces), byte_ids, fallback, unk, ids[BLANK], most, ids[BLANK * most],
        np.array([i for x in tails for i in x], np.int32), np.cumsum(tail_lengths) - tail_lengths, tail_lengths,
        np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths,
        np.array([p.piece.startswith(BLANK) for p in model.pieces]), is_byte, norm.add_dummy_prefix,
    )


def _close(run: int, sizes: set[int]) -> list[int]:
    """Lengths of the pieces that a run of blanks ends in: the leftmost possible merge, again and again."""
    parts = [1] * run
    while (i := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in sizes), None)) is not None:
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def _ranks(t: Pieces, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and piece of each pair of symbols; NONE where the pair makes no piece."""
    key = left.astype(np.int64) * t.n_symbols + right
    at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    hit = (t.keys[at] == key) & (left >= 0) & (right >= 0)
    return np.where(hit, t.ranks[at], NONE), t.made[at]


def _leftmost(chosen: np.ndarray) -> np.ndarray:
    """Every other position of each run of chosen positions, from its left end."""
    at = np.flatnonzero(chosen)
    if len(at) < 2:
        return at
    first = np.r_[True, np.diff(at) > 1]
    run = at[first][np.cumsum(first) - 1]
    return at[(at - run) % 2 == 0]


def merge_rounds(t: Pieces, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words after their merges, and where each word starts.

    symbols: flat array, negative for characters no piece has. starts: first index of
    each word, ascending; no word is empty.
    """
    n_words = len(starts)
    sym = symbols.astype(np.int32)
    word = np.repeat(np.arange(n_words), np.diff(np.r_[starts, len(sym)]))
    done_sym, done_word = [], []

    def pairs(s, w):
        rank, made = _ranks(t, s[:-1], s[1:])
        return np.r_[np.where(w[:-1] == w[1:], rank, NONE), NONE], np.r_[made, 0]

    rank, made = pairs(sym, word)
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(sym)])
        least = np.repeat(np.minimum.reduceat(rank, first), size)
        live = least < NONE
        if not live.all():
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            sym, word, rank, made, least = sym[live], word[live], rank[live], made[live], least[live]
            if not len(sym):
                break
        at = _leftmost(rank == least)
        new = made[at]
        # pairs that one-by-one merging would see beside each merge
        merged = sym.copy()
        merged[at] = new
        gone = np.zeros(len(sym), bool)
        gone[at + 1] = True
        before = np.maximum(at - 1, 0)
        before = np.where(gone[before], np.maximum(at - 2, 0), before)
        after = np.minimum(at + 2, len(sym) - 1)
        lr, _ = _ranks(t, merged[before], new)
        rr, _ = _ranks(t, new, sym[after])
        lr = np.where((before < at) & (word[before] == word[at]), lr, NONE)
        rr = np.where((after == at + 2) & (word[after] == word[at]), rr, NONE)
        early = np.minimum(lr, rr) <= least[at]
        if early.any():
            alone = np.isin(word[at], word[at][early])
            head = np.r_[True, word[at][1:] != word[at][:-1]]
            keep = ~alone | head
            at, new = at[keep], new[keep]
        sym[at] = new
        kept = np.ones(len(sym), bool)
        kept[at + 1] = False
        place = np.cumsum(kept) - 1
        sym, word, rank, made = sym[kept], word[kept], rank[kept], made[kept]
        now = place[at]
        for i in (now, np.maximum(now - 1, 0)):
            j = np.minimum(i + 1, len(sym) - 1)
            r, m = _ranks(t, sym[i], sym[j])
            rank[i] = np.where((j > i) & (word[i] == word[j]), r, NONE)
            made[i] = m
    sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
    order = np.argsort(word, kind="stable")
    return sym[order], np.searchsorted(word[order], np.arange(n_words))


class Encoder:
    """Encodes and decodes texts; remembers the pieces of a bounded number of words."""

    def __init__(self, tables: Pieces):
        self.t = tables
        self._forget()

    def _forget(self):
        self.slots, self.chars = {}, 0
        self.ids = np.empty(1 << 16, np.int32)
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)
        self.bare = np.empty(1 << 14, bool)
        self.n_ids = self.n_words = 0

    def _learn(self, words: list[str]):
        """Pieces of new words, each with one blank before it."""
        t = self.t
        flat = np.frombuffer("".join(BLANK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(sizes) - sizes
        first = t.chars[flat]
        hidden = first < 0  # carried as ~code point through the merges
        sym, at = merge_rounds(t, np.where(hidden, ~flat.astype(np.int32), first), starts)
        alone = np.r_[at[1:], len(sym)] - at
        bare = sym[at] == t.blank_id
        unknown = (sym < 0) | (sym >= t.n_ids)
        if unknown.any():
            sym, alone = self._bytes(sym, unknown, at, alone)
        self._grow(len(sym), len(words))
        n, w = self.n_ids, self.n_words
        self.ids[n:n + len(sym)] = sym
        self.starts[w:w + len(words)] = n + np.cumsum(alone) - alone
        self.lengths[w:w + len(words)] = alone
        self.bare[w:w + len(words)] = bare
        self.slots.update(zip(words, range(w, w + len(words))))
        self.n_ids, self.n_words, self.chars = n + len(sym), w + len(words), self.chars + len(flat)

    def _bytes(self, sym, unknown, at, sizes):
        """Characters that no piece has become byte pieces, or the unknown id."""
        t = self.t
        back = {int(t.chars[c]): c for c in np.flatnonzero(t.chars >= t.n_ids)}
        put = []
        width = np.ones(len(sym), np.int64)
        for i in np.flatnonzero(unknown):
            c = ~int(sym[i]) if sym[i] < 0 else back[int(sym[i])]
            own = t.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] if t.byte_fallback else np.array([t.unk_id], np.int32)
            put.append(own)
            width[i] = len(own)
        out = np.repeat(sym, width)
        mask = np.repeat(unknown, width)
        out[mask] = np.concatenate(put)
        return out, np.add.reduceat(width, at)

    def _grow(self, ids: int, words: int):
        while self.n_ids + ids > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while self.n_words + words > len(self.starts):
            self.starts, self.lengths, self.bare = (np.resize(a, 2 * len(a)) for a in (self.starts, self.lengths, self.bare))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and how many each text has."""
        words, runs, owner = [], [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            parts = text.replace(" ", BLANK).split(BLANK)
            if not self.t.prefix:
                raise ValueError("models without a blank in front are not supported")
            if "" in parts:
                own, run = [], 0
                for p in parts:
                    run += 1
                    if p:
                        own.append(p)
                        runs.append(run)
                        run = 0
                if run:
                    own.append("")
                    runs.append(run)
                parts = own
            else:
                runs.extend([1] * len(parts))
            words.extend(parts)
            owner.append((k, len(parts)))
        counts = np.zeros(len(texts), np.int64)
        if not words:
            return np.empty(0, np.int32), counts
        if self.n_words > CACHED_WORDS or self.chars > CACHED_CHARS:
            self._forget()
        new = list(set(words).difference(self.slots))
        if new:
            self._learn(sorted(new))
        slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        run = np.array(runs, np.int64)
        starts, lengths, bare = self.starts[slot], self.lengths[slot], self.bare[slot]
        odd = run > 1
        if not odd.any():
            flat, size = self.ids[ragged(starts, lengths)], lengths
        else:  # the word's own blank joins the run before it unless a piece has taken it
            starts, lengths = starts + (odd & bare), lengths - (odd & bare)
            blanks = np.where(odd, run - ~bare, 0)
            whole, rest = blanks // self.t.blank_long, blanks % self.t.blank_long
            tail = self.t.tail_lengths[rest]
            size = whole + tail + lengths
            flat = np.empty(int(size.sum()), np.int32)
            end = np.cumsum(size)
            flat[ragged(end - lengths, lengths)] = self.ids[ragged(starts, lengths)]
            flat[ragged(end - size, whole)] = self.t.blank_long_id
            flat[ragged(end - lengths - tail, tail)] = self.t.tails[ragged(self.t.tail_starts[rest], tail)]
        which = np.array([k for k, _ in owner])
        per = np.array([n for _, n in owner])
        counts[which] = np.add.reduceat(size, np.cumsum(per) - per)
        return flat, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of flat ids with so many ids each."""
        t = self.t
        starts, lengths = t.starts[ids], t.lengths[ids].copy()
        ends = np.cumsum(counts)
        first = (ends - counts)[counts > 0]
        if t.prefix and len(first):
            cut = t.blank_first[ids[first]]
            starts[first] += cut
            lengths[first] -= cut
        data = t.text[ragged(starts, lengths)]
        total = np.r_[0, np.cumsum(lengths)][np.r_[0, ends]]
        raw = data.tobytes()
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return pa.array([_lenient(raw[a:b]) for a, b in zip(total[:-1], total[1:])], pa.string())
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(total.astype(np.int32).tobytes()), pa.py_buffer(raw))


def _lenient(raw: bytes) -> str:
    """UTF-8 with one replacement character for every byte that fits nowhere."""
    out, i = [], 0
    while i < len(raw):
        try:
            out.append(raw[i:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(raw[i:i + e.start].decode("utf-8") + "�")
            i += e.start + 1
    return "".join(out)


def encode_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of every text and the text that they decode to."""
    tables = load(model_path)

    def run(batches):
        coder = Encoder(tables)
        for batch in batches:
            for part in pieces(batch, text):
                texts = [x or "" for x in part.column(text).to_pylist()]
                flat, counts = coder.encode(texts)
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                yield with_columns(part, **{ids: pa.ListArray.from_arrays(offsets, pa.array(flat)), decoded: coder.decode(flat, counts)})

    return df.mapInArrow(run, out_schema(df, **{ids: ArrayType(IntegerType()), decoded: StringType()}))


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """Counts and digests of the ids and decoded texts, beside the columns to keep."""
    return encoded.select(
        *keep,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode_decode(docs, model_path()), "doc_id")
