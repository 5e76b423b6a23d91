import random
import re

from fwlog.llm import language_id, license_scan, toxicity
from fwlog.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def brute_segments(scores):
    """Maximal scoring segments by their definition: the best segment, then both sides of it."""
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, i, j = best
    left = [(s, a, b) for s, a, b in brute_segments(scores[:i])]
    return left + [(best[0], i, j)] + [(s, a + j, b + j) for s, a, b in brute_segments(scores[j:])]


def test_segments_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-3.5, -2.25, -1.0, 1.5, 2.0, 4.125]) for _ in range(rng.randint(0, 14))]
        got = sorted((round(s, 9), a) for s, a, _ in toxicity.segments(scores))
        assert sum(s for s, _ in got) == sum(s for s, _, _ in brute_segments(scores)), scores


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().set_index("doc_id")
    found = QUERIES["op1_toxicity"](spark, SMALL).toPandas().set_index("doc_id")
    both = found.join(labels, how="inner")
    held = both[both.held_out]
    assert ((held.score >= 0) & (held.score <= 1)).all() and ((held.score >= 0.5) == (held.predicted == 1)).all()
    assert (held.predicted == held.toxic).mean() > 0.93


def test_toxicity_edges(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(8, 1), (1, 0), (2, 0), (5, 0), (None, 1), (6, None), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd_documents, labels)
    rows = toxicity.score(odd_documents.withColumnRenamed("n_chars", "score"), model).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if not (r["text"] or "").strip()}
    assert len(empty) == 1
    assert toxicity.fit(odd_documents, labels.filter("toxic = 0")) is None
    assert {r["predicted"] for r in toxicity.score(odd_documents, None).collect()} == {0}
    assert toxicity.score(no_documents, model).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().set_index("doc_id")
    found = QUERIES["op4_language_id"](spark, SMALL).toPandas().set_index("doc_id").join(docs)
    held = found[found.held_out & found.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert found.rejected.mean() < 0.01


def test_language_probabilities_sum_to_one(spark, odd_documents):
    """Interpolation spends exactly the mass of a context: over all letters and one unseen letter."""
    import numpy as np

    models = language_id.fit(odd_documents)
    letters = np.unique(np.concatenate([k & language_id._mask(1) for k in [
        language_id.grams(*language_id.normalised(["the cat and the dog ran with the bird over hill sun was out again idiot",
                                                   "der hund und die katze sind nicht mit dem vogel"], models.table))]]))
    context = language_id.grams(*language_id.normalised(["the"], models.table))[2] & np.uint64(0xFFFFFFFFFFFF)
    packed = (context << np.uint64(16)) | np.r_[letters, np.uint64(0x4E00)]
    total = np.exp(models.logs(packed).astype(float)).sum(axis=0)
    assert np.allclose(total, 1, atol=1e-3), total


def test_language_edges(odd_documents, no_documents):
    models = language_id.fit(odd_documents)
    rows = {(r["doc_id"], r["text"]): r for r in language_id.identify(odd_documents.withColumnRenamed("n_chars", "score"), models).collect()}
    for (key, text), r in rows.items():
        none = not re.search(r"[a-zA-Z]", text or "")
        assert (r["lang_pred"] == "und") == none and (not none or r["rejected"])
        assert 0 <= r["score"] <= 1
    assert language_id.fit(no_documents) is None
    assert {r["lang_pred"] for r in language_id.identify(odd_documents, None).collect()} == {"und"}


def test_language_models_keep_every_ngram(spark):
    """Against plain Kneser-Ney counts: a hundred languages, one with many 4-grams that occur once."""
    import numpy as np

    rng = random.Random(4)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    texts = {f"l{i:02}": "der hund und die katze sind nicht mit dem vogel" for i in range(99)}
    texts["many"] = "".join(rng.choice(alphabet) for _ in range(20_000))
    docs = spark.createDataFrame([(i, t, name) for i, (name, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    models = language_id.fit(docs)
    padded = "   " + texts["many"] + " "
    counts = {4: {}}
    for i in range(len(padded) - 3):
        counts[4][padded[i:i + 4]] = counts[4].get(padded[i:i + 4], 0) + 1
    for k in (3, 2, 1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    letters = len(set(texts["many"]) | set(texts["l00"]))
    discount, contexts = {}, {}
    for k, c in counts.items():
        once, twice = (sum(n == x for n in c.values()) for x in (1, 2))
        discount[k] = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
        for g, n in c.items():
            total, kinds = contexts.get((k, g[:-1]), (0, 0))
            contexts[k, g[:-1]] = total + n, kinds + 1

    def plain(g):
        lower = plain(g[1:]) if len(g) > 1 else 1 / (letters + 1)
        if (len(g), g[:-1]) not in contexts:
            return lower
        total, kinds = contexts[len(g), g[:-1]]
        return max(counts[len(g)].get(g, 0) - discount[len(g)], 0) / total + discount[len(g)] * kinds / total * lower

    asked = [padded[i:i + 4] for i in range(0, 20_000, 97)] + ["".join(rng.choice(alphabet) for _ in range(4)) for _ in range(200)]
    packed = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in asked], np.uint64)
    got = models.logs(packed)[:, models.langs.index("many")]
    assert np.allclose(got, np.log([plain(g) for g in asked]), atol=1e-4)
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, models).collect()}
    assert found[99] == "many" and {v for k, v in found.items() if k < 99} == {"l00"}


def test_language_limits_per_language(spark):
    """A language far from the others does not lift their limits; thin octaves take the nearest one; all texts count."""
    rng = random.Random(8)
    words = "the cat and dog ran with bird over hill then sun was out again".split()
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(20)), "en") for i in range(40)]
    rows += [(100 + i, "".join(rng.choice(signs) for _ in range(60)), "zh") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.fit(docs)
    noise = "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(3000))
    odd = spark.createDataFrame([(1, noise), (2, noise[:20]), (3, "the dog ran over the hill")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language_id.identify(odd, models).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["en"] * 3
    assert [found[i]["rejected"] for i in (1, 2, 3)] == [True, True, False]
    assert not any(r["rejected"] for r in language_id.identify(docs, models).collect())


def test_letters_beyond_the_basic_plane_are_no_blanks():
    padded, _ = language_id.normalised(["a\U00020020b"], language_id.letter_table())
    assert 32 not in padded[3:6]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_license_phrases_against_brute_force(spark, odd_documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text"))
    extra = [(100000, "MIT License mit license, the Apache License; cc BY-nc 4.0 GNU General Public License"), (100001, "İ MIT license")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    for r in license_scan.license_spans(docs).collect():
        words = WORD.findall((r["text"] or "").translate(LOWER))
        places = [(i, label) for phrase, label in license_scan.PHRASES for p in [phrase.split()]
                  for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)), r["doc_id"]
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base))
        assert base <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_matching_statistics_against_brute_force():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcde") for _ in range(30)) for _ in range(4)]
    automaton = license_scan.Automaton([("t", t) for t in texts], [])
    seq = [rng.choice("abcdef") for _ in range(400)]
    ids = [automaton.ids.get(w.encode(), 0) for w in seq]
    got = [n for _, n in automaton.statistics(ids)]
    padded = [f" {t} " for t in texts]
    for i, n in enumerate(got):
        want = next(k for k in range(30, -1, -1) if k <= i + 1 and (k == 0 or any(f" {' '.join(seq[i + 1 - k:i + 1])} " in t for t in padded)))
        assert n == want, i


def test_license_template_with_a_gap(spark, no_documents):
    text = dict(license_scan.TEMPLATES)["isc"].replace("hereby granted", "hereby freely granted")
    docs = spark.createDataFrame([(1, f"intro words {text} closing words")], "doc_id long, text string")
    row = license_scan.license_spans(docs).first()
    assert row["labels"] == "isc" and row["score"] > 0.9 and row["spans"][0]["start"] == 2
    assert license_scan.license_spans(no_documents).count() == 0
