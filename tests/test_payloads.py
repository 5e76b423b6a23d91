"""Payload splitting and decoding against Python's own pattern search and decoder."""

import random
import re

from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions.text import BLANKS
from fwlog.operators.parse import parse
from fwlog.sources.files import decoded

FIELD = re.compile(r"(?<![A-Za-z_])([A-Za-z_]+\(\d+\))=([^;]*)")
PLAIN = {k: c for k, c in vocab.FIELD_COLUMNS.items() if c not in vocab.ADDRESS_COLUMNS}


def test_payloads_against_a_pattern_search(spark):
    rnd = random.Random(11)
    keys = [*rnd.sample(sorted(PLAIN), 8), "Foo(1)", "Bar(22)", "x(٣)", "Protocol(1001)"]
    before = ["", "", "", " ", " ", "x ", "=", "a(1", "é", "1", "_", "\t"]
    values = ["", "v", " v ", "a=b", "Foo(1)=z", "　w ", "--", "x y", "ü", "\x1c"]
    lines = []
    for i in range(4000):
        text = rnd.choice([";", " ;", ";;"]).join(
            rnd.choice(before if rnd.random() < 0.3 else [""]) + rnd.choice(keys) + rnd.choice(["=", "=", "=", " =", "", "=="]) + rnd.choice(values)
            for _ in range(rnd.randrange(1, 7)))
        lines.append((i, text))
    columns = sorted(set(PLAIN.values()))
    got = parse(spark.createDataFrame(lines, "id long, value string").repartition(4)).select("id", "reason", "extras", *columns)
    for r in got.collect():
        pairs = {k: v.strip(BLANKS) for k, v in FIELD.findall(lines[r.id][1].strip(BLANKS))}
        known = {c: pairs[k] for k, c in PLAIN.items() if k in pairs}
        assert {c: r[c] for c in columns if r[c] is not None} == known, lines[r.id]
        if known:
            assert r.reason is None
            assert r.extras == {vocab.UNKNOWN_KEY_PREFIX + k: v for k, v in pairs.items() if k not in vocab.FIELD_COLUMNS}


def test_decoding_against_python(spark):
    rnd = random.Random(4)
    parts = [b"a", b" ", "é".encode(), "語".encode(), "😀".encode(), b"\x80", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xf4\x90",
             b"\xc0\xaf", b"\xff", b"\xf8\x88", b"\xe0\x9f", b"\x1f"]
    rows = [(i, bytearray(b"".join(rnd.choices(parts, k=rnd.randrange(12))))) for i in range(5000)]
    rows += [(5000 + i, bytearray(rnd.randbytes(rnd.randrange(1, 9)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, data binary")
    got = {r.id: r.text for r in df.select("id", decoded(F.col("data")).alias("text")).collect()}
    for i, data in rows:
        assert got[i] == bytes(data).decode("utf-8", "replace").strip(BLANKS), bytes(data)
