"""Lines of single requests."""

from pyspark.sql import functions as F

from fwlog.sources.requests import bulk_lines, raw_line


def test_only_texts_that_open_with_a_brace_are_read_as_json(spark):
    cases = {' \t\r\n{"raw": "x"}': "x", '{"other": 1}': "", "{broken": "{broken", "[1,2]": "[1,2]", '"text"': '"text"', "﻿{}": "﻿{}", "": "", "{}": ""}
    df = spark.createDataFrame([(c,) for c in cases], "body string").repartition(2).select("body", raw_line(F.col("body")).alias("line"))
    assert "CASE WHEN RLIKE(body" in df._jdf.queryExecution().optimizedPlan().toString().split("parseJson")[0]
    assert {r.body: r.line for r in df.collect()} == cases


def test_bulk_bodies_are_read_once(spark):
    """The steps that make the bodies are not run for each line, nor a body read again for the filters of its lines."""
    cases = {1: '{"lines": ["Protocol(1001)=TCP", "b", null]}', 2: "not json", 3: '{"lines": []}', 4: "[1]", 5: '{"lines": "x"}', 6: None}
    lines = spark.createDataFrame([(k, c) for k, c in cases.items() for _ in range(3)] + [(None, '{"lines": ["c"]}')], "request_id int, body string")
    requests = lines.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.max("body").alias("body"))
    made = bulk_lines(requests.select("request_id", F.when(F.col("n") > 0, F.col("body")).alias("body")).unionByName(
        lines.select("request_id").distinct().select((-F.col("request_id")).alias("request_id"), F.lit('{"lines": ["d"]}').alias("body"))))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1  # the text of the other side is read when planned
    found = sorted(((r.request_id, r["index"], r.value) for r in made.collect()), key=str)
    want = [(1, 0, "Protocol(1001)=TCP"), (1, 1, "b"), (1, 2, None), (None, 0, "c"), (None, 0, "d"), *[(-k, 0, "d") for k in cases]]
    assert found == sorted(want, key=str)
