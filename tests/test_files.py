import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fwlog.functions import crypto
from fwlog.operators.admission import admit_tumbling
from fwlog.plans import fixtures as fx
from fwlog.plans.translate import translate, translate_file
from fwlog.sinks.writers import read_encrypted, write_encrypted

LINES = b"""SrcIPAddr(1003)=1.1.1.1;Protocol(1001)=TCP

garbage \xff line
 Protocol(1001)=UDP;DstPort(1008)=53\t
SrcPort(1004)=5
"""


def test_translate_file(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    with open(f"{folder}/in.log", "wb") as f:
        f.write(LINES)
    counts = translate_file(spark, f"{folder}/in.log", f"{folder}/out", "core", f"{folder}/dead").first()
    assert tuple(counts) == (5, 2, 3)
    assert {r["value"] for r in spark.read.text(f"{folder}/out").collect()} == {
        "proto=TCP src=1.1.1.1 action=unknown", "proto=UDP dport=53 action=unknown",
    }
    dead = spark.read.text(f"{folder}/dead").collect()
    assert [r["value"].split(" | ")[1:] for r in dead] == [["no_recognized_fields", "garbage � line"]]
    assert glob.glob(os.path.join(folder, "dead", "failed_date=*"))


def test_encrypted_table(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    df = spark.range(20).select(F.concat(F.lit("m"), "id").alias("message"))
    write_encrypted(df, f"{folder}/sealed", "a real passphrase")
    back = read_encrypted(spark, f"{folder}/sealed", "a real passphrase")
    assert sorted(r[0] for r in back.collect()) == sorted(r[0] for r in df.collect())


def test_source_cap_is_limited_below_the_shuffle(spark):
    plan = admit_tumbling(fx.traffic(spark, "/root/testdata/sf0.001"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_translate_export_in_one_parse(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    rows = ['Timestamp,Hostname,RawData', 't,h,"Protocol(1001)=TCP"', "", 't,h,"nothing"', "short,x", "Protocol(1001)=UDP"]
    with open(f"{folder}/in.csv", "w") as f:
        f.write("\n".join(rows) + "\n")
    counts = translate_file(spark, f"{folder}/in.csv", f"{folder}/out", "core", f"{folder}/dead").first()
    assert tuple(counts) == (6, 2, 4)
    assert sorted(r["value"] for r in spark.read.text(f"{folder}/out").collect()) == [
        "proto=TCP action=unknown", "proto=UDP action=unknown"]
    dead = sorted(r["value"].split(" | ", 1)[1] for r in spark.read.text(f"{folder}/dead").collect())
    assert dead == sorted([
        "no_recognized_fields | nothing", 'csv_payload_unparsable | t,h,"nothing"',
        "no_recognized_fields | short,x", "csv_insufficient_fields | short,x"])


def test_filters_on_given_columns_reach_the_scan(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    fx.session_lines(spark, "/root/testdata/sf0.001").write.parquet(f"{folder}/in")
    done = translate(spark.read.parquet(f"{folder}/in"), "core")
    found = done.filter("reason is null and message is not null and msg_id < 300")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(msg_id,300)" in plan
    assert plan.count("regexp_extract_all") <= done._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all")
    assert found.count() == done.filter("msg_id < 300").filter("message is not null").count()


def test_no_secret_in_a_plan(spark):
    keys = crypto.key_table(spark, {"a": "first passphrase", "b": "second passphrase"})
    rows = spark.range(40).select("id", F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"))
    sealed = crypto.encrypt(rows, keys, "text", "data", F.col("k"), F.col("id"))
    plan = sealed._jdf.queryExecution().toString()
    for k, p in (("a", "first passphrase"), ("b", "second passphrase")):
        secret = bytes(crypto.secret_of(k, p))
        assert p not in plan and secret.hex() not in plan.lower().replace(" ", "")
    folder = tempfile.mkdtemp(prefix="run-")
    sealed.drop("text").write.parquet(f"{folder}/sealed")
    stored = spark.read.parquet(f"{folder}/sealed")
    assert stored.select("data").distinct().count() == 40
    back = crypto.decrypt(stored, keys, "data", "text", F.col("k"), F.col("id"))
    assert sorted((r.id, r.text) for r in back.collect()) == sorted((r.id, r.text) for r in rows.collect())
    moved = stored.withColumn("id", F.col("id") + 2)  # bound to its row
    with pytest.raises(Exception):
        crypto.decrypt(moved, keys, "data", "text", F.col("k"), F.col("id")).collect()
    with pytest.raises(Exception):
        crypto.encrypt(rows, keys, "text", "data", "c").collect()
    with pytest.raises(ValueError):
        crypto.key_table(spark, {"a": "changeme"})
