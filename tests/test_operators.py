import ipaddress
import random

from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions import net, render
from fwlog.operators import addresses, admission
from fwlog.plans import fixtures as fx
from fwlog.sources import lists

SMALL = "/root/testdata/sf0.001"


def _record(spark, **values):
    columns = [*vocab.RECORD_COLUMNS, "_csv_timestamp"]
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([tuple(values.get(c) for c in columns)], schema)


def _text(spark, mode, **values):
    return render.add_message(_record(spark, **values), mode).first()["message"]


def test_formats(spark):
    base = dict(proto="TCP", src="10.1.1.10", dst="8.8.8.8", sport="52314", dport="443", action="permit")
    assert _text(spark, "core", **base, app="x") == (
        "proto=TCP src=10.1.1.10 dst=8.8.8.8 sport=52314 dport=443 action=permit"
    )
    extended = _text(spark, "extended", **base, src_nat_type="Not translated", vlan_id="--")
    assert extended.endswith("src_nat_type=Not_translated") and "vlan_id" not in extended
    assert _text(spark, "core", src="1.1.1.1") is None
    cef = _text(spark, "cef", **base, app="a\\b=c\nd\0e", policy_name="P")
    assert cef.startswith("CEF:0|H3C|Comware|7.0|H3C_PERMIT|Session Permitted|3|src=10.1.1.10 ")
    assert "app=a\\\\b\\=c\\nde" in cef and "cs1Label=policyName cs1=P" in cef
    done = render.add_envelope(
        render.add_message(_record(spark, **base, _csv_timestamp="Mar 26 15:00:00"), "cef"), "cef"
    ).first()["syslog"]
    assert done.startswith("<134>Mar 26 15:00:00 h3c-firewall CEF:0|")


def _python_valid(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_addresses_agree_with_ipaddress(spark):
    rng = random.Random(7)
    texts = ["01.2.3.4", "256.0.0.1", "::", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "fe80::1%eth0",
             "1::2::3", "", ":", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "::1%", "1.2.3"]
    for _ in range(1500):
        parts = [rng.choice(["", "0", "1", "ab", "FFFF", "12345", "1.2.3.4"]) for _ in range(rng.randint(2, 9))]
        texts.append(":".join(parts))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, valid, digits in df.select("t", net.is_address(F.col("t")), net.address_hex(F.col("t"))).collect():
        want = _python_valid(t)
        assert valid == (want is not None), t
        if want is not None:
            assert int(digits, 16) == int(want), t


def test_network_list_against_ipaddress(spark):
    listed = ["10.0.0.0/9", "172.16.0.0/20", "192.168.1.7/32", "2001:db8::/32"]
    rows = spark.range(1).select(F.lit(",".join([*listed, "junk"])).alias("l"))
    data = fx.senders(spark, SMALL)
    kept = {tuple(r) for r in addresses.allowed(data, "client_ip", lists.networks(rows, "l")).collect()}
    nets = [ipaddress.ip_network(n) for n in listed]
    for row in data.collect():
        address = _python_valid(row["client_ip"])
        inside = address is not None and any(address in n for n in nets if n.version == address.version)
        assert (tuple(row) in kept) == inside, row


def test_no_valid_network_allows_all(spark):
    rows = spark.range(1).select(F.lit("junk").alias("l"))
    data = fx.senders(spark, SMALL)
    assert addresses.allowed(data, "client_ip", lists.networks(rows, "l")).count() == data.count()


def test_anchored_limit_against_brute_force(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(3000):
        t += rng.choice([0, 1000, 90_000, 400_000, 1_000_000, 3_000_000])
        rows.append((i, t, "a" if rng.random() < 0.7 else "b"))
    state, want = {}, set()
    for i, t, ip in rows:
        anchor, used = state.get(ip, (None, 0))
        if anchor is None or t - anchor >= 1_000_000:
            anchor, used = t, 0
        if used < 4:
            used += 1
            want.add(i)
        state[ip] = (anchor, used)
    df = spark.createDataFrame(rows, "msg_id long, t long, client_ip string").select(
        "msg_id", F.timestamp_micros("t").alias("recv_ts"), "client_ip"
    )
    got = {r["msg_id"] for r in admission.admit_anchored(df, limit=4).collect()}
    assert got == want


def test_long_sessions_against_brute_force(spark):
    from pyspark.sql import functions as F

    from fwlog.operators.delivery import deliver_to_sessions, session_intervals

    sessions = spark.createDataFrame(
        [("year", "2023-01-01 00:00:30", "2024-01-01 00:00:00"), ("open", "2023-12-31 23:59:59", None),
         ("short", "2023-06-01 10:00:01", "2023-06-01 10:00:02"), ("none", "2023-06-01 10:00:01", "2023-06-01 10:00:01")],
        "collector_id string, a string, b string",
    ).select("collector_id", F.col("a").cast("timestamp").alias("connected_at"), F.col("b").cast("timestamp").alias("disconnected_at"))
    messages = spark.range(0, 4000).select(
        F.col("id").alias("msg_id"), F.timestamp_seconds(F.lit(1672531200) + F.col("id") * 9001).alias("recv_ts"))
    until = F.lit("2024-03-01 00:00:00").cast("timestamp")
    assert session_intervals(sessions, until).groupBy("collector_id").count().agg(F.max("count")).first()[0] < 100
    got = deliver_to_sessions(messages, sessions, until=until).select("msg_id", "collector_id").collect()
    want = messages.join(sessions, (F.col("connected_at") <= F.col("recv_ts")) & (
        F.col("recv_ts") < F.coalesce("disconnected_at", until))).select("msg_id", "collector_id").collect()
    assert sorted(got) == sorted(want) and len(want) > 3000


def test_missing_sender_is_one_sender(spark):
    df = spark.createDataFrame([(i, i, None if i % 2 else "a") for i in range(20)], "msg_id long, t long, client_ip string").select(
        "msg_id", F.timestamp_micros("t").alias("recv_ts"), "client_ip")
    for admit in (lambda: admission.admit_tumbling(df, per_source=3), lambda: admission.admit_anchored(df, limit=3)):
        assert {r["msg_id"] for r in admit().collect()} == {0, 1, 2, 3, 4, 5}
