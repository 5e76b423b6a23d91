from pyspark.sql import functions as F

from fwlog.functions.actions import event_action
from fwlog.operators.csvlog import parse_csv
from fwlog.operators.parse import parse
from fwlog.sinks.writers import dead_letters

BODY = "Protocol(1001)=TCP;SrcIPAddr(1003)=1.2.3.4;Event(1048)=(8)Session created"
CASES = {
    "<189>10.16.18.1 kern.info FW %%10 VsysId:1 nat/6/X: " + BODY:
        {"_pri": "189", "hostname": "FW", "_src_ip": "10.16.18.1", "_module": "nat/6/X", "action": "permit"},
    "<189>Mar  3 08:15:22 10.16.18.1 kern.info FW %%10 nat/6/X: " + BODY:
        {"_syslog_timestamp": "Mar  3 08:15:22", "hostname": "FW", "src": "1.2.3.4"},
    "<189>1 2026-03-13T16:20:09Z FW %%01 S/6/X: " + BODY:
        {"_rfc5424_ver": "1", "_syslog_timestamp": "2026-03-13T16:20:09Z", "_module": "S/6/X"},
    "10.16.18.1 %%10 nat/6/X: " + BODY: {"hostname": "10.16.18.1", "_src_ip": None},
    "<14> 10.1.1.1 some words FW-9 %%10 VsysId:3 A/5/B: " + BODY:
        {"hostname": "FW-9", "_src_ip": "10.1.1.1", "_module": "A/5/B"},
    BODY: {"hostname": None, "proto": "TCP", "reason": None},
    "RcvVPNInstance(1042)=": {"rcv_vpn": "", "action": "unknown", "reason": None},
    "SrcIPAddr(1003)=1.1.1.1;SrcIPAddr(1003)=999.1.1.1": {"src": "1.1.1.1"},
    "SrcIPAddr(1003)=1.1.1.1;SrcIPAddr(1003)=": {"src": ""},
    "DstPort(1008)=1;DstPort(1008)= 2 ;Foo(9)=a;Foo(9)=b":
        {"dport": "2", "extras": {"_raw_Foo(9)": "b"}},
    "SrcIPAddr(1003)=999.1.1.1": {"reason": "no_recognized_fields", "action": None},
    "random text": {"reason": "no_recognized_fields"},
    "  ": {"reason": "empty_line"},
    "FW %%10 WEB/5/LOGIN: admin logged in from 300.1.1.1":
        {"proto": "SYSLOG", "user": "admin", "src": None, "action": "permit", "category": "WEB"},
    "FW %%10 WEB/5/LOGOUT: admin logged out from 10.0.0.9": {"src": "10.0.0.9", "action": "close"},
    "FW %%10 SHELL/6/CMD: -Line=-IPAddr=10.1.1.1-User=bob; Command is display x":
        {"app": "CLI:unknown", "user": "bob", "_command": "display x", "action": "log"},
    "FW %%10 SHELL/6/CMD: Line=vty0 IPAddr=10.1.1.1 User=eve; Command is y": {"app": "CLI:vty0"},
    "FW %%10 IF/3/UPDOWN: Ten-GigabitEthernet1/0/1 changed to DOWN":
        {"app": "Ten-GigabitEthernet1/0/1", "_status": "DOWN"},
    "FW %%10 IF/3/UPDOWN: Ethernet1 " + "x" * 101 + " down": {"_status": None, "app": None},
    "FW %%10 AAA/3/LOGIN_FAILED: from 10.2.2.2 user: joe.,": {"user": "joe", "action": "permit"},
    "FW %%10 IF/3/LINK_UP: nothing": {"action": "log", "src": None},
    "Key" * 3000 + ";" + BODY: {"proto": "TCP"},
}


def test_vectors(spark):
    lines = list(CASES)
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    for row in parse(df).collect():
        for column, want in CASES[row["value"]].items():
            assert row[column] == want, (row["value"][:80], column, row[column], want)


def test_event_actions(spark):
    pairs = {
        "(8)Session created": "permit", "(9)Session deleted": "close", "(1)Session denied": "deny",
        "Unknown event": "unknown", "(3)x": "drop", "(5)x": "reset", "(6)x": "redirect",
        "(99)created": "unknown", "Packet dropped by rule": "drop", "Traffic allowed": "permit",
        "Request blocked": "deny", "Session teardown": "close", "rejected by policy": "deny",
    }
    df = spark.createDataFrame(list(pairs.items()), "event string, want string")
    assert df.filter(event_action(F.col("event")) != F.col("want")).count() == 0


def test_csv(spark):
    lines = [
        '"2026-03-13 10:24:05",fw,"Protocol(1001)=TCP;PolicyName(1070)=a ""b"""',
        "Timestamp,Hostname,RawData", "t,h,bad", "only,Protocol(1001)=UDP", "x,y", "t,h,",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    rows = {r["i"]: r for r in parse_csv(df).collect()}
    assert sorted(rows) == [0, 2, 3, 4, 5]
    assert rows[0]["policy_name"] == 'a "b"' and rows[0]["hostname"] == "fw"
    assert rows[0]["_csv_timestamp"] == "2026-03-13 10:24:05"
    assert rows[3]["proto"] == "UDP" and rows[3]["_csv_timestamp"] is None
    letters = sorted(tuple(r) for r in dead_letters(parse_csv(df)).collect())
    assert letters == sorted([
        ("no_recognized_fields", "bad"), ("csv_payload_unparsable", "t,h,bad"),
        ("no_recognized_fields", "x,y"), ("csv_insufficient_fields", "x,y"),
        ("empty_line", ""), ("csv_payload_unparsable", "t,h,"),
    ])
