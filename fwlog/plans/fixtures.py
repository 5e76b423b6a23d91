"""Log lines and traffic rendered from the ``events`` table.

The expected record of every rendered line follows from the same generating
columns, so a check never has to parse a line. Expressions marked ``SHARED`` are
plain SQL text that both Spark and the checking engine understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog.functions.text import apart, replaced
from fwlog.operators.parse import fenced

COPIES = 6
TASKS_PER_CORE = 3

# SHARED: generating columns of a line, over (e, u, t, v).
GENERATED = {
    "g_proto": "CASE e % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END",
    "g_src": "CASE WHEN e % 41 = 0 THEN '300.1.1.1' ELSE "
             "concat('10.', e % 200, '.', u % 250, '.', e % 254 + 1) END",
    "g_dst": "concat('172.16.', (e * 7) % 250, '.', (e * 3) % 254 + 1)",
    "g_sport": "CAST(1024 + (e * 31) % 60000 AS VARCHAR(20))",
    "g_dport": "CASE e % 5 WHEN 0 THEN '22' WHEN 1 THEN '53' WHEN 2 THEN '80' "
               "WHEN 3 THEN '443' ELSE '8080' END",
    "g_bytes": "CAST(v AS VARCHAR(20))",
    "g_event": "CASE WHEN e % 10 = 9 THEN 'Connection reset by peer' ELSE CASE t "
               "WHEN 'signup' THEN '(8)Session created' "
               "WHEN 'purchase' THEN '(9)Session deleted' "
               "WHEN 'view' THEN '(11)Session matched' "
               "WHEN 'click' THEN '(7)Log only' "
               "WHEN 'error' THEN '(1)Session denied' END END",
    "g_policy": "concat('rule ', e % 13, CASE WHEN e % 37 = 0 THEN '|a=b' ELSE '' END)",
    "g_user": "concat('u', u, CASE WHEN e % 31 = 0 THEN '\\x' ELSE '' END)",
    "g_app": "CASE e % 4 WHEN 0 THEN 'https' WHEN 1 THEN 'dns' WHEN 2 THEN 'ssh' ELSE 'Other Service' END",
}

# SHARED: names of the stages a line goes through, by e.
IS_GARBAGE = "e % 43 = 0"
IS_RICH = "e % 4 = 0"
HAS_ACTION = "e % 10 = 8"
HAS_DUPLICATES = "e % 29 = 0"


def _escape(sql: str) -> str:
    """Spark reads backslashes in string literals as escapes, the checker does not."""
    return sql.replace("\\", "\\\\").replace("VARCHAR(20)", "STRING")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_events(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    """Rows (e, u, t, v): every event, repeated with consecutive keys."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    # a file of few row groups is read by as many tasks; every row becomes long lines, so all cores take part
    events = events.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return events.select(
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("k"), "*"
    ).select(
        (F.col("event_id") * copies + F.col("k")).alias("e"),
        F.col("user_id").alias("u"),
        F.col("event_type").alias("t"),
        F.floor(F.col("value") * 10).cast("bigint").alias("v"),
    )


def generated(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.expr(_escape(sql)).alias(n) for n, sql in GENERATED.items()])


_HEAD_A = "10.16.18.1 kern.info FW-01 %%10 "
_HEADERS = {
    0: _HEAD_A + "VsysId:1 nat/6/NAT_IPV4_MATCH: ",
    1: "<189>" + _HEAD_A + "nat/6/NAT_IPV4_MATCH: ",
    2: "<189>Mar 13 16:20:09 " + _HEAD_A + "nat/6/NAT_IPV4_MATCH: ",
    3: "<189>1 2026-03-13T16:20:09Z " + _HEAD_A + "nat/6/NAT_IPV4_MATCH: ",
    4: "FW-01 %%01 VsysId:0 SESSION/6/SESSION_IPV4: ",
    5: "",
}


def session_line() -> "F.Column":
    e = F.col("e")
    header = F.when(e % 6 == 0, _HEADERS[0])
    for i in range(1, 6):
        header = header.when(e % 6 == i, _HEADERS[i])

    def field(key, value, when=None):
        text = F.concat(F.lit(f"{key}="), value, F.lit(";"))
        return text if when is None else F.when(F.expr(when), text)

    body = F.concat_ws(
        "",
        field("Protocol(1001)", F.col("g_proto")),
        field("SrcIPAddr(1003)", F.col("g_src")),
        field("SrcPort(1004)", F.col("g_sport")),
        field("DstIPAddr(1007)", F.col("g_dst")),
        field("DstPort(1008)", F.lit("1"), HAS_DUPLICATES),
        field("DstPort(1008)", F.col("g_dport")),
        field("InitByteCount(1046)", F.col("g_bytes")),
        field("Action(1053)", F.lit("Permit "), HAS_ACTION),
        field("VlanID(1175)", F.lit("--")),
        field("SrcAddrTransConfig(1247)", F.lit("Not translated")),
        field("Foo(9999)", F.lit("bar")),
        F.when(
            F.expr(IS_RICH),
            F.concat(
                field("Application(1002)", F.col("g_app")),
                field("Category(1174)", F.lit("Other_Service")),
                field("NatSrcIPAddr(1005)", F.col("g_dst")),
                field("NatSrcPort(1006)", F.col("g_sport")),
                field("NatDstIPAddr(1009)", F.lit("fe80::1%eth0")),
                field("NatDstPort(1010)", F.col("g_dport")),
                field("InitPktCount(1044)", F.lit("1")),
                field("RplyPktCount(1045)", F.lit("2")),
                field("RplyByteCount(1047)", F.col("g_bytes")),
                field("RcvVPNInstance(1042)", F.lit("")),
                field("SndVPNInstance(1043)", F.lit("vpn1")),
                field("RcvDSLiteTunnelPeer(1040)", F.lit("")),
                field("SndDSLiteTunnelPeer(1041)", F.lit("")),
                field("BeginTime_e(1013)", F.lit("03132026162009")),
                field("EndTime_e(1014)", F.lit("")),
                field(" VNI(1213)", F.lit(" 7 ")),
                field("RuleId(1249)", F.lit("0")),
                field("DstAddrTransConfig(1248)", F.lit("NAT server.")),
                field("SrcZone(1071)", F.lit("Trust")),
                field("DstZone(1072)", F.lit("Untrust")),
                field("PolicyName(1070)", F.col("g_policy")),
                field("UserName(1073)", F.col("g_user")),
                field("HitCount(1068)", F.lit("3")),
                field("MatchCount(1069)", F.lit("4")),
            ),
        ),
        field("SrcIPAddr(1003)", F.lit("999.1.1.1"), HAS_DUPLICATES),
        F.concat(F.lit("Event(1048)="), F.col("g_event")),
    )
    return F.when(F.expr(IS_GARBAGE), F.concat(F.lit("garbage line "), e.cast("string"))).otherwise(
        F.concat(header, body)
    )


def session_lines(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    """RAW session log: (msg_id, value)."""
    return generated(keyed_events(spark, sf_dir, copies)).select(
        apart(F.col("e")).alias("msg_id"), session_line().alias("value")
    )


# SHARED: system log lines, by e % 7.
SYSTEM_GENERATED = {
    "g_module": "CASE e % 7 WHEN 0 THEN 'WEB/5/LOGIN' WHEN 1 THEN 'WEB/5/LOGOUT' "
                "WHEN 2 THEN 'SHELL/6/SHELL_CMD' WHEN 3 THEN 'CFGMAN/5/CFG_CHANGED' "
                "WHEN 4 THEN 'IFNET/3' WHEN 5 THEN CASE e % 4 WHEN 0 THEN 'AAA/4/LOGIN_FAILED' "
                "WHEN 1 THEN 'aaa/4/CONN_DENIED' WHEN 2 THEN 'AAA/4/LINK_UP' ELSE 'AAA/4/SVC_STOP' END "
                "ELSE 'NTP/5/NTP_SYNC' END",
    "g_ip": "CASE WHEN e % 11 = 0 THEN '300.1.1.1' ELSE "
            "concat('10.', e % 200, '.', u % 250, '.', e % 254 + 1) END",
    "g_line": "CASE WHEN e % 13 = 0 THEN '' ELSE concat('vty', e % 5) END",
    "g_state": "CASE WHEN e % 2 = 0 THEN 'DOWN' ELSE 'up' END",
}
# SHARED: free text of a system log.
SYSTEM_TEXT = (
    "CASE e % 7 WHEN 0 THEN concat('u', u, ' logged in from ', g_ip) "
    "WHEN 1 THEN concat('u', u, ' logged out from ', g_ip) "
    "WHEN 2 THEN CASE WHEN e % 2 = 0 "
    "THEN concat('-Line=', g_line, '-IPAddr=', g_ip, '-User=u', u, '; Command is display ', t) "
    "ELSE concat('Line=', g_line, ' IPAddr=', g_ip, ' User=u', u, '; Command is display ', t) END "
    "WHEN 3 THEN concat('Configuration is changed by u', u) "
    "WHEN 4 THEN concat('Interface GigabitEthernet1/0/', e % 24, ' changed to ', g_state) "
    "WHEN 5 THEN concat('from 300.1.1.1 via ', g_ip, ' to 172.16.0.', e % 250, ' user: u', u, '.,') "
    "ELSE concat('clock in sync ', e) END"
)


def system_lines(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    df = keyed_events(spark, sf_dir, copies)
    df = df.select("*", *[F.expr(sql.replace("VARCHAR(20)", "STRING")).alias(n)
                          for n, sql in SYSTEM_GENERATED.items()])
    far = F.concat(F.lit("<14> 10.16.18.9 some words FW-03 %%10 VsysId:3 "), F.col("g_module"))
    near = F.concat(F.lit("FW-02 %%10"), F.col("g_module"))
    head = F.when(F.col("e") % 5 == 0, far).otherwise(near)
    return df.select(
        apart(F.col("e")).alias("msg_id"),
        F.concat(head, F.lit(": "), F.expr(SYSTEM_TEXT)).alias("value"),
    )


def csv_lines(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    """Physical lines of a CSV export: header, blank, short and full lines."""
    e = F.col("e")
    host = F.when(e % 7 == 0, '"fw ""q"""').otherwise("10.16.18.1")
    lines = generated(keyed_events(spark, sf_dir, copies)).select(apart(e).alias("e"), session_line().alias("line"))
    quoted = F.concat(F.lit('"'), replaced(F.col("line"), '"', '""'), F.lit('"'))
    full = F.concat(F.lit('"2026-03-13 10:24:05",'), host, F.lit(","), quoted, F.lit(",extra"))
    value = (
        F.when(e == 0, "Timestamp,Hostname,RawData")
        .when(e % 61 == 0, "")
        .when(e % 59 == 0, "x,Protocol(1001)=TCP;SrcPort(1004)=5")
        .when(e % 53 == 0, '"2026-03-13 10:24:05",nothing here')
        .otherwise(full)
    )
    # a filter on the text would otherwise build every line once more
    return fenced(lines.select(e.alias("msg_id"), value.alias("value")), "value")


# SHARED: arrival time in milliseconds and sender of message e.
TRAFFIC_MILLIS = "1704067200000 + e + CAST((e - e % 700) / 700 AS BIGINT) * 300"
TRAFFIC_SENDER = "CASE WHEN e % 2 = 0 THEN '10.10.0.1' ELSE concat('10.10.0.', e % 5 + 2) END"


def traffic(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    """RAW messages with arrival time and sender; one sender has half of them."""
    e = F.col("e")
    return keyed_events(spark, sf_dir, copies).select(
        e.alias("msg_id"),
        F.timestamp_millis(F.expr(TRAFFIC_MILLIS)).alias("recv_ts"),
        F.expr(TRAFFIC_SENDER).alias("client_ip"),
        F.when(e % 19 == 0, "   ").otherwise(F.concat(F.lit("m"), e)).alias("value"),
    )


def sessions(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    """Collector sessions over the traffic time, with gaps; every seventh is refused."""
    j = ((F.col("e") - F.col("e") % 5000) / 5000).cast("bigint")
    steps = keyed_events(spark, sf_dir, copies).select(j.alias("j")).distinct()
    start = F.lit(1704067200000) + F.col("j") * 7000
    return steps.select(
        F.concat(F.lit("c"), F.col("j")).alias("collector_id"),
        F.timestamp_millis(start).alias("connected_at"),
        F.timestamp_millis(start + 3000 + F.col("j") % 3 * 2500).alias("disconnected_at"),
        (F.col("j") % 7 != 6).alias("allowed"),
    )


def access_log(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    e = F.col("e")
    return keyed_events(spark, sf_dir, copies).select(
        e.alias("msg_id"),
        F.when(e % 3 == 0, "10.0.0.5").when(e % 3 == 1, "192.0.2.7").otherwise("no-address").alias("peer"),
        F.when(e % 17 == 0, "bad, 1.2.3.4")
        .when(e % 5 == 0, F.lit(None))
        .otherwise(F.concat(F.lit(" 203.0.113."), e % 200, F.lit(" , 10.0.0.9")))
        .alias("xff"),
    )


def senders(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    """Messages from addresses of both families, some of them no address at all."""
    e = F.col("e")
    address = (
        F.when(e % 4 == 0, F.col("g_src"))
        .when(e % 4 == 1, F.col("g_dst"))
        .when(e % 4 == 2, F.concat(F.lit("2001:db"), e % 3 + 7, F.lit("::"), e % 9999))
        .otherwise(F.concat(F.lit("192.168.1."), e % 300))
    )
    return generated(keyed_events(spark, sf_dir, copies)).select(
        e.alias("msg_id"), address.alias("client_ip")
    )


def bulk_requests(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    """Request documents of 40 lines each, and malformed and oversized ones beside them."""
    e = F.col("e")
    r = F.col("request_id")
    keyed = keyed_events(spark, sf_dir, copies).withColumn("request_id", ((e - e % 40) / 40).cast("bigint"))
    # a request's events are brought together before lines are made of them, which are ten times as wide
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = generated(keyed.repartition(tasks, "request_id")).select(
        "request_id", apart(e).alias("e"), session_line().alias("value"),
    )
    grouped = lines.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("e", "value"))).alias("rows")
    )
    good = F.to_json(F.struct(F.col("rows.value").alias("lines")))
    many = F.concat(F.lit('{"lines":['), F.array_join(F.array_repeat(F.lit('"x"'), 1001), ","), F.lit("]}"))
    body = (
        F.when(r % 10 == 3, "not json")
        .when(r % 10 == 5, '{"lines": []}')
        .when(r % 10 == 6, "[1]")
        .when(r % 10 == 7, '{"lines": "x"}')
        .when(r % 10 == 8, '{"other": 1}')
        .when(r % 10 == 9, many)
    )
    bad = keyed.select("request_id").distinct().select((-r - 1).alias("request_id"), body.alias("body")).filter(F.col("body").isNotNull())
    return grouped.select("request_id", good.alias("body")).unionByName(bad)


def single_requests(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    e = F.col("e")
    line = session_line()
    body = (
        F.when(e % 8 == 0, F.to_json(F.struct(line.alias("raw"))))
        .when(e % 8 == 1, "")
        .when(e % 8 == 2, '{"raw": ""}')
        .when(e % 8 == 3, '{"other": 1}')
        .when(e % 8 == 4, line)
        .when(e % 400 == 5, F.repeat(F.lit("x"), 65537))
        .when(e % 8 == 6, "[1,2]")
        .otherwise("nothing to see")
    )
    return generated(keyed_events(spark, sf_dir, copies)).select(
        apart(e).alias("msg_id"), body.alias("body")
    )


def delivery_log(spark: SparkSession, sf_dir: str, copies: int = COPIES) -> DataFrame:
    """One row per message and delivery vector."""
    e = F.col("e")
    return keyed_events(spark, sf_dir, copies).select(
        e.alias("msg_id"),
        F.inline(F.array(
            F.struct(F.lit("rsyslog").alias("vector"), (e % 9 != 0).alias("ok")),
            F.struct(F.lit("udp").alias("vector"), (e % 6 != 0).alias("ok")),
        )),
    )


# Texts around the length limits, one line per event.


def long_policy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session lines with a policy name that makes every 97th message longer than a message may be."""
    e = F.col("e")
    n = F.when(e % 97 == 0, 65000 + e % 1000).otherwise(e % 50 + 1).cast("int")
    return keyed_events(spark, sf_dir, 1).select(e.alias("msg_id"), F.concat(
        F.lit("Protocol(1001)=TCP;PolicyName(1070)="), F.repeat(F.lit("p"), n), F.lit(";Event(1048)=(8)Session created"),
    ).alias("value"))


def long_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines whose time and host are around the lengths an envelope allows."""
    e = F.col("e")
    return keyed_events(spark, sf_dir, 1).select(e.alias("msg_id"), F.concat(
        F.lit('"2026-03-13 10:24:05'), F.repeat(F.lit("+"), (e % 90).cast("int")), F.lit('",h'),
        F.repeat(F.lit("x"), (200 + e % 100).cast("int")), F.lit(',"Protocol(1001)=TCP;SrcPort(1004)=5"'),
    ).alias("value"))


def long_command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System lines with a user, a command and a text around the lengths that are kept."""
    e = F.col("e")
    return keyed_events(spark, sf_dir, 1).select(e.alias("msg_id"), F.concat(
        F.lit("FW-02 %%10SHELL/6/SHELL_CMD: -Line=vty0-IPAddr=10.0.0.1-User="), F.repeat(F.lit("u"), (100 + e % 60).cast("int")),
        F.lit("; Command is "), F.repeat(F.lit("c"), (150 + e % 100).cast("int")),
    ).alias("value"))


def unknown_key_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with several unknown keys, one of them twice, and keys that only look like some."""
    e = F.col("e")
    odd = F.when(e % 5 == 0, "x-Odd(7)=1;").when(e % 5 == 1, "No(8)\u00a0=1;").when(e % 5 == 2, "\u2003Wide(9)= w\u3000;").otherwise("")
    return keyed_events(spark, sf_dir, 1).select(e.alias("msg_id"), F.concat(
        F.lit("Protocol(1001)=TCP;Foo(1)=a;Bar(2)= b=c ; ;Foo(1)=c"), e, F.lit(";Baz(3)=;"), odd,
        F.when(e % 7 == 0, "SrcPort(1004)=1;SrcPort(1004)=2").otherwise("SrcPort(1004)= 9"),
    ).alias("value"))


def large_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk requests of a few lines; every 499th is larger than a request may be."""
    e = F.col("e")
    filling = F.repeat(F.lit("x"), F.when(e % 499 == 0, 10 * 1024 * 1024 + 1).otherwise(e % 20).cast("int"))
    body = F.concat(F.lit('{"lines":["Protocol(1001)=TCP","'), filling, F.lit('"]}'))
    return keyed_events(spark, sf_dir, 1).filter(e % 10 < 9).select(e.alias("request_id"), body.alias("body"))


#: Byte sequences put between the halves of a text, and what a decoder makes of them.
BROKEN = [("", ""), ("C3", "\ufffd"), ("E282", "\ufffd"), ("F09F98", "\ufffd"), ("C0AF", "\ufffd" * 2), ("EDA080", "\ufffd" * 3),
          ("F4908080", "\ufffd" * 4), ("80FF", "\ufffd" * 2), ("E28241", "\ufffdA"), ("F09F41", "\ufffdA"), ("E0809F", "\ufffd" * 3)]


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of the documents as bytes, with ill-formed bytes in the middle and blanks around."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    text = F.translate(F.col("text"), "\r\n", "  ")
    half = F.floor(F.length(text) / 2).cast("int")
    wrong = F.element_at(F.array(*[F.unhex(F.lit(h)) for h, _ in BROKEN]), (F.col("doc_id") % len(BROKEN) + 1).cast("int"))
    return docs.select("doc_id", F.concat(
        F.encode(F.concat(F.lit(" \t"), F.left(text, half)), "utf-8"), wrong,
        F.encode(F.concat(F.substring(text, half + 1, F.lit(2**31 - 1)), F.lit("\u3000")), "utf-8"),
    ).alias("value"))
