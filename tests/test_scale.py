"""Plans that stay small, and lines whose pairs are read in either way."""

from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions.text import BLANKS, after, strip_line
from fwlog.operators.parse import parse
from fwlog.operators.stats import extract_fields
from fwlog.plans.translate import format_records, translate, translate_bulk

BODY = "Protocol(1001)=TCP;SrcIPAddr(1003)=10.0.0.10;SrcPort(1004)=1;DstIPAddr(1007)=10.0.0.2;DstPort(1008)=2;Event(1048)=(8)Session created"


def _lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "msg_id long, value string").repartition(1)


def test_unknown_mode_keeps_the_parser_once(spark):
    records = parse(_lines(spark, BODY, "garbage")).filter(F.col("reason").isNull())
    done = format_records(records, "json").select("msg_id", "message")
    plan = done._jdf.queryExecution().optimizedPlan()
    above = plan.toString().split("Generate explode")[0]
    assert "LIKE" not in above and len(above) < 5000
    assert [r.msg_id for r in done.collect()] == [0]
    assert done.first().message == translate(_lines(spark, BODY), "cef").first().message


def test_hits_are_searched_once(spark):
    hits = extract_fields(translate(_lines(spark, BODY, "x"), "extended").filter("message IS NOT NULL").select("msg_id", "message"))
    below = hits._jdf.queryExecution().optimizedPlan().toString()
    assert below.count(r"regexp_extract(message") <= 9
    assert [(r.msg_id, r.source_address, r.action) for r in hits.collect()] == [(0, "10.0.0.10", "permit")]


def test_bulk_documents_are_read_once(spark):
    body = '{"lines": ["' + BODY + '", "garbage"]}'
    rows = spark.createDataFrame([(1, body), (2, '{"lines": []}'), (3, "[1]"), (4, None)], "request_id long, body string").repartition(1)
    done = translate_bulk(rows)
    assert "try_parse_json" not in [line for line in done._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line]
    assert sorted((r.request_id, r["index"], r.message is None) for r in done.collect()) == [(1, 0, False), (1, 1, True)]


def test_pairs_of_odd_payloads(spark):
    name = "L" * 60_000
    cases = {
        r'PolicyName(1070)=a\b"c\n;Foo(1)="\;SrcPort(1004)=1': {"policy_name": r'a\b"c\n', "sport": "1", "extras": {"_raw_Foo(1)": '"\\'}},
        "SrcIPAddr(1003)= 10.0.0.10 ;SrcIPAddr(1003)=999.1.1.1": {"src": "10.0.0.10"},
        "SrcIPAddr(1003)=10.0.0.10;SrcIPAddr(1003)=10.0.0.200;SrcIPAddr(1003)=x": {"src": "10.0.0.200"},
        "x SrcIPAddr(1003)=10.0.0.10;SrcIPAddr(1003)=999.1.1.1;Protocol(1001)=\"\x01\\": {"src": "10.0.0.10", "proto": "\"\x01\\"},
        "Protocol(1001)=SrcPort(1004)=7;plain;;  ;SrcPort(1004)=": {"proto": "SrcPort(1004)=7", "sport": ""},
        f"{name}(1)=a;Protocol(1001)=TCP": {"proto": "TCP", "extras": {f"_raw_{name}(1)": "a"}},
        f"PolicyName(1070)={name};Protocol(1001)=TCP;Protocol(1001)=UDP": {"proto": "UDP", "policy_name": name},
        "Protocol(1001)=TCP;" * 3000: {"proto": "TCP", "extras": {}},
    }
    rows = parse(_lines(spark, *cases)).select("value", "reason", "extras", *vocab.SESSION_COLUMNS).collect()
    for row in rows:
        assert row.reason is None
        for column, want in cases[row.value].items():
            assert row[column] == want, (row.value[:60], column)


def test_plain_payloads_are_cut_at_semicolons(spark):
    """The pairs are read once, without a JSON reader; records are made of the lines that pass a filter on the reason."""
    cases = {
        "Protocol(1001)=TCP; SrcPort(1004)= 7 ;SrcPort(1004)=8; Foo(1)=a=b;;": {"sport": "8", "extras": {"_raw_Foo(1)": "a=b"}},
        "Protocol(1001)=TCP;UserName(1073)=\u7528\u6237 x;PolicyName(1070)=\U0001f600": {"user": "\u7528\u6237 x", "policy_name": "\U0001f600"},
        "Protocol(1001)=TCP;UserName(1073)=\u3000y\u3000;SrcIPAddr(1003)=10.0.0.1;SrcIPAddr(1003)=;SrcIPAddr(1003)=z": {"user": "y", "src": ""},
        "Protocol(1001)=TCP;SrcIPAddr(1003)=10.0.0.1;SrcIPAddr(1003)=1.1.1.1.1;Foo(1)=": {"src": "10.0.0.1", "extras": {"_raw_Foo(1)": ""}},
        "Protocol(1001)=TCP;SrcPort(1004);DstPort(1008)=1": {"sport": None, "dport": "1", "extras": {}},
    }
    parsed = parse(_lines(spark, *cases, "garbage")).filter("reason IS NULL")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan
    assert plan.index("Generate explode") < plan.index("regexp_extract_all")
    assert "AS __event" in plan.split("Filter isnull(reason")[0]
    for row in parsed.collect():
        for column, want in cases[row.value].items():
            assert row[column] == want, (row.value, column)


def test_joined_values_are_compiled_apart(spark):
    done = translate(_lines(spark, BODY), "extended")
    assert "transform(array(proto" in done._jdf.queryExecution().optimizedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_trimmed_like_python_and_only_where_needed(spark):
    blanks = ["", " ", "\t", "\x1c", "\x85", "　", "\n", "\x7f", "\x00"]
    texts = [a + b + c for a in blanks for b in ["", "x", "x y", "é", "語z", "!", "~", "😀"] for c in blanks]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, t string").repartition(2)
    got = {r.id: r.s for r in rows.select("id", strip_line(F.col("t")).alias("s")).collect()}
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(texts))] == [t.strip(BLANKS) for t in texts]
    plan = _optimized(parse(_lines(spark, BODY)).select("msg_id", "reason"))
    made = plan.split("AS __line#")[0].split("Project [")[-1]
    assert made.lower().count("trim(") == 1 and "CASE WHEN" in made.lower().split("trim(")[0].upper()


def test_rests_are_cut_behind_their_prefix(spark):
    rows = [("ab c", "ab"), ("é語x", "é"), ("é語x", ""), ("", ""), ("same", "same"), (None, None), ("😀y", "😀")]
    df = spark.createDataFrame(rows, "c string, p string").repartition(2)
    assert "cast(c#" in _optimized(df.select(after(F.col("c"), F.col("p"))))
    got = {(r.c, r.p): r.rest for r in df.select("*", after(F.col("c"), F.col("p")).alias("rest")).collect()}
    assert got == {(c, p): None if c is None else c[len(p):] for c, p in rows}
    # broken bytes: the prefix is what a pattern search made of them, so characters are counted
    broken = spark.sql("SELECT cast(X'61FF62' AS string) AS c, cast(X'61EFBFBD' AS string) AS p")
    assert broken.select(after(F.col("c"), F.col("p")).alias("rest")).first().rest == "b"


def test_header_groups_are_matched_once(spark):
    head = "FW-01 %%10 VsysId:1 nat/6/NAT: "
    lines = ["<189>1 2026-03-13T16:20:09Z 10.16.18.1 kern.info " + head + BODY, "<5>Mar\t3 16:20:09 \x01; %%10 a;b/6: " + BODY, "q;r " + head + BODY, BODY, "garbage", ""]
    df = parse(_lines(spark, *lines)).select("msg_id", "hostname", *vocab.HEADER_COLUMNS)
    assert _optimized(df).count("regexp_extract(__prefix") == 0
    got = {r.msg_id: (r.hostname, r._pri, r._rfc5424_ver, r._syslog_timestamp, r._src_ip, r._module) for r in df.collect()}
    assert got == {
        0: ("FW-01", "189", "1", "2026-03-13T16:20:09Z", "10.16.18.1", "nat/6/NAT"), 1: ("\x01;", "5", None, "Mar\t3 16:20:09", None, "a;b/6"),
        2: ("FW-01", None, None, None, None, "nat/6/NAT"), 3: (None,) * 6, 4: (None,) * 6, 5: (None,) * 6}


def test_action_is_compiled(spark):
    plan = _optimized(parse(_lines(spark, BODY)).select("msg_id", "action"))
    apart = [part for part in plan.split("transform(array(")[1:] if part.startswith("CASE") or part.startswith("coalesce")]
    assert not apart


def test_headers_alone_need_no_pairs(spark):
    """Without a filter on the reason there is no fence, and what only the reason needs is pruned."""
    head = "<5>10.16.18.1 kern.info FW-01 %%10 nat/6/NAT: "
    df = parse(_lines(spark, head + BODY, "garbage", ""), fence=False)
    heads = df.select("msg_id", "hostname", *vocab.HEADER_COLUMNS)
    plan = _optimized(heads)
    assert "__pairs" not in plan and "explode" not in plan and "transform(array(__header" in plan
    assert [tuple(r) for r in heads.orderBy("msg_id").collect()] == [
        tuple(r) for r in parse(_lines(spark, head + BODY, "garbage", "")).select(*heads.columns).orderBy("msg_id").collect()]
    assert [r.reason for r in df.orderBy("msg_id").collect()] == [None, "no_recognized_fields", "empty_line"]


def test_unknown_values_are_not_searched_pair_by_pair(spark):
    """The last value of an unknown key is cut from the joined pairs."""
    cases = {
        "Protocol(1001)=TCP;Foo(1)=a;Foo(1)= b;c=;Foo(1)=": {"_raw_Foo(1)": ""},
        "Foo(1)=x=Foo(1)=y;Protocol(1001)=TCP;oo(1)=z;A(2)=;Foo(11)=w": {"_raw_Foo(1)": "x=Foo(1)=y", "_raw_oo(1)": "z", "_raw_A(2)": "", "_raw_Foo(11)": "w"},
        "Protocol(1001)=TCP;Foo(1)=\t　q 　;Bar(2)=1": {"_raw_Foo(1)": "q", "_raw_Bar(2)": "1"},
        "Protocol(1001)=TCP": {},
    }
    df = parse(_lines(spark, *cases)).select("value", "extras")
    made = [line for line in _optimized(df).split("\n") if "map_from_entries" in line]
    assert made and all("array_position(__keys#" not in line.split("map_from_entries")[1].split("AS extras")[0] for line in made)
    assert {r.value: r.extras for r in df.collect()} == cases
