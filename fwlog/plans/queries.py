"""Registered queries: each takes ``(spark, sf_dir)`` and reads the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog import vocab
from fwlog.functions import crypto, net, render
from fwlog.functions.actions import event_action
from fwlog.operators import addresses, admission, delivery, results, stats
from fwlog.operators.csvlog import parse_csv
from fwlog.operators.parse import parse
from fwlog.plans import fixtures as fx
from fwlog.plans.translate import format_records, translate, translate_bulk, translate_csv, translate_single
from fwlog.sinks.writers import dead_letters
from fwlog.sources import lists, requests
from fwlog.sources.files import decoded, not_blank

# Fixed inputs of the checks.
DESTINATIONS = "10.10.0.52,10.10.0.53, 10.10.0.54"
ALLOWED = "10.0.0.0/9, 172.16.8.1/20,192.168.1.7,2001:db8::/32, junk"
TRUSTED = "10.0.0.0/8, 2001:db8::/32, junk"


def _parsed(spark, sf_dir) -> DataFrame:
    return parse(fx.session_lines(spark, sf_dir)).filter(F.col("reason").isNull())


def _message(spark, sf_dir, mode) -> DataFrame:
    done = translate(fx.session_lines(spark, sf_dir), mode)
    return done.filter(F.col("message").isNotNull())


def _network_table(spark: SparkSession, text: str) -> DataFrame:
    return lists.networks(spark.range(1).select(F.lit(text).alias("list")), "list")


def parse_session(spark, sf_dir):
    return _parsed(spark, sf_dir).select("msg_id", *vocab.PUBLIC_COLUMNS)


def parse_headers(spark, sf_dir):
    lines = fx.session_lines(spark, sf_dir).unionByName(
        fx.system_lines(spark, sf_dir).select((-F.col("msg_id") - 1).alias("msg_id"), "value")
    )
    parsed = parse(lines, fence=False)
    return parsed.select(
        "msg_id", "hostname", *[F.col(c).alias(c.strip("_")) for c in vocab.HEADER_COLUMNS]
    )


def unknown_fields(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "msg_id", F.size("extras").cast("bigint").alias("n"),
        F.col("extras")["_raw_Foo(9999)"].alias("foo"),
    )


def derive_action(spark, sf_dir):
    """Codes 0-15 and every action word in front of document text."""
    docs = fx.table(spark, sf_dir, "documents")
    event = F.concat(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("("), F.col("doc_id") % 16, F.lit(")")))
        .otherwise(""),
        F.col("text"),
    )
    return docs.select("doc_id", event_action(event).alias("action"))


def format_core(spark, sf_dir):
    return _message(spark, sf_dir, "core").select("msg_id", "message")


def format_extended(spark, sf_dir):
    return _message(spark, sf_dir, "extended").select("msg_id", "message")


def translate_cef(spark, sf_dir):
    return _message(spark, sf_dir, "cef").select("msg_id", "message")


def syslog_envelope_kv(spark, sf_dir):
    df = render.add_envelope(_message(spark, sf_dir, "core"), "core", "local0", "info")
    return df.select("msg_id", "syslog")


def syslog_envelope_cef(spark, sf_dir):
    df = render.add_envelope(_message(spark, sf_dir, "cef"), "cef", "auth", "err")
    return df.select("msg_id", "syslog")


def syslog_priority(spark, sf_dir):
    k = F.col("c_custkey")
    facility = F.element_at(F.array(*map(F.lit, ["kern", "LOCAL0", "bogus", "auth"])), (k % 4 + 1).cast("int"))
    severity = F.element_at(F.array(*map(F.lit, ["emerg", "Info", "debug", "none", "err"])), (k % 5 + 1).cast("int"))
    return fx.table(spark, sf_dir, "customer").select(
        "c_custkey", render.priority(facility, severity).cast("bigint").alias("pri")
    )


def sanitize_values(spark, sf_dir):
    text = F.col("text")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(render.clean_kv(text)).alias("kv"),
        F.md5(render.clean_cef_header(text)).alias("cef_header"),
        F.md5(render.clean_cef_value(text)).alias("cef_value"),
    )


def parse_system_logs(spark, sf_dir):
    parsed = parse(fx.system_lines(spark, sf_dir))
    return parsed.select(
        "msg_id", "proto", "category", "event", "user", "src", "dst", "app", "hostname",
        F.col("_log_type").alias("log_type"), F.col("_command").alias("command"),
        F.col("_status").alias("status"),
    )


def system_actions(spark, sf_dir):
    return parse(fx.system_lines(spark, sf_dir)).select("msg_id", "action")


def csv_translate(spark, sf_dir):
    done = translate_csv(not_blank(fx.csv_lines(spark, sf_dir)), "core")
    done = done.filter(F.col("message").isNotNull())
    return done.select("msg_id", "hostname", F.col("_csv_timestamp").alias("csv_ts"), "message")


def dead_letters_csv(spark, sf_dir):
    return dead_letters(parse_csv(not_blank(fx.csv_lines(spark, sf_dir))))


def dead_letters_log(spark, sf_dir):
    traffic = fx.traffic(spark, sf_dir)
    return dead_letters(parse(traffic))


def parser_stats(spark, sf_dir):
    return stats.parser_stats(parse(fx.session_lines(spark, sf_dir)))


def formatter_stats(spark, sf_dir):
    # an address-less line has no proto: parsed, then skipped
    lines = fx.session_lines(spark, sf_dir).select(
        "msg_id",
        F.when(F.col("msg_id") % 50 == 1, "SrcPort(1004)=7").otherwise(F.col("value")).alias("value"),
    )
    return stats.formatter_stats(translate(lines, "core"))


def receiver_stats(spark, sf_dir):
    admitted = admission.admit_tumbling(fx.traffic(spark, sf_dir))
    nets = _network_table(spark, "10.10.0.1,10.10.0.4")
    return stats.receiver_stats(addresses.split_by_allow_list(admitted, "client_ip", nets))


def batch_summary(spark, sf_dir):
    return stats.batch_summary(translate_csv(fx.csv_lines(spark, sf_dir), "core", every_line=True))


def valid_addresses(spark, sf_dir):
    e, u = F.col("e"), F.col("u")
    text = F.concat(
        F.when(e % 7 == 0, "0").otherwise(""), (e % 300).cast("string"), F.lit("."),
        (u % 260).cast("string"), F.lit("."), (e % 256).cast("string"), F.lit("."),
        (e % 258).cast("string"),
    )
    rows = fx.keyed_events(spark, sf_dir).select(e.alias("msg_id"), text.alias("address"))
    return rows.select(
        "msg_id", net.is_address(F.col("address")).alias("valid"),
        net.address_hex(F.col("address")).alias("hex"),
    )


def network_list(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("10."), k % 200, F.lit("."), k % 250, F.lit(".77/20, 192.168.1."), k % 250,
        F.lit(" ,,2001:db8:"), k % 10, F.lit("::5/48,10.0.0.0/255.255.0.0,bad/8,10.0.0.1/33"),
    )
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", text.alias("list"))
    return lists.networks(rows, "list").select(
        "c_custkey", "family", "bits", "lo", "hi"
    ).select("c_custkey", F.col("family").cast("bigint").alias("family"),
             F.col("bits").cast("bigint").alias("bits"), "lo", "hi")


def allowed_sources(spark, sf_dir):
    return addresses.allowed(fx.senders(spark, sf_dir), "client_ip", _network_table(spark, ALLOWED))


def allowed_by_table(spark, sf_dir):
    """A list of two networks per customer, of both families."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("10."), k % 200, F.lit("."), k % 250, F.lit(".0/24,2001:db"), k % 2 + 7, F.lit("::/48"))
    nets = lists.networks(fx.table(spark, sf_dir, "customer").select(text.alias("list")), "list")
    return addresses.allowed(fx.senders(spark, sf_dir), "client_ip", nets)


def rejected_sources(spark, sf_dir):
    return addresses.rejected(fx.senders(spark, sf_dir), "client_ip", _network_table(spark, ALLOWED))


def effective_client_ip(spark, sf_dir):
    log = addresses.with_client_address(fx.access_log(spark, sf_dir), _network_table(spark, TRUSTED))
    return log.select("msg_id", "client_ip")


def line_size_gate(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", admission.fits_line_limit(F.col("text")).alias("fits")
    )


def rate_cap_tumbling(spark, sf_dir):
    return admission.admit_tumbling(fx.traffic(spark, sf_dir)).select("msg_id", "client_ip")


def sender_cap(spark, sf_dir):
    kept = admission.admit_tumbling(fx.traffic(spark, sf_dir), max_sources=3)
    return kept.select("msg_id", "client_ip")


def rate_limit_anchored(spark, sf_dir):
    return admission.admit_anchored(fx.traffic(spark, sf_dir)).select("msg_id", "client_ip")


def bulk_status(spark, sf_dir):
    checked = requests.with_bulk_lines(fx.bulk_requests(spark, sf_dir))
    return checked.select(
        "request_id", F.col("status").cast("bigint").alias("status"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n"),
    )


def bulk_translate(spark, sf_dir):
    done = translate_bulk(fx.bulk_requests(spark, sf_dir))
    return done.select("request_id", F.col("index").cast("bigint").alias("index"), "message", "reason")


def bulk_summary(spark, sf_dir):
    return stats.bulk_summary(translate_bulk(fx.bulk_requests(spark, sf_dir)))


def bulk_results(spark, sf_dir):
    return results.bulk_documents(translate_bulk(fx.bulk_requests(spark, sf_dir)))


def request_status(spark, sf_dir):
    done = translate_single(fx.single_requests(spark, sf_dir))
    return done.select("msg_id", F.col("status").cast("bigint").alias("status"), "message")


def public_fields(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "msg_id", results.public_fields().alias("fields")
    )


def destination_list(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 5 == 0, " , ").otherwise(
        F.concat(F.lit("s"), k, F.lit(".example, 10.0.0."), k % 250, F.lit(" ,,bad\nhost"))
    )
    rows = fx.table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("hosts"))
    return lists.destinations(rows, "hosts").select(
        "s_suppkey", F.col("position").cast("bigint").alias("position"), "destination"
    )


def fan_out(spark, sf_dir):
    messages = _message(spark, sf_dir, "core").select("msg_id", "message")
    return delivery.fan_out(messages, DESTINATIONS)


def collector_delivery(spark, sf_dir):
    open_sessions = fx.sessions(spark, sf_dir).filter("allowed")
    messages = fx.traffic(spark, sf_dir).select("msg_id", "recv_ts")
    return delivery.deliver_to_sessions(messages, open_sessions).select("msg_id", "collector_id")


def delivery_stats(spark, sf_dir):
    return delivery.delivery_counts(fx.delivery_log(spark, sf_dir))


def logical_delivery(spark, sf_dir):
    return delivery.logical_delivery(fx.delivery_log(spark, sf_dir))


def collector_stats(spark, sf_dir):
    sessions = fx.sessions(spark, sf_dir)
    messages = fx.traffic(spark, sf_dir).select("msg_id", "recv_ts")
    sent = delivery.deliver_to_sessions(messages, sessions.filter("allowed"))
    sent = sent.select("msg_id", (F.col("msg_id") % 10 != 0).alias("ok"))
    at = F.timestamp_millis(F.lit(1704067200000 + 5000))
    return delivery.collector_counts(sessions, sent, at)


def stats_snapshot(spark, sf_dir):
    done = translate(fx.session_lines(spark, sf_dir), "core")
    both = done.agg(*stats.parser_counters(), *stats.formatter_counters())
    lines = stats.long_rows(both, {"parser": ["total", "parsed", "failed"], "formatter": ["formatted", "skipped"]})
    return lines.unionByName(stats.snapshot({
        "receiver": [receiver_stats(spark, sf_dir)],
        "forwarder": [logical_delivery(spark, sf_dir)],
    }))


def count_by_source(spark, sf_dir):
    return stats.count_by(_parsed(spark, sf_dir), "src")


def count_by_port(spark, sf_dir):
    return stats.count_by(_parsed(spark, sf_dir), "dport")


def count_by_action(spark, sf_dir):
    return stats.count_by(_parsed(spark, sf_dir), "action")


def pattern_extract(spark, sf_dir):
    hits = stats.extract_fields(_message(spark, sf_dir, "extended").select("msg_id", "message"))
    return hits.drop("message")


def delivery_truncate(spark, sf_dir):
    text = render.delivered(F.col("text"))
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest")
    )


def encrypt_roundtrip(spark, sf_dir):
    """Messages under the keys of five regions, bound to their number."""
    regions = fx.table(spark, sf_dir, "region")
    keys = regions.select(F.col("r_name").alias("key_id"), F.unhex(F.sha2(F.concat("r_name", F.lit(":"), "r_regionkey"), 256)).alias("secret"))
    names = F.lit(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
    rows = _message(spark, sf_dir, "core").select("msg_id", "message", F.get(names, (F.col("msg_id") % 5).cast("int")).alias("key_id"))
    sealed = crypto.encrypt(rows, keys, "message", "data", F.col("key_id"), F.col("msg_id")).drop("message")
    return crypto.decrypt(sealed, keys, "data", "message", F.col("key_id"), F.col("msg_id")).select("msg_id", "message")


def format_unknown_mode(spark, sf_dir):
    """A mode nobody knows means CEF."""
    return format_records(_parsed(spark, sf_dir), "json").select("msg_id", "message")


def dead_letters_session(spark, sf_dir):
    """Dead letters of a log in which most lines are good."""
    return dead_letters(parse(fx.session_lines(spark, sf_dir)))


def decode_lines(spark, sf_dir):
    lines = fx.broken_lines(spark, sf_dir).select("doc_id", decoded(F.col("value")).alias("value"))
    return not_blank(lines).select("doc_id", F.length("value").cast("bigint").alias("chars"), F.md5("value").alias("digest"))


def limit_cef(spark, sf_dir):
    done = translate(fx.long_policy_lines(spark, sf_dir), "cef")
    return done.select("msg_id", F.length("message").cast("bigint").alias("chars"), F.md5("message").alias("digest"))


def limit_envelope(spark, sf_dir):
    done = translate_csv(fx.long_export_lines(spark, sf_dir), "core")
    return render.add_envelope(done, "core").select("msg_id", "syslog")


def limit_system(spark, sf_dir):
    parsed = parse(fx.long_command_lines(spark, sf_dir))
    return parsed.select("msg_id", "user", F.col("_command").alias("command"), "event")


def many_unknown_fields(spark, sf_dir):
    parsed = parse(fx.unknown_key_lines(spark, sf_dir))
    extras = F.col("extras")
    return parsed.select(
        "msg_id", "sport", F.size("extras").cast("bigint").alias("n"), extras["_raw_Foo(1)"].alias("foo"),
        extras["_raw_Bar(2)"].alias("bar"), extras["_raw_Baz(3)"].alias("baz"), extras["_raw_Odd(7)"].alias("odd"),
        extras["_raw_Wide(9)"].alias("wide"))


def bulk_too_large(spark, sf_dir):
    checked = requests.with_bulk_lines(fx.large_requests(spark, sf_dir))
    return checked.select(
        "request_id", F.col("status").cast("bigint").alias("status"), F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_session, parse_headers, unknown_fields, derive_action, format_core,
        format_extended, translate_cef, syslog_envelope_kv, syslog_envelope_cef,
        syslog_priority, sanitize_values, parse_system_logs, system_actions, csv_translate,
        dead_letters_csv, dead_letters_log, parser_stats, formatter_stats, receiver_stats,
        batch_summary, valid_addresses, network_list, allowed_sources, allowed_by_table, rejected_sources,
        effective_client_ip, line_size_gate, rate_cap_tumbling, sender_cap,
        rate_limit_anchored, bulk_status, bulk_translate, bulk_summary, bulk_results,
        request_status, public_fields, destination_list, fan_out, collector_delivery,
        delivery_stats, logical_delivery, collector_stats, stats_snapshot, count_by_source,
        count_by_port, count_by_action, pattern_extract, delivery_truncate, encrypt_roundtrip,
        format_unknown_mode, dead_letters_session, decode_lines, limit_cef, limit_envelope, limit_system,
        many_unknown_fields, bulk_too_large,
    )
}
