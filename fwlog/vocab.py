"""Fixed vocabulary of the log format: names, codes and output tables.

Everything in this module is a FIXED VALUE that the input format or the output
format prescribes; nothing here is computed.
"""

# --- fixed values: payload key -> record column (J1) -------------------------
FIELD_COLUMNS = {
    "Protocol(1001)": "proto",
    "Application(1002)": "app",
    "SrcIPAddr(1003)": "src",
    "SrcPort(1004)": "sport",
    "NatSrcIPAddr(1005)": "nat_src",
    "NatSrcPort(1006)": "nat_sport",
    "DstIPAddr(1007)": "dst",
    "DstPort(1008)": "dport",
    "NatDstIPAddr(1009)": "nat_dst",
    "NatDstPort(1010)": "nat_dport",
    "BeginTime_e(1013)": "start_time",
    "EndTime_e(1014)": "end_time",
    "RcvDSLiteTunnelPeer(1040)": "rcv_ds_tunnel",
    "SndDSLiteTunnelPeer(1041)": "snd_ds_tunnel",
    "RcvVPNInstance(1042)": "rcv_vpn",
    "SndVPNInstance(1043)": "snd_vpn",
    "InitPktCount(1044)": "init_pkts",
    "RplyPktCount(1045)": "reply_pkts",
    "InitByteCount(1046)": "init_bytes",
    "RplyByteCount(1047)": "reply_bytes",
    "Event(1048)": "event",
    "Action(1053)": "fw_action",
    "HitCount(1068)": "hit_count",
    "MatchCount(1069)": "match_count",
    "PolicyName(1070)": "policy_name",
    "SrcZone(1071)": "src_zone",
    "DstZone(1072)": "dst_zone",
    "UserName(1073)": "user",
    "Category(1174)": "category",
    "VlanID(1175)": "vlan_id",
    "VNI(1213)": "vni",
    "SrcAddrTransConfig(1247)": "src_nat_type",
    "DstAddrTransConfig(1248)": "dst_nat_type",
    "RuleId(1249)": "rule_id",
}

# Columns whose value must be an address.
ADDRESS_COLUMNS = ("src", "dst", "nat_src", "nat_dst")

# Prefix under which an unknown payload key is kept.
UNKNOWN_KEY_PREFIX = "_raw_"

# --- fixed values: event code -> action (J2) ---------------------------------
CODE_ACTIONS = {
    "1": "deny",
    "2": "deny",
    "3": "drop",
    "4": "drop",
    "5": "reset",
    "6": "redirect",
    "7": "log",
    "8": "permit",
    "9": "close",
    "10": "close",
    "11": "permit",
    "12": "deny",
}

# --- fixed values: words in an event text -> action, first hit wins (P10) ----
TEXT_ACTIONS = (
    ("permit", ("created", "permit", "allow")),
    ("deny", ("denied", "deny", "block", "reject")),
    ("close", ("deleted", "closed", "teardown")),
    ("drop", ("drop",)),
    ("reset", ("reset",)),
)

# --- fixed values: words in a mnemonic -> action, first hit wins (P19) -------
MNEMONIC_ACTIONS = (
    ("permit", ("LOGIN", "LOGON")),
    ("close", ("LOGOUT", "LOGOFF")),
    ("deny", ("FAIL", "DENIED", "REJECT")),
    ("log", ("CMD", "COMMAND")),
    ("permit", ("UP", "START", "ENABLE")),
    ("close", ("DOWN", "STOP", "DISABLE")),
)

# --- fixed values: output column order (X2, X3) ------------------------------
CORE_COLUMNS = ("proto", "src", "dst", "sport", "dport", "action")

EXTENDED_COLUMNS = (
    "app", "category", "nat_src", "nat_dst", "nat_sport", "nat_dport",
    "init_pkts", "init_bytes", "reply_pkts", "reply_bytes", "rule_id",
    "src_nat_type", "dst_nat_type", "hostname", "start_time", "end_time",
    "vlan_id", "vni", "src_zone", "dst_zone", "policy_name", "user",
    "fw_action", "hit_count", "match_count",
)

# --- fixed values: CEF extension, record column -> CEF key, in order (X9) ----
CEF_KEYS = (
    ("src", "src"),
    ("dst", "dst"),
    ("sport", "spt"),
    ("dport", "dpt"),
    ("proto", "proto"),
    ("action", "act"),
    ("app", "app"),
    ("hostname", "shost"),
    ("nat_src", "natTranslatedAddress"),
    ("nat_dst", "natDestinationAddress"),
    ("nat_sport", "natTranslatedPort"),
    ("nat_dport", "natDestinationPort"),
    ("user", "suser"),
    ("init_bytes", "out"),
    ("reply_bytes", "in"),
    ("init_pkts", "cnt"),
    ("start_time", "start"),
    ("end_time", "end"),
    ("event", "msg"),
    ("policy_name", "cs1"),
    ("src_zone", "cs2"),
    ("dst_zone", "cs3"),
    ("rule_id", "cs4"),
    ("vlan_id", "cs5"),
    ("vni", "cs6"),
    ("category", "cat"),
    ("src_nat_type", "cs8"),
    ("dst_nat_type", "cs7"),
)

# --- fixed values: label that goes before a custom CEF string (X9) -----------
CEF_LABELS = {
    "cs1": "policyName",
    "cs2": "srcZone",
    "cs3": "dstZone",
    "cs4": "ruleId",
    "cs5": "vlanId",
    "cs6": "vni",
    "cs7": "dstNatType",
    "cs8": "srcNatType",
}

# --- fixed values: CEF header (X4, X5, X6, X10) ------------------------------
CEF_PREFIX = "CEF:0|H3C|Comware|7.0|"
CEF_MAX_CHARS = 65536

ACTION_SEVERITY = {
    "permit": 3,
    "close": 2,
    "log": 1,
    "deny": 7,
    "drop": 8,
    "reset": 8,
    "redirect": 5,
    "unknown": 5,
}
DEFAULT_SEVERITY = 5

CODE_SIGNATURES = {
    "1": "SESSION_DENIED",
    "2": "SESSION_DENIED_POLICY",
    "3": "PACKET_DROPPED",
    "4": "PACKET_DROPPED_RATELIMIT",
    "5": "CONNECTION_RESET",
    "6": "SESSION_REDIRECTED",
    "7": "LOG_ONLY",
    "8": "SESSION_CREATED",
    "9": "SESSION_DELETED",
    "10": "SESSION_AGED_OUT",
    "11": "SESSION_MATCHED",
    "12": "SESSION_DENIED_AUTH",
}
DEFAULT_SIGNATURE = "H3C_EVENT"
ACTION_SIGNATURE_PREFIX = "H3C_"

ACTION_NAMES = {
    "permit": "Session Permitted",
    "deny": "Session Denied",
    "drop": "Packet Dropped",
    "reset": "Connection Reset",
    "close": "Session Closed",
    "redirect": "Session Redirected",
    "log": "Log Only",
    "unknown": "Unknown Event",
}
DEFAULT_EVENT_NAME = "H3C Firewall Event"

# --- fixed values: syslog facility and severity numbers (X11) ----------------
FACILITIES = {
    "kern": 0, "user": 1, "mail": 2, "daemon": 3, "auth": 4, "syslog": 5,
    "lpr": 6, "news": 7, "uucp": 8, "cron": 9, "authpriv": 10, "ftp": 11,
    "local0": 16, "local1": 17, "local2": 18, "local3": 19,
    "local4": 20, "local5": 21, "local6": 22, "local7": 23,
}
SEVERITIES = {
    "emerg": 0, "alert": 1, "crit": 2, "err": 3,
    "warning": 4, "notice": 5, "info": 6, "debug": 7,
}
DEFAULT_FACILITY_NUMBER = 16
DEFAULT_SEVERITY_NUMBER = 6

# --- fixed values: envelope and delivery limits (X12-X14, X17) ---------------
ENVELOPE_TAG = "h3c-translator: "
DEFAULT_HOSTNAME = "h3c-firewall"
HOSTNAME_MAX_CHARS = 253
TIMESTAMP_MAX_CHARS = 64
DELIVERY_MAX = 8192
DEFAULT_DESTINATION = "127.0.0.1"

# --- fixed values: intake limits (F4, F8, T1-T3) -----------------------------
LINE_MAX_BYTES = 8192
SINGLE_BODY_MAX_BYTES = 64 * 1024
BULK_MAX_LINES = 1000
SOURCE_CAP = 500
SOURCE_CAP_SECONDS = 10
TRACKED_SOURCES_CAP = 10_000
REQUEST_CAP = 200
REQUEST_CAP_SECONDS = 1

# --- fixed values: text lengths kept from system logs (P11-P20) --------------
SYSTEM_TEXT_CHARS = 200
USER_CHARS = 128

# Record columns, in the order of the record schema.
SESSION_COLUMNS = tuple(FIELD_COLUMNS.values())
HEADER_COLUMNS = ("_pri", "_rfc5424_ver", "_syslog_timestamp", "_src_ip", "_module")
SYSTEM_COLUMNS = ("_log_type", "_command", "_status")
PUBLIC_COLUMNS = SESSION_COLUMNS + ("hostname", "action")
RECORD_COLUMNS = PUBLIC_COLUMNS + HEADER_COLUMNS + SYSTEM_COLUMNS
