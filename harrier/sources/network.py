"""Firewall logs, DNS query logs, JSON events, and connection-table snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.functions.fields import in_cidr, ip_hex
from harrier.schema import EVENT_DDL
from harrier.sources.lines import metadata, part, syslog_time, usable

#: Lines of a block where lines are numbered through their file.
BLOCK = 100_000


def _firewall_event(rows: DataFrame, r: dict[str, Column], outcome: Column, source: str) -> DataFrame:
    side = lambda ip, port: F.concat(F.when(ip.contains(":") & port.isNotNull(), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip), F.coalesce(F.concat(F.lit(":"), port), F.lit("")))
    block = r["action"] == "block"
    return rows.withColumns(
        {
            "outcome": outcome,
            "timestamp": r["time"],
            "ip": r["src"],
            "event_type": F.when(block, "firewall_block").otherwise("network_connection"),
            "dst_ip": r["dst"],
            "src_port": r["sport"].try_cast("int"),
            "port": r["dport"].try_cast("int"),
            "protocol": F.lower(r["proto"]),
            "direction": r["direction"],
            "message": F.concat_ws(" ", r["action"], F.lower(r["proto"]), side(r["src"], r["sport"]), F.lit("->"), side(r["dst"], r["dport"])),
            "metadata": metadata(source=F.lit(source), action=r["action"], **r.get("more", {})),
        }
    )


def parse_netfilter(lines: DataFrame, now: Column, default_action: str = "block", zone: str = "UTC", source: str = "firewall") -> DataFrame:
    """Kernel lines with IN=... and a SRC= after it: key=value pairs, the last of a repeated key counts; other lines are skipped, an empty SRC is a parse error.

    The action comes from the rule's own prefix, which stands between "kernel:" with its uptime and IN=.
    """
    rows = usable(lines)
    tail = F.regexp_extract("value", r"(IN=.*)$", 1)
    head = F.regexp_extract("value", r"^(.*?)IN=", 1)
    prefix = F.trim(F.regexp_replace(F.trim(F.regexp_replace(head, r"^.*?kernel:", "")), r"^\[\s*\d+\.\d+\]\s*", ""))
    pairs = F.transform(F.filter(F.split(tail, r"\s+"), lambda t: t.contains("=")), lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.regexp_extract(t, "=(.*)$", 1).alias("v")))
    rows = rows.withColumns({"__pairs": pairs, "__prefix": prefix})
    # the last of a key: a fold into a map would fail on repeats
    key = lambda k: F.nullif(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("__pairs", lambda p: p["k"] == k), lambda p: p["v"])), -1), F.lit(""))
    inside, outside = key("IN"), key("OUT")
    direction = F.when(inside.isNotNull() & outside.isNotNull(), "forward").when(inside.isNotNull(), "inbound").when(outside.isNotNull(), "outbound")
    upper = F.upper("__prefix")
    action = F.when(upper.rlike("BLOCK|DROP|REJECT|DENY"), "block").when(upper.rlike("ALLOW|ACCEPT|AUDIT"), "allow").otherwise(default_action)
    stamp = F.coalesce(part(r"^(\d{4}-\d\d-\d\dT\S+)", 1), part(r"^([A-Z][a-z]{2}\s+\d{1,2} \d\d:\d\d:\d\d)", 1))
    more = {"log_prefix": F.col("__prefix"), "in_interface": inside, "out_interface": outside}
    r = {"time": syslog_time(stamp, now, zone), "src": key("SRC"), "dst": key("DST"), "sport": key("SPT"), "dport": key("DPT"), "proto": key("PROTO"), "direction": direction, "action": action, "more": more}
    outcome = F.when(~tail.contains(" SRC="), "skipped").when(key("SRC").isNull(), "parse_error").otherwise("parsed")
    return _firewall_event(rows, r, outcome, source).drop("__pairs", "__prefix")


#: Fixed value: the columns before a header names others.
WINDOWS_FIELDS = "date time action protocol src-ip dst-ip src-port dst-port size tcpflags tcpsyn tcpack tcpwin icmptype icmpcode info path pid"


def _with_header(lines: DataFrame) -> DataFrame:
    """Each line with `__names`, what the latest header of its file before it says.

    A file is cut into blocks (the parts that tasks read, or BLOCK lines): a header is carried within its block, and the
    last one of each block from block to block, a row each. So a file is many tasks.
    """
    header = F.when(F.col("value").startswith("#Fields:"), F.lower(F.trim(F.substring("value", 9, 10_000))))
    numbered = isinstance(lines.schema["line_no"].dataType, T.StructType)
    block = F.col("line_no.start") if numbered else F.floor(F.col("line_no") / BLOCK)
    rows = lines.withColumns({"__block": block, "__header": header})
    own = Window.partitionBy("file", "__block").orderBy("line_no")
    before = Window.partitionBy("h_file").orderBy("h_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(F.col("file").alias("h_file"), F.col("__block").alias("h_block")).agg(F.max_by("__header", F.when(F.col("__header").isNotNull(), F.col("line_no"))).alias("last"))
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(before)).drop("last")
    rows = rows.withColumn("__own", F.last("__header", ignorenulls=True).over(own))
    rows = rows.join(carried, (F.col("file") == F.col("h_file")) & (F.col("__block") == F.col("h_block")), "left")
    return rows.withColumn("__names", F.coalesce("__own", "carried", F.lit(WINDOWS_FIELDS))).drop("__block", "__header", "__own", "h_file", "h_block", "carried")


def parse_windows_firewall(lines: DataFrame, zone: str = "UTC", source: str = "firewall") -> DataFrame:
    """Rows (file, line_no, value): columns as the latest #Fields header of the file says, in any case; DROP and ALLOW only."""
    clean = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    rows = _with_header(clean)
    rows = usable(rows).where(~F.col("value").startswith("#"))
    names, values = F.split("__names", r"\s+"), F.split(F.trim("value"), r"\s+")

    def key(k: str) -> Column:
        at = F.array_position(names, k)
        got = F.when(at > 0, F.get(values, at.cast("int") - 1))
        return F.when(~got.isin("-", ""), got)

    action = F.when(F.upper(key("action")) == "DROP", "block").when(F.upper(key("action")) == "ALLOW", "allow")
    way = F.upper(key("path"))
    direction = F.when(way == "RECEIVE", "inbound").when(way == "SEND", "outbound").when(way == "FORWARD", "forward")
    time = F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", key("date"), key("time")), F.lit("yyyy-MM-dd HH:mm:ss")), zone)
    r = {"time": time, "src": key("src-ip"), "dst": key("dst-ip"), "sport": key("src-port"), "dport": key("dst-port"), "proto": key("protocol"), "direction": direction, "action": action, "more": {"pid": key("pid"), "tcp_flags": key("tcpflags")}}
    outcome = F.when(action.isNull(), "skipped").when(key("src-ip").isNull() | time.isNull(), "parse_error").otherwise("parsed")
    return _firewall_event(rows, r, outcome, source).drop("__names")


_STAMP = r"^(\d{4}-\d\d-\d\dT\S+|[A-Z][a-z]{2}\s+\d{1,2} \d\d:\d\d:\d\d)"
#: A pattern for each server's query lines, with the places of client, name and type. The last is an addition of this library.
DNS = {
    "dnsmasq": (r"(?:dnsmasq|pihole-FTL)\[\d+\]: query\[(\w+)\] (\S+) from (\S+)", (3, 2, 1)),
    "bind": (r"client (?:@\S+ )?(\S+)#\d+ \([^)]*\): (?:view \S+: )?query: (\S+) IN (\S+)", (1, 2, 3)),
    "unbound": (r"unbound\[[\d:]+\] info: (\S+) (\S+) (\S+) IN\s*$", (1, 2, 3)),
    "coredns": (r"\[INFO\] \[?([0-9a-fA-F.:]+?)\]?:\d+ - \d+ \"([A-Z0-9]+) IN (\S+) ", (1, 3, 2)),
}


def parse_dns(lines: DataFrame, server: str, now: Column, zone: str = "UTC", source: str = "dns") -> DataFrame:
    """Query lines to events; other lines are skipped. A line whose time is not known has none."""
    pattern, (client, name, kind) = DNS[server]
    rows = usable(lines)
    syslog = syslog_time(part(_STAMP, 1), now, zone)
    time = {
        "bind": F.to_utc_timestamp(F.try_to_timestamp(part(r"^(\d\d-[A-Z][a-z]{2}-\d{4} \d\d:\d\d:\d\d\.\d{3})\s", 1), F.lit("dd-MMM-yyyy HH:mm:ss.SSS")), zone),
        "unbound": F.coalesce(F.timestamp_seconds(part(r"^\[(\d+)\]", 1).try_cast("long")), syslog),
    }.get(server, syslog)
    return rows.withColumns(
        {
            "outcome": F.when(F.col("value").rlike(pattern), "parsed").otherwise("skipped"),
            "timestamp": time,
            "ip": part(pattern, client),
            "event_type": F.lit("dns_query"),
            "domain": F.regexp_replace(F.lower(part(pattern, name)), r"\.$", ""),
            "metadata": metadata(source=F.lit(source), query_type=F.upper(part(pattern, kind))),
        }
    )


def parse_events_json(lines: DataFrame, nest_prefix: str | None = None) -> DataFrame:
    """A line of JSON, an object or an array of them, to events with `index` and `error`; <prefix>* keys move into metadata."""
    rows = usable(lines)
    listed = F.trim("value").startswith("[")
    whole = F.when(listed, F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    rows = rows.withColumn("__items", F.from_json(whole, "array<string>"))
    bad = F.col("__items").isNull()
    rows = rows.select("*", F.posexplode(F.when(bad, F.array(F.lit(None).cast("string"))).otherwise(F.col("__items"))).alias("index", "__one")).drop("__items")
    rows = rows.withColumn("__e", F.from_json("__one", EVENT_DDL)).withColumn("error", F.when(F.col("__one").isNull() | ~F.trim("__one").startswith("{"), "invalid JSON"))
    out = rows.select(*lines.columns, "index", "error", "__one", "__e.*")
    if nest_prefix:
        flat = F.from_json("__one", "map<string,string>")
        moved = F.transform_keys(F.map_filter(flat, lambda k, _: k.startswith(nest_prefix)), lambda k, _: F.substring(k, len(nest_prefix) + 1, 1000))
        out = out.withColumn("metadata", F.when(F.size(moved) > 0, F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), moved)).otherwise(F.col("metadata")))
    return out.drop("__one")


def connection_events(snapshots: DataFrame, include_loopback: bool = False) -> DataFrame:
    """What each host's snapshot holds that the one before does not: new connections, and new listeners from the second snapshot on."""
    s = snapshots.withColumn("n", F.dense_rank().over(Window.partitionBy("host").orderBy("snapshot_ts")))
    # of a socket's repeats in a snapshot the first by owner and state counts
    same = Window.partitionBy("host", "n", "proto", "local_ip", "local_port", "remote_ip", "remote_port").orderBy("pid", "process", "uid", "state")
    s = s.withColumn("__r", F.row_number().over(same)).where("__r = 1").drop("__r")
    listening = F.col("state") == "LISTEN"
    none = F.col("remote_ip").isin("0.0.0.0", "::") | F.col("remote_ip").isNull()
    loop = lambda c: in_cidr(ip_hex(F.col(c)), "127.0.0.0/8") | in_cidr(ip_hex(F.col(c)), "::1/128")
    conns = s.where(~listening & ~none)
    if not include_loopback:
        conns = conns.where(~(loop("local_ip") & loop("remote_ip")))
    keys = ["host", "proto", "local_ip", "local_port", "remote_ip", "remote_port"]
    before = lambda rows, cols: rows.select(*cols, (F.col("n") + 1).alias("n")).distinct()
    new = conns.join(before(conns, keys), [*keys, "n"], "left_anti").dropDuplicates([*keys, "n"])
    ports = s.where(listening).select("host", "n", "proto", "local_port").distinct().withColumn("served", F.lit(True))
    new = new.join(ports, ["host", "n", "proto", "local_port"], "left")
    inbound = F.coalesce(F.col("served"), F.lit(False)) & (F.col("state") != "SYN_SENT")
    pick = lambda a, b: F.when(inbound, F.col(a)).otherwise(F.col(b))
    more = metadata(process=F.col("process"), pid=F.col("pid").cast("string"), uid=F.col("uid"), state=F.col("state"))
    made = new.select("host", F.col("snapshot_ts").alias("timestamp"), F.lit("network_connection").alias("event_type"), pick("remote_ip", "local_ip").alias("ip"), pick("local_ip", "remote_ip").alias("dst_ip"), pick("remote_port", "local_port").alias("src_port"), pick("local_port", "remote_port").alias("port"), F.col("proto").alias("protocol"), F.when(inbound, "inbound").otherwise("outbound").alias("direction"), F.lit(None).cast("string").alias("message"), more.alias("metadata"))
    lk = ["host", "proto", "local_ip", "local_port"]
    opened = s.where(listening).join(before(s.where(listening), lk), [*lk, "n"], "left_anti").where("n > 1").dropDuplicates([*lk, "n"])
    at = F.when(F.col("local_ip").contains(":"), F.concat(F.lit("["), F.col("local_ip"), F.lit("]"))).otherwise(F.col("local_ip"))
    text = F.concat(F.lit("listening on "), F.col("proto"), F.lit(" "), at, F.lit(":"), F.col("local_port").cast("string"))
    opened = opened.select("host", F.col("snapshot_ts").alias("timestamp"), F.lit("port_opened").alias("event_type"), F.col("local_ip").alias("ip"), F.lit(None).cast("string").alias("dst_ip"), F.lit(None).cast("int").alias("src_port"), F.col("local_port").alias("port"), F.col("proto").alias("protocol"), F.lit(None).cast("string").alias("direction"), text.alias("message"), more.alias("metadata"))
    return made.unionByName(opened)
