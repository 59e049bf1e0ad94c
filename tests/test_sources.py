"""Golden log lines."""

from datetime import datetime

from pyspark.sql import functions as F

from harrier.sources import access, network

def now():
    return F.lit("2027-01-01 00:00:00").cast("timestamp")


def one(df):
    return df.collect()[0]


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_combined(spark):
    r = one(access.parse_access_log(lines(spark, '192.0.2.44 - ines [03/Mar/2025:23:10:07 -0330] "PUT /api/v1/boats?tag=a%2Fb&n=%C3%A9 HTTP/2.0" 204 0 "https://harbour.example/start" "Lynx/2.9 (Unix)"')))
    assert (r["timestamp"], r["path"], r["status_code"], r["metadata"]["method"], r["metadata"]["user"]) == (datetime(2025, 3, 4, 2, 40, 7), "/api/v1/boats?tag=a%2Fb&n=%C3%A9", 204, "PUT", "ines")
    r = one(access.parse_access_log(lines(spark, r'192.0.2.44:3000 - - [03/Mar/2025:23:10:07 +0000] "HEAD /b?c=\x5Bz\x5D\"q HTTP/1.1" 400 0 "-" "-"')))
    assert (r["ip"], r["path"], r["user_agent"]) == ("192.0.2.44", '/b?c=[z]"q', None)
    r = one(access.parse_access_log(lines(spark, r'2001:DB8::9 - - [03/Mar/2025:23:10:07 +0000] "\x05\x01" 400 9')))
    assert (r["ip"], r["path"], r["status_code"], r["outcome"]) == ("2001:db8::9", None, 400, "parsed")
    for bad in ("worker 3 has started", 'harbour.example - - [03/Mar/2025:23:10:07 +0000] "GET / HTTP/1.1" 200 1', '- - - [03/Mar/2025:23:10:07 +0000] "GET / HTTP/1.1" 200 1'):
        assert one(access.parse_access_log(lines(spark, bad)))["outcome"] == "parse_error"


def test_json_presets(spark):
    r = one(access.parse_access_log(lines(spark, '{"ts":1741043407.25,"request":{"remote_ip":"192.0.2.1","client_ip":"192.0.2.77","uri":"/harbour/map","headers":{"User-Agent":["gulls/3"]}},"status":503}'), "caddy"))
    assert (r["ip"], r["user_agent"], r["status_code"], r["timestamp"]) == ("192.0.2.77", "gulls/3", 503, datetime(2025, 3, 3, 23, 10, 7, 250000))
    r = one(access.parse_access_log(lines(spark, '{"ClientAddr":"192.0.2.78:999","RequestPath":"/tide","DownstreamStatus":410,"StartUTC":"2025-03-03T23:10:07.5Z"}'), "traefik"))
    assert (r["ip"], r["path"], r["status_code"], r["timestamp"]) == ("192.0.2.78", "/tide", 410, datetime(2025, 3, 3, 23, 10, 7, 500000))
    for bad in ('{"ClientAddr":"nobody"}', "{", "[1]", '{"other":1}'):
        assert one(access.parse_access_log(lines(spark, bad), "traefik"))["outcome"] == "parse_error"


def test_netfilter(spark):
    r = one(network.parse_netfilter(lines(spark, "2025-07-04T05:06:07.25-05:00 blocker kernel: [ 12.75] lan-accept IN=br0 OUT=wan0 SRC=192.0.2.8 DST=198.51.100.3 LEN=48 PROTO=UDP SPT=5353 DPT=53"), now()))
    assert (r["event_type"], r["direction"], r["timestamp"], r["port"]) == ("network_connection", "forward", datetime(2025, 7, 4, 10, 6, 7, 250000), 53)
    assert r["metadata"] == {"source": "firewall", "action": "allow", "log_prefix": "lan-accept", "in_interface": "br0", "out_interface": "wan0"}
    assert r["message"] == "allow udp 192.0.2.8:5353 -> 198.51.100.3:53"
    r = one(network.parse_netfilter(lines(spark, "Dec 30 12:00:00 gw kernel: [X AUDIT DENY] IN=eth9 SRC=192.0.2.9 DST=2001:db8::5 PROTO=TCP DPT=25"), F.lit("2027-01-02 00:00:00").cast("timestamp")))
    assert (r["event_type"], r["direction"], r["timestamp"].year, r["message"]) == ("firewall_block", "inbound", 2026, "block tcp 192.0.2.9 -> [2001:db8::5]:25")
    for line, outcome in (("link is up, 1000 Mbps", "skipped"), ("kernel: odd IN=eth0 OUT= MAC=1", "skipped"), ("kernel: odd IN=eth0 OUT= SRC= DST=192.0.2.1", "parse_error")):
        assert one(network.parse_netfilter(lines(spark, line), now()))["outcome"] == outcome


def test_windows_firewall(spark):
    rows = spark.createDataFrame([("a", 1, "\ufeff#Version: 1.5"), ("a", 2, "#Fields: date time action protocol dst-ip src-ip dst-port src-port path"), ("a", 3, "2025-07-04 05:06:07 ALLOW UDP 198.51.100.3 192.0.2.8 123 40123 SEND"), ("b", 1, "2025-07-04 05:06:08 DROP TCP 192.0.2.9 192.0.2.8 40001 445 60 S 7 0 1024 - - - RECEIVE 900")], "file string, line_no long, value string")
    a, b = network.parse_windows_firewall(rows).orderBy("file").collect()
    assert (a["ip"], a["dst_ip"], a["port"], a["direction"]) == ("192.0.2.8", "198.51.100.3", 123, "outbound")
    assert (b["ip"], b["event_type"], b["metadata"]["pid"], b["metadata"]["tcp_flags"]) == ("192.0.2.9", "firewall_block", "900", "S")


def test_windows_firewall_from_files(spark, tmp_path):
    """Files that several tasks read keep the order of their lines: a header holds for what comes after it."""
    from harrier.sources.lines import read_lines

    line = "2025-07-04 05:06:{:02d} ALLOW UDP {} {} 123 40123 SEND"
    for name, first in (("a", "dst-ip src-ip dst-port src-port"), ("b", "src-ip dst-ip src-port dst-port")):
        other = "src-ip dst-ip src-port dst-port" if name == "a" else "dst-ip src-ip dst-port src-port"
        rows = [f"#Fields: date time action protocol {first} path", *[line.format(k % 60, "198.51.100.3", "192.0.2.8") for k in range(60)], f"#Fields: date time action protocol {other} path", *[line.format(k % 60, "198.51.100.3", "192.0.2.8") for k in range(60)]]
        (tmp_path / f"{name}.log").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = network.parse_windows_firewall(read_lines(spark, str(tmp_path))).select("file", "ip").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    count = lambda name, ip: sum(r["file"].endswith(f"{name}.log") and r["ip"] == ip for r in got)
    assert len(got) == 240 and [count(n, ip) for n in "ab" for ip in ("192.0.2.8", "198.51.100.3")] == [60, 60, 60, 60]


def test_dns(spark):
    cases = {
        "dnsmasq": [("Mar  3 04:05:06 pihole-FTL[9]: query[HTTPS] Tide.Harbour.EXAMPLE from 192.0.2.5", "tide.harbour.example", "HTTPS", "192.0.2.5"), ("dnsmasq[44]: query[PTR] 5.2.0.192.in-addr.arpa from 2001:db8::3", "5.2.0.192.in-addr.arpa", "PTR", "2001:db8::3")],
        "bind": [("03-Mar-2025 04:05:06.007 queries: info: client @0x1a2b 192.0.2.6#4040 (tide.harbour.example): query: tide.harbour.example IN MX +E(0)K (192.0.2.1)", "tide.harbour.example", "MX", "192.0.2.6")],
        "unbound": [("[1741000000] unbound[7:1] info: 192.0.2.7 tide.harbour.example. AAAA IN", "tide.harbour.example", "AAAA", "192.0.2.7"), ("Mar  3 04:05:06 unbound[7:1] info: 192.0.2.7 harbour A IN ", "harbour", "A", "192.0.2.7")],
        "coredns": [('[INFO] [2001:db8::4]:5300 - 11 "NS IN harbour.example. udp 33 false 512" NOERROR', "harbour.example", "NS", "2001:db8::4")],
    }
    for server, some in cases.items():
        for line, name, kind, client in some:
            r = one(network.parse_dns(lines(spark, line), server, now()))
            assert (r["outcome"], r["domain"], r["metadata"]["query_type"], r["ip"]) == ("parsed", name, kind, client)
    assert one(network.parse_dns(lines(spark, cases["unbound"][0][0]), "unbound", now()))["timestamp"] == datetime(2025, 3, 3, 11, 6, 40)
    assert one(network.parse_dns(lines(spark, "dnsmasq[2]: cached harbour.example is 192.0.2.1"), "dnsmasq", now()))["outcome"] == "skipped"


def test_events_json(spark):
    got = network.parse_events_json(lines(spark, '[{"ip":"1.2.3.4","port":1},7]', '{"ip":"1.2.3.5","metadata_host":"h"}'), "metadata_").orderBy("ip").collect()
    assert [(r["ip"], r["error"]) for r in got] == [(None, "invalid JSON"), ("1.2.3.4", None), ("1.2.3.5", None)]
    assert got[2]["metadata"] == {"host": "h"}


def test_snapshots(spark):
    def row(at, lip, lport, rip, rport, state):
        return ("h", datetime(2026, 1, 1, 0, at), "tcp", lip, lport, rip, rport, state, 1, "nc", "0")

    listen = lambda at: row(at, "0.0.0.0", 443, "0.0.0.0", 0, "LISTEN")
    inside = lambda at: row(at, "10.0.0.5", 443, "198.51.100.7", 40000, "ESTABLISHED")
    out = lambda at, s: row(at, "10.0.0.5", 50000, "203.0.113.9", 4444, s)
    rows = [listen(1), inside(1), inside(1), out(1, "SYN_SENT"), row(1, "127.0.0.1", 1, "127.0.0.1", 2, "ESTABLISHED"), listen(2), inside(2), out(2, "ESTABLISHED"), listen(3), inside(3), row(3, "0.0.0.0", 31337, "0.0.0.0", 0, "LISTEN"), listen(4), inside(4), out(4, "ESTABLISHED")]
    df = spark.createDataFrame(rows, "host string, snapshot_ts timestamp, proto string, local_ip string, local_port int, remote_ip string, remote_port int, state string, pid int, process string, uid string")
    got = sorted((r["timestamp"].minute, r["event_type"], r["direction"] or "", r["port"]) for r in network.connection_events(df).collect())
    assert got == [(1, "network_connection", "inbound", 443), (1, "network_connection", "outbound", 4444), (3, "port_opened", "", 31337), (4, "network_connection", "outbound", 4444)]


def test_headers_over_blocks_of_a_file(spark, monkeypatch):
    """Against carrying the header line by line, in files cut into many blocks; names and values in any case."""
    import random

    monkeypatch.setattr(network, "BLOCK", 7)
    rng, rows, expect = random.Random(3), [], {}
    layouts = [network.WINDOWS_FIELDS, "Date Time Action SRC-IP Dst-Ip Protocol path", "time date src-ip action dst-ip"]
    for f in range(3):
        names = layouts[0].split()
        for n in range(60):
            if rng.random() < 0.1 or (f == 2 and n in (20, 21)):
                k = rng.randrange(3)
                names = layouts[k].lower().split()
                rows.append((f"f{f}", n, ("\ufeff" if rng.random() < 0.5 else "") + "#Fields: " + layouts[k]))
                continue
            value = {"date": "2024-05-06", "time": "07:08:09", "action": rng.choice(["DROP", "allow"]), "protocol": "UDP", "src-ip": f"192.0.2.{n}", "dst-ip": f"198.51.100.{f}", "path": rng.choice(["receive", "SEND", "Forward"])}
            rows.append((f"f{f}", n, " ".join(value.get(x, "-") for x in names)))
            expect[f"f{f}", n] = (f"192.0.2.{n}", f"198.51.100.{f}", {"receive": "inbound", "SEND": "outbound", "Forward": "forward"}[value["path"]] if "path" in names else None)
    got = network.parse_windows_firewall(spark.createDataFrame(rows, "file string, line_no long, value string")).collect()
    assert {(r["file"], r["line_no"]): (r["ip"], r["dst_ip"], r["direction"]) for r in got} == expect and {r["outcome"] for r in got} == {"parsed"}


def test_requests_of_two_words(spark):
    lines_ = ['192.0.2.4 - - [07/Mar/2024:09:08:07 +0000] "GET /only" 200 1', '192.0.2.4 - - [07/Mar/2024:09:08:07 +0000] "-" 400 0']
    got = access.parse_access_log(spark.createDataFrame([(x,) for x in lines_], "value string")).collect()
    assert [(r["path"], r["metadata"].get("method")) for r in got] == [("/only", "GET"), (None, None)]
