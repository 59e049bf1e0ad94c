"""Scenarios of the detection operators, and a stream against the batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harrier.functions import fields as fn
from harrier.operators import detect, normalize
from harrier.plans.defaults import default_rules
from harrier.plans.rules import RuleSet, compile_filter, load_rules
from harrier.schema import EVENT_DDL

T0 = datetime(2026, 1, 1)


def events(spark, rows):
    """Rows of (second, fields) as events of one address."""
    names = [c.split()[0] for c in EVENT_DDL.split(", ")]
    made = []
    for i, (second, given) in enumerate(rows):
        given = {"id": str(i), "seq": i, "timestamp": T0 + timedelta(seconds=second), "ip": "198.51.100.7", "event_type": "http_request", **given}
        made.append(tuple(given.get(n) for n in names))
    return spark.createDataFrame(made, EVENT_DDL)


def rules(*names, **changes):
    return RuleSet([r for r in default_rules(**changes).rules if r.name in names])


def alerts(spark, rows, *names):
    got = detect.detect(events(spark, rows), rules(*names)).orderBy("seq").collect()
    return [(r["seq"], r["trigger_rule"], r["event_count"], list(r["related_rules"])) for r in got]


LOGIN = {"event_type": "failed_login"}


def test_brute_force_needs_five_in_the_window(spark):
    assert alerts(spark, [(i, LOGIN) for i in range(4)], "BruteForce") == []
    assert alerts(spark, [(i, LOGIN) for i in range(5)], "BruteForce") == [(4, "BruteForce", 5, [])]
    assert alerts(spark, [(20 * i, LOGIN) for i in range(10)], "BruteForce") == []


def test_window_is_open_at_its_start(spark):
    assert alerts(spark, [(0, LOGIN), (15, LOGIN), (30, LOGIN), (45, LOGIN), (60, LOGIN)], "BruteForce") == []


def test_ties_count_in_order_of_arrival(spark):
    got = detect.threshold(events(spark, [(0, LOGIN)] * 7), rules("BruteForce").rules[0]).orderBy("seq").select("seq", "count").collect()
    assert [tuple(r) for r in got] == [(4, 5), (5, 6), (6, 7)]


def test_port_scan_counts_distinct_ports(spark):
    conn = lambda p: {"event_type": "network_connection", "direction": "inbound", "port": p}
    assert [a[:3] for a in alerts(spark, [(i, conn(1000 + i)) for i in range(10)], "PortScan")] == [(9, "PortScan", 10)]
    assert alerts(spark, [(i, conn(443)) for i in range(16)], "PortScan") == []
    assert alerts(spark, [(10 * i, conn(1000 + i)) for i in range(20)], "PortScan") == []


def test_cooldown_of_a_signature(spark):
    env = {"path": "/.env"}
    assert [a[0] for a in alerts(spark, [(0, env), (30, env), (90, env)], "SensitivePath")] == [0, 2]


@pytest.mark.parametrize("path,rule,hit", [
    ("/list?sort=%27%20AND%207%3D7", "SQLInjection", 1), ("/list?n=x'+OR+(select+9)", "SQLInjection", 1), ("/news/summer--sale", "SQLInjection", 0), ("/band/and-12-more", "SQLInjection", 0),
    ("/img/..%2F..%2Fhome", "PathTraversal", 1), ("/img/%252e%252e%252fhome", "PathTraversal", 1), ("/img/a..b", "PathTraversal", 0),
    ("/run?x=1%26%26whoami", "CommandInjection", 1), ("/run?x=1&ls=2", "CommandInjection", 0),
    ("/v2/.git/HEAD", "SensitivePath", 1), ("/debugger", "SensitivePath", 0), ("/my/console-games", "SensitivePath", 0), ("/%qq50%", "XSS", 0),
])
def test_signatures(spark, path, rule, hit):
    assert len(alerts(spark, [(0, {"path": path})], rule)) == hit


def test_priority_and_related_rules(spark):
    rows = [(i, {"path": "/"}) for i in range(19)] + [(19, {"path": "/?q=' OR 1=1--"})]
    assert alerts(spark, rows, "RapidFire", "SQLInjection")[-1] == (19, "SQLInjection", 1, ["RapidFire"])


def test_correlation_of_three_rules(spark):
    rows = [(0, {"path": "/.env"}), (1, {"path": "/?q=' OR 1=1--"}), (2, {"path": "/?q=<script>"})]
    got = alerts(spark, rows, "SensitivePath", "SQLInjection", "XSS", "MultiVector")
    assert got[-1] == (2, "MultiVector", 3, ["XSS"])


def test_beacon(spark):
    out = {"event_type": "network_connection", "direction": "outbound", "dst_ip": "203.0.113.9", "port": 443}
    steady = [(60 * i + j, out) for i, j in enumerate((0, 2, -3, 1, -2, 3))]
    got = alerts(spark, steady, "Beaconing")
    assert [(a[0], a[2]) for a in got] == [(5, 6)]
    bursts = [(60 * i + k, out) for i in range(6) for k in range(3)]
    assert len(alerts(spark, bursts, "Beaconing")) == 1
    assert alerts(spark, [(s, out) for s in (0, 10, 210, 255, 855, 885)], "Beaconing") == []
    assert alerts(spark, [(60 * i, {**out, "dst_ip": "10.1.1.1"}) for i in range(6)], "Beaconing") == []


def test_history_keeps_cooldown(spark):
    e = events(spark, [(0, {"path": "/.env"}), (30, {"path": "/.env"})])
    some = rules("SensitivePath")
    old = detect.alert_history(detect.detect(e.where("seq = 0"), some))
    assert detect.detect(e.where("seq = 1"), some, old).count() == 0


def test_normalisation(spark):
    rows = events(spark, [(0, {"ip": "2001:0DB8:00:0::00C4"}), (0, {"ip": "::FFFF:10.77.3.4"}), (0, {"ip": "gateway", "port": 70000}), (0, {"event_type": "dns_query", "domain": "Cam7.Yard.Harbour.EXAMPLE."})])
    ok, bad = normalize.normalize(rows)
    got = {r["seq"]: r for r in ok.collect()}
    assert got[0]["ip"] == "2001:db8::c4" and got[1]["ip"] == "10.77.3.4"
    assert got[3]["domain"] == "cam7.yard.harbour.example" and got[3]["metadata"] == {"base_domain": "harbour.example"}
    assert [r["errors"] for r in bad.collect()] == [["ip is not a valid address", "port is out of range"]]


def test_base_domain(spark):
    given = ["cdn.eu.harbour.example", "printer", "www.harbour.go.jp", "mail.harbour.net.nz", "9.8.7.ip6.arpa", "harbour.ac.uk", "go.jp", "a.gob.mx"]
    rows = spark.createDataFrame([(g,) for g in given], "d string").select(fn.base_domain(F.col("d"))).collect()
    assert [r[0] for r in rows] == ["harbour.example", "printer", "harbour.go.jp", "harbour.net.nz", "ip6.arpa", "harbour.ac.uk", "go.jp", "gob.mx"]


def test_addresses_as_the_standard_library_writes_them(spark):
    import ipaddress
    import random

    rng = random.Random(7)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1", "1:", "12345::", "g::", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "fe80::a%en1", "1.2.3", "01.2.3.4", "", "a b"]
    for _ in range(300):
        groups = [rng.choice(["0", "0", "0000", f"{rng.randrange(65536):x}", f"{rng.randrange(256):04X}"]) for _ in range(8)]
        text = ":".join(groups)
        if rng.random() < 0.5:
            i, j = sorted(rng.sample(range(9), 2))
            text = ":".join(groups[:i]) + "::" + ":".join(groups[j:])
        texts.append(text)

    def expect(text):
        try:
            ip = ipaddress.ip_address(text.split("%")[0])
        except ValueError:
            return None
        return str(getattr(ip, "ipv4_mapped", None) or ip)

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.normalize_ip(F.col("t")).alias("ip")).collect()
    assert [(r["t"], r["ip"]) for r in got] == [(t, expect(t)) for t in texts]


def test_networks(spark):
    rows = events(spark, [(0, {"ip": "10.1.2.3"}), (0, {"ip": "2001:db8::1"}), (0, {"ip": "192.0.2.1"})])
    when = {"except": [{"ip": ["10.0.0.0/8", "2001:db8::/32"]}]}
    assert [r[0] for r in rows.where(compile_filter(when)).select("seq").collect()] == [2]


def test_invalid_rules():
    base = {"name": "a", "kind": "threshold", "severity": "low", "threshold": 3, "window": "1m"}
    load_rules({"rules": [base]})
    for change in ({"kind": "x"}, {"severity": "urgent"}, {"threshold": 0}, {"window": "soon"}, {"Window": "1m"}, {"distinct": "nope"}, {"when": {"except": [{}]}}):
        with pytest.raises(ValueError):
            load_rules({"rules": [{**base, **change}]})
    with pytest.raises(ValueError):
        load_rules('{"rules": [], "rules": []}')


def test_stream_equals_batch(spark, tmp_path):
    from harrier.streaming import jobs

    rows = [(i, {"path": "/" if i % 4 else "/.env"}) for i in range(30)] + [(40 + i, LOGIN) for i in range(7)]
    some = rules("SensitivePath", "RapidFire", "BruteForce", "MultiVector", MultiVector={"threshold": 2})
    e = events(spark, rows)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT_DDL).parquet(str(tmp_path / "in"))
    q = jobs.stream_detect(stream, some).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r["seq"], r["trigger_rule"], r["event_count"], list(r["related_rules"]))
    assert sorted(map(key, spark.table("found").collect())) == sorted(map(key, detect.detect(e, some).collect()))
