"""Limits, lookback, durations, stored tables, retention and reports."""

import ipaddress
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_engine import RULES, made, table

from harrier.functions import fields as fn
from harrier.operators import analysis, detect, networks, normalize, report
from harrier.plans.defaults import default_rules
from harrier.plans.rules import Rule, RuleSet, load_rules, register_rule_kind
from harrier.schema import EVENT_DDL
from harrier.sources.lines import keep_only

T0 = datetime(2025, 3, 1)


def test_limits():
    assert [report.check_limit(n) for n in (1, 100, 1000)] == [1, 100, 1000]
    for bad in (0, -1, 1001):
        with pytest.raises(ValueError):
            report.check_limit(bad)


def test_durations(spark):
    cases = {"30s": "30s", "1m": "1m0s", "90s": "1m30s", "2h": "2h0m0s", "1h5m": "1h5m0s", "1500ms": "1.5s"}
    assert {k: fn.duration_text(fn.micros(k)) for k in cases} == cases
    whole = [k for k in cases if k != "1500ms"]
    rows = spark.createDataFrame([(k, fn.micros(k)) for k in whole], "k string, us long").select("k", fn.duration_column(F.col("us")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in rows} == {k: cases[k] for k in whole}


def test_lookback_covers_cooldowns_and_correlations():
    assert load_rules(RULES).lookback() == fn.micros("1m")
    assert default_rules().lookback() == fn.micros("1h") and RuleSet([]).lookback() == 0


def test_default_rules():
    rules = default_rules()
    assert [r.name for r in rules.order()][-1] == "MultiVector" and len(rules.rules) == 20
    kinds = {k: sum(r.kind == k for r in rules.rules) for k in ("signature", "threshold", "beacon", "correlation")}
    assert kinds == {"signature": 9, "threshold": 9, "beacon": 1, "correlation": 1}
    limits = {r.name: (r.threshold, r.window) for r in rules.rules if r.kind == "threshold"}
    assert limits == {"PortScan": (10, "1m"), "NetworkSweep": (10, "1m"), "DNSTunneling": (50, "1m"), "NewListeningPort": (1, "1m"), "BlockedConnectionFlood": (100, "1m"), "BruteForce": (5, "1m"), "DirectoryEnumeration": (15, "1m"), "AccessDeniedFlood": (10, "1m"), "RapidFire": (20, "30s")}


def test_registered_kinds(spark):
    def loud(rule: Rule):
        return lambda e: e.where(F.col("port") >= rule.threshold).select("seq", "ip", "timestamp", F.lit(rule.name).alias("rule"), F.lit(7).alias("count"), *[F.lit(None).cast(t).alias(n) for n, t in (("pattern", "string"), ("field", "string"), ("group", "string"), ("interval_us", "double"), ("jitter", "double"))])

    register_rule_kind("loud", loud)
    some = load_rules({"default_cooldown": "0s", "rules": [{"name": "Loud", "kind": "loud", "severity": "high", "threshold": 100, "reason": "{count} at {event.port}"}]})
    got = detect.detect(table(spark, made(3)), some).collect()
    assert {r["seq"] for r in got} == {r["seq"] for r in made(3) if (r["port"] or 0) >= 100} and {r["reason"] for r in got} == {"7 at 443"}


def test_stored_events_prune_by_day_and_address(spark, tmp_path):
    rows = [{**r, "timestamp": T0 + timedelta(hours=r["seq"] % 60)} for r in made(5, 120)]
    report.write_events(table(spark, rows), str(tmp_path / "events"))
    days = sorted(p.name for p in (tmp_path / "events").glob("event_date=*"))
    assert days == ["event_date=2025-03-01", "event_date=2025-03-02", "event_date=2025-03-03"]
    assert all(list((tmp_path / "events" / d).glob("*.parquet")) for d in days)
    back = spark.read.parquet(str(tmp_path / "events"))
    assert back.count() == 120 and {r["seq"] for r in back.where("event_date = '2025-03-02'").select("seq").collect()} == {r["seq"] for r in rows if r["timestamp"].day == 2}


def test_retention(spark):
    e = table(spark, made(6, 90))
    for n in (0, 1, 17, 89, 90, 500):
        assert sorted(r["seq"] for r in report.by_capacity(e, n).collect()) == list(range(max(0, 90 - n) if n else 0, 90))
    assert report.by_capacity(table(spark, []), 5).count() == 0


def test_retention_of_stored_tables(spark, tmp_path):
    """Against a list of rows; days that the cut does not go through keep their files."""
    base = [{**r, "timestamp": None if r["seq"] % 29 == 0 else T0 + timedelta(hours=(r["seq"] * 7) // 10)} for r in made(11, 200)]
    now = T0 + timedelta(days=6)
    for i, (age, capacity) in enumerate([(None, 0), ("100 hours", 0), ("96 hours", 0), (None, 90), ("2 days", 7), ("1 hour", 1), ("400 days", 500)]):
        path = tmp_path / f"t{i}"
        report.write_events(table(spark, base), str(path))
        before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
        hours = {None: None, "100 hours": 100, "96 hours": 96, "2 days": 48, "1 hour": 1, "400 days": 9600}[age]
        young = [r for r in base if hours is None or r["timestamp"] is None or r["timestamp"] >= now - timedelta(hours=hours)]
        left = sorted(young, key=lambda r: r["seq"])[-capacity:] if capacity else young
        for again in (False, True):
            went = {r["reason"]: r["count"] for r in report.prune_stored(spark, str(path), "event", F.lit(now), age, capacity).collect()}
            assert went == ({"age": 0, "capacity": 0} if again else {"age": len(base) - len(young), "capacity": len(young) - len(left)})
            kept = spark.read.schema(EVENT_DDL).parquet(str(path)).collect()
            assert sorted((r["seq"], r["timestamp"], r["ip"], r["path"]) for r in kept if r["timestamp"]) == sorted((r["seq"], r["timestamp"], r["ip"], r["path"]) for r in left if r["timestamp"])
            assert sorted(r["seq"] for r in kept) == sorted(r["seq"] for r in left)
        day = lambda r: "__HIVE_DEFAULT_PARTITION__" if r["timestamp"] is None else str(r["timestamp"].date())
        lost = {day(r) for r in base} - {day(r) for r in left}
        touched = {day(r) for r in base if r not in left}
        after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
        name = lambda p: p.parent.name.removeprefix("event_date=")
        assert {p: t for p, t in before.items() if name(p) not in touched} == {p: t for p, t in after.items() if name(p) not in touched}
        assert not {name(p) for p in after} & lost
    (path / "_spark_metadata").mkdir()
    with pytest.raises(ValueError):
        report.prune_stored(spark, str(path), "event", F.lit(now), "1 day")


def test_the_cut_of_a_capacity(spark, monkeypatch):
    monkeypatch.setattr(report, "BLOCKS", 5)
    rng = random.Random(12)
    seqs = [rng.randrange(-50, 1 << 40) for _ in range(60)] + [7, 7, 7, 1 << 62]
    rows = spark.createDataFrame([(s,) for s in seqs] + [(None,)], "seq long")
    for n in (1, 5, 59, 62, 63, 64, 100):
        cut = report.capacity_cut(rows, n)
        assert cut == (sorted(seqs)[-n - 1] if n < len(seqs) else None)
    assert report.capacity_cut(rows.limit(0), 3) is None and report.capacity_cut(rows, 0) is None


def test_evidence_of_alerts(spark):
    rows = made(7, 150)
    e = table(spark, rows)
    a = e.where("seq % 9 = 0").select("ip", "seq", "timestamp")
    got = {(r["seq"], r["event_seq"]) for r in report.alerts_with_events(a, e, "45 seconds").collect()}
    expect = {(x["seq"], y["seq"]) for x in rows if x["seq"] % 9 == 0 for y in rows if x["ip"] == y["ip"] and timedelta(0) <= x["timestamp"] - y["timestamp"] < timedelta(seconds=45)}
    assert got == expect


def test_address_report_and_overview(spark):
    e = table(spark, made(8, 120))
    alerts = detect.detect(e, load_rules(RULES))
    got = report.ip_report(e, alerts, "192.0.2.1", 5, 10)
    mine = sorted((r for r in made(8, 120) if r["ip"] == "192.0.2.1"), key=lambda r: (r["timestamp"], r["seq"]), reverse=True)
    assert [r["seq"] for r in got["events"].collect()] == [r["seq"] for r in mine[:10]] and got["alerts"].count() <= 5
    shown = report.overview(e, alerts, F.lit(T0 + timedelta(hours=1)))
    assert shown["summary"].collect()[0]["total"] == alerts.count() and set(shown) == {"summary", "top_ips", "top_rules", "latest", "stats"}


def test_rejected_items_name_all_that_is_wrong(spark):
    rows = [{"seq": 0, "timestamp": T0, "ip": "192.0.2.1"}, {"seq": 1, "timestamp": T0, "ip": "", "port": -1}, {"seq": 2, "timestamp": T0, "ip": "::1", "dst_ip": "x", "direction": "sideways"}]
    got = {r["index"]: r["error"] for r in normalize.ingest_errors(table(spark, rows)).collect()}
    assert got == {1: "ip is required; port is out of range", 2: "dst_ip is not a valid address; direction is unknown"}


def test_keep_only(spark):
    e = table(spark, made(9, 60))
    assert {r["seq"] for r in keep_only(e, ["http_request"], ("path",)).collect()} == {r["seq"] for r in made(9, 60) if r["event_type"] == "http_request" and r["path"]}
    assert keep_only(e).count() == 60


def test_answers_of_a_review(spark):
    answers = ['{"verdict": "UNKNOWN", "confidence": "low", "category": "c", "summary": "s", "recommended_action": "r"}', '{"verdict": "inconclusive", "confidence": "low", "summary": "s"}', '{"verdict": "malicious", "confidence": "certain", "summary": "s"}', "no"]
    rows = spark.createDataFrame(list(enumerate(answers)), "id long, answer string").select(F.col("id").cast("string").alias("id"), "answer")
    got = {int(r["id"]): r["status"] for r in analysis.parse_analysis(rows).collect()}
    assert got == {0: "completed", 1: "failed", 2: "failed", 3: "failed"}


def test_evidence_equals_pairs(spark):
    rng = random.Random(5)
    at = lambda: None if rng.random() < 0.05 else T0 + timedelta(seconds=rng.randrange(900))
    events = [(rng.choice(["a", "b", "busy", "busy"]), at()) for _ in range(600)]
    events += [("busy", T0 + timedelta(seconds=300))] * 40
    alerts = [(i, rng.choice(["a", "b", "busy", "quiet"]), at()) for i in range(120)]
    e = spark.createDataFrame(events, "ip string, timestamp timestamp")
    a = spark.createDataFrame(alerts, "seq long, ip string, timestamp timestamp")
    got = {r["seq"]: r["evidence"] for r in report.evidence_counts(a, e, "45 seconds").collect()}
    w = timedelta(seconds=45)
    assert got == {i: None if t is None else sum(x == ip and s is not None and t - w < s <= t for x, s in events) for i, ip, t in alerts}
    assert report.evidence_counts(a.limit(0), e, "45 seconds").count() == 0
    assert {r["evidence"] for r in report.evidence_counts(a.where("timestamp IS NOT NULL"), e.limit(0), "45 seconds").collect()} == {0}


def test_networks_equal_brute_force(spark):
    rng = random.Random(6)
    v4 = lambda: str(ipaddress.ip_address(0x0A000000 + rng.randrange(1 << 16)))
    v6 = lambda: str(ipaddress.ip_address((0x20010DB8 << 96) + rng.randrange(1 << 20)))
    nets = [f"{v4()}/{rng.randrange(22, 33)}" for _ in range(150)] + [f"{v6()}/{rng.randrange(112, 129)}" for _ in range(60)] + [v4(), v6(), "10.0.0.0/33", "nonsense", None, "10.0.0.0/", "::ffff:10.0.7.0/120"]
    ips = [v4() for _ in range(200)] + [v6() for _ in range(80)] + ["no address", None]
    n = spark.createDataFrame([(x,) for x in nets], "network string")
    e = spark.createDataFrame(list(enumerate(ips)), "seq long, ip string")

    def known(text):
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            return None
        mapped = net.network_address.ipv4_mapped if net.version == 6 else None
        return ipaddress.ip_network(f"{mapped}/{net.prefixlen - 96}") if mapped else net

    real = {k for k in map(known, filter(None, nets)) if k}
    held = {ip: max((k.prefixlen for k in real if ipaddress.ip_address(ip) in k), default=None) for ip in ips if ip and ip != "no address"}
    got = {r["ip"]: r["bits"] for r in networks.narrowest_network(e, n).collect()}
    assert got == {ip: b for ip, b in held.items() if b is not None} and 20 < len(got) < len(held)
    inside = {i for i, ip in enumerate(ips) if held.get(ip) is not None}
    assert {r["seq"] for r in networks.within(e, n).collect()} == inside
    assert {r["seq"] for r in networks.outside(e, n).collect()} == set(range(len(ips))) - inside
    assert {r["seq"] for r in networks.outside(e, n, when=F.col("seq") % 2 == 0).collect()} == {i for i in range(len(ips)) if i % 2 or i not in inside}
    assert networks.within(e, n.limit(0)).count() == 0
    plan = networks.address_networks(e, n)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
