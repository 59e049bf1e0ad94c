"""Detection against a plain engine that takes one event after the other."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from harrier.functions.fields import micros
from harrier.operators import detect
from harrier.plans.rules import load_rules
from harrier.schema import EVENT_DDL, SEVERITIES

T0 = datetime(2025, 3, 1)
NAMES = [c.split()[0] for c in EVENT_DDL.split(", ")]
RULES = {
    "default_cooldown": "20s",
    "rules": [
        {"name": "Word", "kind": "signature", "severity": "low", "description": "Word", "fields": ["path", "message"], "contains": ["zebra", "quagga"]},
        {"name": "Pattern", "kind": "signature", "severity": "high", "description": "Pattern", "fields": ["path"], "regex": ["okapi[0-9]+"], "cooldown": "0s", "when": {"event_types": ["http_request"]}},
        {"name": "Many", "kind": "threshold", "severity": "medium", "description": "Many", "threshold": 4, "window": "30s", "reason": "{count} from {ip} in {window}"},
        {"name": "Ports", "kind": "threshold", "severity": "medium", "description": "Ports", "threshold": 3, "window": "25s", "distinct": "port", "when": {"event_types": ["network_connection"]}},
        {"name": "Names", "kind": "threshold", "severity": "high", "description": "Names", "threshold": 2, "window": "40s", "distinct": "path", "group_by": "protocol", "cooldown": "35s"},
        {"name": "Steady", "kind": "beacon", "severity": "medium", "description": "Steady", "threshold": 3, "window": "10m", "group_by": "dst_ip", "min_interval": "10s", "max_jitter": 0.4, "cooldown": "15s"},
        {"name": "Several", "kind": "correlation", "severity": "critical", "description": "Several", "threshold": 3, "window": "45s", "cooldown": "1m"},
    ],
}


def made(seed, n=350):
    rng = random.Random(seed)
    rows, at = [], 0
    for seq in range(n):
        at += rng.choice([0, 0, 1, 2, 3, 5, 11, 12, 13, 40])
        kind = rng.choice(["http_request", "network_connection"])
        rows.append({"seq": seq, "timestamp": T0 + timedelta(seconds=at), "ip": rng.choice(["192.0.2.1", "192.0.2.1", "2001:db8::7"]), "event_type": kind, "path": rng.choice([None, "/a", "/b?x=%7Aebra", "/okapi12", "/c"]) if kind == "http_request" else None, "message": rng.choice([None, "a QUAGGA ran", "nothing"]), "port": rng.choice([None, 22, 80, 443]), "protocol": rng.choice([None, "tcp", "udp"]), "dst_ip": rng.choice([None, "198.51.100.1", "198.51.100.2"])})
    return rows


def table(spark, rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], EVENT_DDL)


def replay(rows, rules=RULES):
    """(seq, rule, count, severity, related) of each alert, one event after the other."""
    order = {r["name"]: i for i, r in enumerate(rules["rules"])}
    links = [r for r in rules["rules"] if r["kind"] == "correlation"]
    seen, contacts, kept, out = defaultdict(list), defaultdict(list), defaultdict(dict), []
    for e in sorted(rows, key=lambda r: (r["timestamp"], r["seq"])):
        now, ip, fired = e["timestamp"], e["ip"], {}
        ago = lambda t: (now - t) // timedelta(microseconds=1)  # noqa: E731,B023
        for r in rules["rules"]:
            if r.get("when") and e["event_type"] not in r["when"]["event_types"]:
                continue
            if r["name"] == "Word" and ("zebra" in (e["path"] or "").replace("%7A", "z") or "quagga" in (e["message"] or "").lower()):
                fired["Word"] = 1
            if r["name"] == "Pattern" and "okapi1" in (e["path"] or ""):
                fired["Pattern"] = 1
            if r["kind"] == "threshold":
                group, value = (e[r[k]] if r.get(k) else "" for k in ("group_by", "distinct"))
                if group is not None and value is not None:
                    mine = seen[ip, r["name"], group]
                    mine.append((now, str(value)))
                    live = [v for t, v in mine if ago(t) < micros(r["window"])]
                    if (n := len(set(live)) if r.get("distinct") else len(live)) >= r["threshold"]:
                        fired[r["name"]] = n
            if r["kind"] == "beacon" and e["dst_ip"]:
                mine = contacts[ip, e["dst_ip"]]
                if not mine or ago(mine[-1]) >= micros(r["min_interval"]) // 2:
                    mine.append(now)
                    last = mine[-r["threshold"] :]
                    gaps = [(b - a).total_seconds() for a, b in zip(last, last[1:], strict=False)]
                    if len(last) == r["threshold"] and ago(last[0]) < micros(r["window"]) and fmean(gaps) >= 10 and pstdev(gaps) / fmean(gaps) <= r["max_jitter"]:
                        fired["Steady"] = r["threshold"]
        plain = {*fired}
        for r in links if fired else ():
            live = (plain | {k for k, t in kept[ip].items() if ago(t) < micros(r["window"])}) - {r["name"]}
            if len(live) >= r["threshold"]:
                fired[r["name"]] = len(live)
        stay = [n for n in fired if not (c := micros(rules["rules"][order[n]].get("cooldown", "20s"))) or n not in kept[ip] or ago(kept[ip][n]) >= c]
        for n in stay:
            kept[ip][n] = now
        if stay:
            rank = lambda n: (-SEVERITIES.index(rules["rules"][order[n]]["severity"]), order[n])
            top = min(stay, key=rank)
            out.append((e["seq"], top, fired[top], rules["rules"][order[top]]["severity"], tuple(sorted((n for n in stay if n != top), key=order.get))))
    return sorted(out)


def found(alerts):
    return sorted((r["seq"], r["trigger_rule"], r["event_count"], r["severity"], tuple(r["related_rules"])) for r in alerts.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_alerts_as_replayed(spark, seed):
    rows = made(seed)
    got = found(detect.detect(table(spark, rows), load_rules(RULES)))
    assert got == replay(rows) and {a[1] for a in got} >= {"Several", "Names", "Pattern"}


def correlated(n):
    """The rules with n correlations more, each of which one of the others' alerts may complete."""
    more = [{"name": f"Chain{i}", "kind": "correlation", "severity": "high", "description": "Chain", "threshold": 4 + i, "window": f"{60 + 40 * i}s", "cooldown": f"{25 + 10 * i}s"} for i in range(n)]
    return {**RULES, "rules": RULES["rules"] + more}


@pytest.mark.parametrize("n", [1, 2])
def test_several_correlations_as_replayed(spark, n):
    rows, rules = made(20 + n), correlated(n)
    got = found(detect.detect(table(spark, rows), load_rules(rules)))
    assert got == replay(rows, rules) and any("Chain0" in (a[1], *a[4]) for a in got)


@pytest.mark.parametrize("second", [300, 900, 1500, 2100])
def test_any_cut_gives_the_whole(spark, second):
    """All rules, three correlations among them: a halo of events and the alerts stored before a time give what the whole gives after it."""
    rules, rows = load_rules(correlated(2)), made(30)
    whole, cut = table(spark, rows), F.lit(T0 + timedelta(seconds=second)).cast("timestamp")
    every = detect.detect(whole, rules)
    old, new = every.where(F.col("timestamp") < cut), detect.detect_since(whole, every, rules, cut)
    assert sorted(found(old) + found(new)) == found(every) and new.count() > 0


def test_stored_days_before_the_halo_are_not_read(spark, tmp_path):
    from harrier.operators import report

    rows = [{"seq": i, "timestamp": T0 + timedelta(hours=i), "ip": "192.0.2.1", "event_type": "http_request", "path": "/zebra"} for i in range(240)]
    report.write_events(table(spark, rows), str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    rules, cut = load_rules(RULES), F.lit(T0 + timedelta(days=9)).cast("timestamp")
    got = detect.detect_since(stored, detect.detect(stored, rules), rules, cut)
    assert got.count() == 24
    plan = detect._from(stored, cut, detect.halo(rules))._jdf.queryExecution().executedPlan()
    read = plan.collectLeaves().head().selectedPartitions() if hasattr(plan, "collectLeaves") else None
    assert "PartitionFilters: [isnotnull(event_date" in plan.toString() and read is not None


def test_reasons(spark):
    got = detect.detect(table(spark, made(4)), load_rules(RULES)).where("trigger_rule = 'Many'").collect()
    assert got and all(r["reason"] == f"{r['event_count']} from {r['ip']} in 30s" for r in got)


def test_one_address_with_all_events(spark):
    """A flood within and across chunks of time, against counting every window anew."""
    rng = random.Random(5)
    times = sorted(rng.randrange(0, 900_000_000) for _ in range(3000))
    rows = [{"seq": i, "timestamp": T0 + timedelta(microseconds=t), "ip": "192.0.2.9", "event_type": "network_connection", "port": rng.randrange(1, 60)} for i, t in enumerate(times)]
    rules = {r.name: r for r in load_rules(RULES).rules}
    got = {(r["rule"], r["seq"]): r["count"] for r in detect.thresholds(table(spark, rows), [rules["Many"], rules["Ports"]]).collect()}
    expect = {}
    for i, t in enumerate(times):
        for name, w, least in (("Many", 30, 4), ("Ports", 25, 3)):
            live = [rows[j]["port"] for j in range(i, -1, -1) if t - times[j] < w * 1_000_000] if i < 400 or i > 2600 else []
            n = len(live) if name == "Many" else len(set(live))
            if n >= least:
                expect[name, i] = n
    assert {k: v for k, v in got.items() if k[1] < 400 or k[1] > 2600} == expect


def test_spaced_rows_as_a_loop_keeps_them(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), rng.choice([0, 7, 50]), T0 + timedelta(seconds=rng.randrange(400)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, gap long, timestamp timestamp, seq long").withColumn("gap", F.col("gap") * 1_000_000)
    expect, last = set(), {}
    for k, gap, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if not gap or (k, gap) not in last or (t - last[k, gap]).total_seconds() >= gap:
            expect.add(i)
            last[k, gap] = t
    assert {r["seq"] for r in detect.spaced(df, ["k", "gap"], F.col("gap")).collect()} == expect


def test_incremental_equals_whole_where_windows_do_not_cross(spark):
    """Signatures and correlations continue from stored alerts; counts start anew."""
    some = load_rules({**RULES, "rules": [r for r in RULES["rules"] if r["kind"] in ("signature", "correlation")]})
    rows = made(7)
    whole, cut = table(spark, rows), T0 + timedelta(seconds=900)
    old = detect.detect(whole.where(F.col("timestamp") < cut), some)
    new = detect.detect(whole.where(F.col("timestamp") >= cut), some, detect.alert_history(old))
    assert sorted(found(old) + found(new)) == found(detect.detect(whole, some))
