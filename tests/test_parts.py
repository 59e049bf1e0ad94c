"""What is counted and judged is dealt into parts whose number grows with the events."""

from datetime import datetime, timedelta

from harrier.operators import detect
from harrier.plans.rules import load_rules
from harrier.schema import EVENT_DDL

NAMES = [c.split()[0] for c in EVENT_DDL.split(", ")]
RULES = load_rules({"default_cooldown": "30s", "rules": [
    {"name": "Many", "kind": "threshold", "severity": "low", "threshold": 3, "window": "40s"},
    {"name": "Ports", "kind": "threshold", "severity": "high", "threshold": 2, "window": "40s", "distinct": "port"},
    {"name": "Both", "kind": "correlation", "severity": "critical", "threshold": 2, "window": "1m"},
]})


def test_parts_grow_with_the_events_and_decide_nothing(spark, monkeypatch):
    rows = [{"seq": i, "timestamp": datetime(2025, 3, 1) + timedelta(seconds=5 * (i // 4)), "ip": f"192.0.2.{i % 4}", "event_type": "http_request", "port": i % 7 + 1} for i in range(240)]
    events = spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], EVENT_DDL)
    want = sorted(map(str, detect.detect(events, RULES).collect()))
    monkeypatch.setattr(detect, "EVENTS_A_PART", 20)
    assert detect.parts(events) == 12
    counted = detect.threshold(events, RULES.rules[1])
    assert counted.rdd.getNumPartitions() == 12
    assert sorted(map(str, detect.detect(events, RULES).collect())) == want
    assert detect.judged(events, RULES).where("rule <> 'Both'").rdd.getNumPartitions() >= 12
