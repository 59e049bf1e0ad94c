"""Rules multiply rows in parts that are dealt out, whatever the source gives; counts from a time on need a rule's own window before it."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from harrier.operators import detect
from harrier.plans.rules import load_rules
from harrier.schema import EVENT_DDL

NAMES = [c.split()[0] for c in EVENT_DDL.split(", ")]
RULES = load_rules({"default_cooldown": "0s", "rules": [
    {"name": "Many", "kind": "threshold", "severity": "low", "threshold": 3, "window": "40s"},
    {"name": "Ports", "kind": "threshold", "severity": "high", "threshold": 2, "window": "3m", "distinct": "port"},
    *[{"name": f"R{i}", "kind": "threshold", "severity": "low", "threshold": 2 + i % 3, "window": f"{20 + i}s"} for i in range(10)],
]})


def _events(spark):
    rows = [{"seq": i, "timestamp": datetime(2025, 3, 1) + timedelta(seconds=7 * (i // 4) + (i % 5 == 0) * 30), "ip": f"192.0.2.{i % 4}", "event_type": "http_request", "port": i % 7 // 2 + 1} for i in range(160)]
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], EVENT_DDL)


def test_events_are_dealt_beyond_the_parts_of_their_source(spark):
    events = _events(spark).repartition(8, "ip")
    assert detect.spread(events, 40).rdd.getNumPartitions() == 40
    assert detect.spread(events, 5000).rdd.getNumPartitions() == detect.DEALT
    assert detect.spread(events, 8) is events


def test_counts_from_a_time_on_are_those_of_the_whole(spark):
    events, since = _events(spark), F.lit("2025-03-01 00:02:30").cast("timestamp")
    some = RULES.rules
    want = detect.thresholds(events, some, 4).where(F.col("timestamp") >= since)
    got = detect.thresholds(events, some, 4, since).where(F.col("timestamp") >= since)
    key = lambda df: sorted((r["seq"], r["rule"], r["count"]) for r in df.collect())
    assert key(got) == key(want) and key(got)
