"""Structured Streaming: ingest, signatures, counters, stateful detection, snapshot differences.

Batch replays events in order of (timestamp, seq); a stream sorts each micro-batch of an address so.
Windows, cooldowns and correlations use event time. Events later than the watermark may be counted
too low, never wrongly rejected; state that no window can reach any more is dropped.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right, insort
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harrier.functions.fields import field, micros
from harrier.operators.normalize import assign_ids, checked, fix_timestamps, normalize
from harrier.plans.rules import RuleSet, compile_filter, matches_signature, with_signatures
from harrier.schema import SEVERITIES


def stream_ingest(events: DataFrame, path: str, checkpoint: str):
    """Accepted events of a stream as Parquet by day; gives the running query."""
    accepted, _ = normalize(fix_timestamps(events, F.current_timestamp()))
    rows = assign_ids(accepted).withColumn("event_date", F.to_date("timestamp"))
    return rows.writeStream.format("parquet").partitionBy("event_date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_outcomes(events: DataFrame, path: str, checkpoint: str, late: str = "10m", trigger: dict | None = None):
    """Every row of a stream to one table, by outcome: accepted, rejected (with its errors), or late; gives the running query.

    A row is late when its time is more than `late` before the newest accepted time of the batches before its own, as a watermark
    has it; one exactly that late is accepted, and in the first batch none is late. Late rows are kept, however late, and do not
    move the mark, nor do rows that got the receive time for want of their own. Rejected rows have no place in time and are never late.

    The table is cut by batch, outcome and day. Beside it, `path`_counts holds a row a batch: its counts and newest time,
    taken while the batch was written. A batch that is replayed after a failure replaces what its first attempt wrote, and
    sees the marks of the batches before it only, so nothing is counted twice.
    """
    span, counts = micros(late), f"{path}_counts"
    spec = "newest long, accepted long, rejected long, late long, batch long"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.createDataFrame([], spec)
        if number:
            known = spark.read.schema(spec).parquet(counts)
        mark = known.where(F.col("batch") < number).agg(F.max("newest")).first()[0]  # one row
        rows = checked(fix_timestamps(assign_ids(batch.withColumn("__sent", F.col("timestamp"))), F.current_timestamp()))
        behind = F.lit(False) if mark is None else F.coalesce(F.unix_micros("timestamp") < mark - span, F.lit(False))
        rows = rows.withColumn("outcome", F.when(F.size("errors") > 0, "rejected").when(behind, "late").otherwise("accepted")).withColumn("event_date", F.to_date("timestamp"))
        seen = Observation()
        of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
        rows = rows.observe(seen, F.max(F.when((F.col("outcome") == "accepted") & (F.col("__sent") == F.col("timestamp")), F.unix_micros("timestamp"))).alias("newest"), of("accepted"), of("rejected"), of("late"))
        rows.drop("__sent").write.mode("overwrite").partitionBy("outcome", "event_date").parquet(f"{path}/batch={number}")
        got = seen.get
        one = spark.createDataFrame([(got["newest"], got["accepted"], got["rejected"], got["late"])], spec.removesuffix(", batch long"))
        one.coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_signatures(events: DataFrame, rules: RuleSet) -> DataFrame:
    """Firings of the signature rules; no state."""
    found = with_signatures(events, [r for r in rules.active if r.kind == "signature"])
    return found.select("seq", "ip", "timestamp", "sig.rule", "sig.pattern", "sig.field")


def stream_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows."""
    got = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", window).alias("w"), "event_type").agg(F.count("*").alias("count"))
    return got.select(F.col("w.start").alias("start"), "event_type", "count")


class _Seen:
    """The events of a window in order of time, and how often each value occurs among them."""

    def __init__(self):
        self.rows: deque = deque()
        self.values: Counter = Counter()

    def add(self, at: int, value: str, window: int, distinct: bool) -> int:
        """How many events, or distinct values, the window up to `at` then holds. An event that comes late is put in its place."""
        rows = self.rows
        if rows and at < rows[-1][0]:
            insort(rows, (at, value))
            self.values[value] += 1
            first, last = bisect_right(rows, at - window, key=lambda r: r[0]), bisect_right(rows, at, key=lambda r: r[0])
            return len({rows[i][1] for i in range(first, last)}) if distinct else last - first
        rows.append((at, value))
        self.values[value] += 1
        while rows[0][0] <= at - window:
            _, old = rows.popleft()
            self.values[old] -= 1
            if not self.values[old]:
                del self.values[old]
        return len(self.values) if distinct else len(rows)


class _Address:
    """What an address's next event is judged by: events in windows, last contacts, and what was kept when."""

    def __init__(self):
        self.seen: dict[tuple, _Seen] = {}
        self.contacts: dict[tuple, list] = {}
        self.kept: dict[str, int] = {}

    def count(self, rule: dict, group: str, at: int, value: str) -> int:
        return self.seen.setdefault((rule["name"], group), _Seen()).add(at, value, rule["window"], bool(rule["distinct"]))

    def contact(self, rule: dict, group: str, at: int) -> bool:
        seen = self.contacts.get((rule["name"], group), [])
        if seen and seen[-1] + rule["min_interval"] // 2 > at:
            return False
        seen = self.contacts[rule["name"], group] = [*seen, at][-rule["threshold"] :]
        if len(seen) < rule["threshold"] or seen[0] + rule["window"] <= at:
            return False
        steps = [b - a for a, b in zip(seen, seen[1:], strict=False)]
        mean = sum(steps) / len(steps)
        spread = (sum((s - mean) ** 2 for s in steps) / len(steps)) ** 0.5
        return mean >= rule["min_interval"] and spread / mean <= rule["max_jitter"]

    def forget(self, before: int) -> None:
        self.seen = {k: v for k, v in self.seen.items() if v.rows[-1][0] > before}
        self.contacts = {k: v for k, v in self.contacts.items() if v[-1] > before}
        self.kept = {k: t for k, t in self.kept.items() if t > before}


def _judge(plan: list[dict], horizon: int):
    names = ["seq", "timestamp", "severity", "event_count", "trigger_rule", "related_rules"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # silent for longer than anything looks back
            state.remove()
            yield pd.DataFrame([], columns=names).assign(ip=key[0])
            return
        address, latest = pickle.loads(state.get[0]) if state.exists else (_Address(), 0)
        rows = pd.concat(list(batches)).sort_values(["us", "seq"])
        out, at = [], 0
        for seq, at, met, groups, values in zip(rows["seq"], rows["us"], rows["met"], rows["groups"], rows["vals"], strict=True):
            at = int(at)
            fired = {}
            for i, r in enumerate(plan):
                if r["kind"] == "correlation" or not met[i]:
                    continue
                if r["kind"] == "signature":
                    fired[r["name"]] = (r, 1)
                elif r["kind"] == "threshold" and groups[i] is not None and values[i] is not None:
                    n = address.count(r, groups[i], at, values[i])
                    if n >= r["threshold"]:
                        fired[r["name"]] = (r, n)
                elif r["kind"] == "beacon" and groups[i] is not None and address.contact(r, groups[i], at):
                    fired[r["name"]] = (r, r["threshold"])
            now = set(fired)  # correlations see rules that fire now, and what all, other correlations too, kept before
            for r in plan:
                if r["kind"] == "correlation" and now:
                    seen = (now | {k for k, t in address.kept.items() if t > at - r["window"]}) - {r["name"]}
                    if len(seen) >= r["threshold"]:
                        fired[r["name"]] = (r, len(seen))
            kept = [(r, n) for r, n in fired.values() if not (r["cooldown"] and address.kept.get(r["name"], at - r["cooldown"]) > at - r["cooldown"])]
            if kept:
                for r, _ in kept:
                    address.kept[r["name"]] = at
                order = {r["name"]: i for i, r in enumerate(plan)}
                top = min(kept, key=lambda x: (-x[0]["rank"], order[x[0]["name"]]))
                out.append((seq, pd.Timestamp(at, unit="us", tz="UTC"), top[0]["severity"], top[1], top[0]["name"], [r["name"] for r, _ in sorted(kept, key=lambda x: order[x[0]["name"]]) if r is not top[0]]))
        latest = max(latest, at)
        address.forget(latest - horizon)
        state.update((pickle.dumps((address, latest)),))
        state.setTimeoutTimestamp(max((latest + horizon) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=names).assign(ip=key[0])

    return run


def stream_detect(events: DataFrame, rules: RuleSet, late: str = "10 minutes") -> DataFrame:
    """Alerts of a stream: conditions, groups and values are columns; windows and cooldowns are state of each address.

    An address that is silent for longer than any rule looks back loses its state. Rows later than `late` are not seen;
    those that come late within it are counted in their place, and what was judged before stays.
    """
    order = rules.order()
    if other := [r.name for r in order if r.kind not in ("signature", "threshold", "beacon", "correlation")]:
        raise ValueError(f"rules of registered kinds have no streaming form: {other}")
    span = lambda text: micros(text) if text else 0
    plan = [{"name": r.name, "kind": r.kind, "severity": r.severity, "rank": SEVERITIES.index(r.severity), "threshold": r.threshold, "window": span(r.window), "distinct": r.distinct, "min_interval": span(r.min_interval), "max_jitter": r.max_jitter, "cooldown": rules.cooldown(r)} for r in order]
    met = F.array(*[F.coalesce(compile_filter(r.when) & (matches_signature(r).isNotNull() if r.kind == "signature" else F.lit(True)), F.lit(False)) for r in order])
    groups = F.array(*[field(r.group_by) if r.group_by else F.lit("") for r in order])
    values = F.array(*[field(r.distinct) if r.distinct else F.lit("") for r in order])
    rows = events.withWatermark("timestamp", late).select("ip", "seq", "timestamp", F.unix_micros("timestamp").alias("us"), met.alias("met"), groups.alias("groups"), values.alias("vals")).where(F.exists("met", lambda m: m))
    schema = "seq long, timestamp timestamp, severity string, event_count int, trigger_rule string, related_rules array<string>, ip string"
    horizon = max([rules.lookback(), *(p["window"] for p in plan)])
    return rows.groupBy("ip").applyInPandasWithState(_judge(plan, horizon), schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def _snapshot(host: str, at, rows: list[tuple], before: dict, loopback: bool) -> tuple[list[tuple], dict]:
    """What a snapshot holds that the one before does not, and what the next one is compared with; rows: (proto, local_ip, local_port, remote_ip, remote_port, state)."""
    listeners = {r[:3] for r in rows if r[5] == "LISTEN"}
    ports = {(r[0], r[2]) for r in listeners if r}
    inside = lambda ip: ip.startswith("127.") or ip == "::1"
    conns = {}
    for r in sorted(rows, key=str):
        if r[5] != "LISTEN" and r[3] not in (None, "0.0.0.0", "::") and (loopback or not (inside(r[1]) and inside(r[3]))):
            conns.setdefault(r[:5], r)
    out = []
    for key in sorted(conns.keys() - before["conns"]):
        proto, local, port, remote, far, state = conns[key]
        inbound = state != "SYN_SENT" and (proto, port) in ports
        ends = (remote, local, far, port) if inbound else (local, remote, port, far)
        out.append((host, at, "network_connection", *ends, proto, "inbound" if inbound else "outbound", None))
    if before["primed"]:
        for proto, local, port in sorted(listeners - before["listeners"]):
            place = f"[{local}]" if ":" in local else local
            out.append((host, at, "port_opened", local, None, None, port, proto, None, f"listening on {proto} {place}:{port}"))
    return out, {"conns": set(conns), "listeners": listeners, "primed": True}


def stream_connections(snapshots: DataFrame, late: str = "10 minutes", include_loopback: bool = False) -> DataFrame:
    """New connections and listeners of each host against its snapshot before, as events.

    A snapshot may come in several pieces: it is held until the watermark has passed its time, and snapshots are
    compared in order of time. The first one of a host opens no ports.
    """
    keys = ["proto", "local_ip", "local_port", "remote_ip", "remote_port", "state"]
    names = ["host", "timestamp", "event_type", "ip", "dst_ip", "src_port", "port", "protocol", "direction", "message"]

    def run(host: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, held = pickle.loads(state.get[0]) if state.exists else ({"conns": set(), "listeners": set(), "primed": False}, {})
        if not state.hasTimedOut:
            for rows in batches:
                for at, part in rows.groupby("us"):
                    held.setdefault(int(at), set()).update(part[keys].itertuples(index=False, name=None))
        passed, out = state.getCurrentWatermarkMs() * 1000, []
        for at in sorted(t for t in held if t <= passed):
            made, before = _snapshot(host[0], pd.Timestamp(at, unit="us", tz="UTC"), list(held.pop(at)), before, include_loopback)
            out += made
        state.update((pickle.dumps((before, held)),))
        if held:
            state.setTimeoutTimestamp(max(min(held) // 1000, state.getCurrentWatermarkMs()) + 1)
        found = pd.DataFrame(out, columns=names)
        yield found.astype({"src_port": "Int32", "port": "Int32"})

    rows = snapshots.withWatermark("snapshot_ts", late).select("host", "snapshot_ts", F.unix_micros("snapshot_ts").alias("us"), *keys)
    schema = "host string, timestamp timestamp, event_type string, ip string, dst_ip string, src_port int, port int, protocol string, direction string, message string"
    return rows.groupBy("host").applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
