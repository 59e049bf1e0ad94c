"""Streams over several micro-batches: against the batch form, with late rows, split snapshots and idle addresses."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_engine import RULES, correlated, found, made, replay, table

from harrier.operators import detect
from harrier.plans.rules import load_rules, register_rule_kind
from harrier.schema import EVENT_DDL, SOCKET_DDL
from harrier.sources import lines, network
from harrier.sources.follow import FollowReader, follow_lines
from harrier.streaming import jobs

T0 = datetime(2025, 3, 1)


def stream(spark, path, parts, ddl):
    """A stream that gets one part a micro-batch."""
    for i, rows in enumerate(parts):
        rows.coalesce(1).write.parquet(f"{path}/in{i}")
        (src,) = (path / f"in{i}").glob("*.parquet")
        (path / "in").mkdir(exist_ok=True)
        src.rename(path / "in" / f"{i:03d}.parquet")
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def run(df, path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_several_batches_equal_the_whole(spark, tmp_path):
    rows = made(8, 160)
    every = table(spark, rows)
    parts = [every.where(F.col("seq").between(k, k + 39)) for k in range(0, 160, 40)]
    got = run(jobs.stream_detect(stream(spark, tmp_path, parts, EVENT_DDL), load_rules(RULES), "1 hour"), tmp_path, "several")
    assert found(got) == found(detect.detect(every, load_rules(RULES)))


def test_several_correlations_on_a_stream(spark, tmp_path):
    rows, rules = made(23, 120), correlated(2)
    every = table(spark, rows)
    parts = [every.where(F.col("seq").between(k, k + 59)) for k in (0, 60)]
    got = run(jobs.stream_detect(stream(spark, tmp_path, parts, EVENT_DDL), load_rules(rules), "1 hour"), tmp_path, "correlated")
    assert found(got) == replay(rows, rules)


def test_late_rows_count_in_their_place(spark, tmp_path):
    at = lambda seq, second: {"seq": seq, "timestamp": T0 + timedelta(seconds=second), "ip": "192.0.2.1", "event_type": "http_request"}
    some = load_rules({"default_cooldown": "0s", "rules": [{"name": "Many", "kind": "threshold", "severity": "low", "threshold": 4, "window": "30s"}]})
    parts = [table(spark, [at(0, 10), at(1, 20), at(2, 100)]), table(spark, [at(3, 12), at(4, 15)]), table(spark, [at(5, 101), at(6, 102), at(7, 103)])]
    got = run(jobs.stream_detect(stream(spark, tmp_path, parts, EVENT_DDL), some, "10 minutes"), tmp_path, "late").collect()
    # the late rows see what lies before them only (two and three rows); the last row is the fourth in its window
    assert [(r["seq"], r["event_count"]) for r in got] == [(7, 4)]


def test_idle_addresses_lose_their_state(spark, tmp_path):
    at = lambda seq, second, ip: {"seq": seq, "timestamp": T0 + timedelta(seconds=second), "ip": ip, "event_type": "http_request", "path": "/zebra"}
    some = load_rules({"default_cooldown": "20s", "rules": [r for r in RULES["rules"] if r["name"] == "Word"]})
    parts = [table(spark, [at(k, 0, f"192.0.2.{k}") for k in range(6)]), table(spark, [at(10, 500, "192.0.2.99")]), table(spark, [at(11, 900, "192.0.2.99")]), table(spark, [at(12, 1300, "192.0.2.99")])]
    df = jobs.stream_detect(stream(spark, tmp_path, parts, EVENT_DDL), some, "10 seconds")
    q = df.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None and spark.table("idle").count() == 9
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 2


def test_registered_kinds_do_not_pass_silently(spark):
    register_rule_kind("noop", lambda r: lambda e: e)
    with pytest.raises(ValueError, match="Own"):
        jobs.stream_detect(table(spark, []), load_rules({"rules": [{"name": "Own", "kind": "noop", "severity": "low"}]}))


def test_split_snapshots(spark, tmp_path):
    def row(at, lip, lport, rip, rport, state):
        return ("h", T0 + timedelta(minutes=at), "tcp", lip, lport, rip, rport, state, 1, "p", "0")

    first = [row(0, "0.0.0.0", 8443, "0.0.0.0", 0, "LISTEN"), row(0, "192.0.2.1", 8443, "198.51.100.9", 1000, "ESTABLISHED"), row(0, "192.0.2.1", 5000, "203.0.113.4", 25, "SYN_SENT")]
    second = [row(1, *r[3:8]) for r in first] + [row(1, "::", 9000, "::", 0, "LISTEN"), row(1, "127.0.0.1", 4, "127.0.0.1", 5, "ESTABLISHED"), row(1, "192.0.2.1", 5001, "203.0.113.4", 25, "ESTABLISHED")]
    last = [row(30, "0.0.0.0", 1, "0.0.0.0", 0, "LISTEN")]
    make = lambda rows: spark.createDataFrame(rows, SOCKET_DDL)
    parts = [make(first[:2]), make(first[2:] + second[:2]), make(second[2:]), make(last), make([row(90, "0.0.0.0", 1, "0.0.0.0", 0, "LISTEN")])]
    names = ["timestamp", "event_type", "ip", "dst_ip", "src_port", "port", "direction", "message"]
    got = run(jobs.stream_connections(stream(spark, tmp_path, parts, SOCKET_DDL), "2 minutes"), tmp_path, "split").where(F.col("timestamp") < T0 + timedelta(minutes=20))
    expect = network.connection_events(make(first + second))
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, expect.select(*names).collect()))
    assert got.where("event_type = 'port_opened'").collect()[0]["message"] == "listening on tcp [::]:9000"


def test_stateless_jobs(spark, tmp_path):
    rows = made(9, 60)
    every = table(spark, rows)
    src = stream(spark, tmp_path, [every.where("seq < 30"), every.where("seq >= 30")], EVENT_DDL)
    some = load_rules(RULES)
    sig = run(jobs.stream_signatures(src, some), tmp_path, "sig")
    batch = detect.signatures(every, [r for r in some.active if r.kind == "signature"])
    key = lambda df: sorted((r["seq"], r["rule"], r["pattern"]) for r in df.collect())
    assert key(sig) == key(batch)
    q = jobs.stream_ingest(src, str(tmp_path / "out"), str(tmp_path / "cp-out"))
    q.awaitTermination(300)
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == 60 and kept.select("id").distinct().count() == 60
    counts = run(jobs.stream_counts(src, "1 minute", "0 seconds"), tmp_path, "counts")
    expect = every.groupBy(F.window("timestamp", "1 minute")["start"].alias("start"), "event_type").agg(F.count("*").alias("count"))
    assert {*map(tuple, counts.collect())} <= {*map(tuple, expect.select(*counts.columns).collect())} and counts.count() > 0


def test_followed_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\n\n" + "x" * 70_000 + "\ntwo\n")
    whole = run(lines.stream_lines(spark, str(tmp_path / "logs")), tmp_path, "whole")
    assert sorted(r["value"] for r in whole.collect()) == ["one", "two"]
    import os
    import time

    os.utime(tmp_path / "logs" / "a.log", (time.time() - 3600, time.time() - 3600))
    new = lines.stream_lines(spark, str(tmp_path / "logs"), from_start=False)
    (tmp_path / "logs" / "b.log").write_text("three\n")
    os.utime(tmp_path / "logs" / "b.log", (time.time() + 60, time.time() + 60))
    assert [r["value"] for r in run(new, tmp_path, "newer").collect()] == ["three"]


def test_every_row_ends_somewhere(spark, tmp_path):
    """In time, late, very late and bad rows; a batch whose commit was lost is written again, not twice."""
    minute = lambda *at: [None if m is None else T0 + timedelta(minutes=m) for m in at]
    whole, seq, want = [], 0, {}

    def part(times, ends, ips=None):
        nonlocal seq
        rows = []
        for t, end, ip in zip(times, ends, ips or ["10.0.0.1"] * len(times), strict=True):
            rows.append((seq, ip, t))
            want[seq] = end
            seq += 1
        whole.append(spark.createDataFrame(rows, "seq long, ip string, timestamp timestamp"))

    part(minute(5, 0, 10), ["accepted"] * 3)
    part(minute(20, None, 1), ["accepted"] * 3)  # the mark is that of the batches before: 10 - 10; a row without a time gets now
    part(minute(9, 10, -9000, 19, 21, 3), ["late", "accepted", "late", "accepted", "accepted", "rejected"], ["10.0.0.1"] * 5 + ["nobody"])
    part(minute(12, 10, None), ["accepted", "late", "rejected"], ["10.0.0.2", "10.0.0.2", ""])
    empty = spark.createDataFrame([], EVENT_DDL)
    src = stream(spark, tmp_path, [empty.unionByName(p, allowMissingColumns=True) for p in whole], EVENT_DDL)
    out, cp = str(tmp_path / "all"), tmp_path / "cp-all"

    def go():
        q = jobs.stream_outcomes(src, out, str(cp))
        q.awaitTermination(300)
        assert q.exception() is None
        got = spark.read.parquet(out)
        assert sorted((r["seq"], r["outcome"]) for r in got.collect()) == sorted(want.items())
        assert {tuple(r["errors"]) for r in got.where("outcome = 'rejected'").collect()} == {("ip is not a valid address",), ("ip is required",)}
        counts = spark.read.parquet(f"{out}_counts").orderBy("batch").collect()
        assert [(r["accepted"], r["rejected"], r["late"]) for r in counts] == [(3, 0, 0), (3, 0, 0), (3, 1, 2), (1, 1, 1)]
        return {r["id"] for r in got.collect()}

    first = go()
    last = max((cp / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert len(first) == seq and go() == first


def test_growing_files(spark, tmp_path):
    """Appended, unfinished, rotated, truncated and replaced files over restarts: each whole line once."""
    log, name = tmp_path / "logs" / "access.log", "growing"
    log.parent.mkdir()

    def add(text):
        with open(log, "ab") as f:
            f.write(text.encode())

    def got(source):
        q = source.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return sorted(r["value"] for r in spark.read.parquet(str(tmp_path / name)).collect())

    follow = lambda **k: follow_lines(spark, str(log), slice_bytes=50, **k)
    assert got(follow()) == []  # there is no file yet
    want = [f"line {i} " + "é" * (i % 40) for i in range(120)]
    add("\n".join(want) + "\n\n" + "x" * 70_000 + "\r\nhalf a l")
    assert got(follow()) == sorted(want)
    add("ine\r\nnext\n")
    want += ["half a line", "next"]
    assert got(follow()) == sorted(want) == got(follow())
    add("before the turn\n")
    log.rename(tmp_path / "logs" / "access.log.1")
    add("after the turn\n")
    want += ["before the turn", "after the turn"]
    assert got(follow()) == sorted(want)
    with open(tmp_path / "logs" / "access.log.1", "a") as f:
        f.write("late in the old file\n")
    want.append("late in the old file")
    assert got(follow()) == sorted(want)
    log.write_text("cut\n")  # the same file, shorter
    want.append("cut")
    assert got(follow()) == sorted(want)
    log.write_text("another beginning, and longer than what was there\n")
    want.append("another beginning, and longer than what was there")
    assert got(follow()) == sorted(want)
    name = "from the end"
    assert got(follow(from_start=False)) == []
    add("new\n")
    assert got(follow(from_start=False)) == ["new"]


def test_a_batch_of_a_growing_file_replays_under_its_new_name(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\n")
    reader = FollowReader({"path": str(tmp_path / "*.log"), "slice_bytes": "4"})
    end = reader.latestOffset()
    log.rename(tmp_path / "a.log.1")
    log.write_text("three\n")
    rows = [(v, p) for part in reader.partitions({}, end) for b in reader.read(part) for v, p in zip(b["value"].to_pylist(), b["place"].to_pylist(), strict=True)]
    assert rows == [("one", 0), ("two", 4)]
    later = reader.latestOffset()
    assert [(s.path, s.start) for s in reader.partitions(end, later)] == [(str(log), 0), (str(log), 4)]
    (tmp_path / "a.log.1").unlink()
    with pytest.raises(FileNotFoundError):
        reader.partitions({}, end)
    assert FollowReader({"path": str(tmp_path / "*.log"), "fail_on_loss": "false"}).partitions({}, end) == []
