"""Lists, summaries and monitoring over events and alerts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.schema import severity_rank

DEFAULT_LIMIT, MOST, BLOCKS = 100, 1000, 4096


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be from 1 to {MOST}")
    return limit


def matching(rows: DataFrame, ip: str | None = None, event_type: str | None = None, min_severity: str | None = None, rule: str | None = None) -> DataFrame:
    """Rows that meet the filters; severity and rule apply to alerts, where the rule may be the trigger or related."""
    if ip is not None:
        rows = rows.where(F.col("ip") == ip)
    if event_type is not None:
        rows = rows.where(F.col("event_type") == event_type)
    if min_severity is not None:
        rows = rows.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(min_severity)))
    if rule is not None:
        rows = rows.where((F.col("trigger_rule") == rule) | F.array_contains(F.coalesce("related_rules", F.array().cast("array<string>")), rule))
    return rows


def newest(rows: DataFrame, limit: int = DEFAULT_LIMIT, **filters: str) -> DataFrame:
    """The newest rows: by arrival; for one address by time."""
    order = [F.desc("timestamp"), F.desc("seq")] if filters.get("ip") else [F.desc("seq")]
    return matching(rows, **filters).orderBy(*order).limit(check_limit(limit))


def total(rows: DataFrame, **filters: str) -> DataFrame:
    return matching(rows, **filters).agg(F.count("*").alias("total"))


def find_since(rows: DataFrame, ip: str, since: Column) -> DataFrame:
    """An address's rows after a time, oldest first."""
    return rows.where((F.col("ip") == ip) & (F.col("timestamp") > since)).orderBy("timestamp", "seq")


def newest_per_ip(rows: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Each address's newest rows, with their rank."""
    order = Window.partitionBy("ip").orderBy(F.desc("timestamp"), F.desc("seq"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= check_limit(limit))


def summarize_alerts(alerts: DataFrame, since: Column) -> DataFrame:
    """One row for alerts after a time: total, distinct addresses and a count for each severity."""
    by = [F.count_if(F.col("severity") == s).alias(s) for s in ("low", "medium", "high", "critical")]
    return alerts.where(F.col("timestamp") > since).agg(F.count("*").alias("total"), F.countDistinct("ip").alias("ips"), *by)


def top_counts(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The commonest values of a column, ties in order of value."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key").limit(n)


def stats(events: DataFrame, alerts: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return events.agg(F.count("*").alias("events"), distinct("ip").alias("ips")).join(alerts.agg(F.count("*").alias("alerts")))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("count"))


def has_new_alerts(alerts: DataFrame, last_id: str, **filters: str) -> DataFrame:
    """One row: whether the newest matching alert is another than the one known."""
    top = newest(alerts, 1, **filters).agg(F.max("id").alias("id"))
    return top.select((F.col("id").isNotNull() & (F.col("id") != last_id)).alias("new"))


def rate(rows: DataFrame, window: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows."""
    got = rows.groupBy(F.window("timestamp", window).alias("w"), *keys).agg(F.count("*").alias("count"))
    return got.select(F.col("w.start").alias("start"), *keys, "count")


def rate_alarm(alerts: DataFrame, least: int = 1, window: str = "5 minutes", min_severity: str = "high") -> DataFrame:
    """The windows in which `least` alerts of that severity or more were raised, by severity."""
    return rate(matching(alerts, min_severity=min_severity), window, "severity").where(F.col("count") >= least)


def eviction_alarm(evicted: DataFrame, window: str = "1 hour") -> DataFrame:
    """The windows in which rows had to go for want of room; evicted: rows (timestamp, kind, reason, count)."""
    rows = evicted.where((F.col("reason") == "capacity") & (F.col("count") > 0))
    return rows.groupBy(F.window("timestamp", window)["start"].alias("start"), "kind").agg(F.sum("count").alias("count"))


def ip_report(events: DataFrame, alerts: DataFrame, ip: str, n_alerts: int = 100, n_events: int = 200) -> dict[str, DataFrame]:
    """An address's newest alerts and events."""
    return {"alerts": newest(alerts, n_alerts, ip=ip), "events": newest(events, n_events, ip=ip)}


def gaps(events: DataFrame, longest: str, bucket: str = "1 day") -> DataFrame:
    """Silences: from one event to the next one `longest` or more later.

    Within buckets of time the next event is found in parallel; a bucket's last event meets the first of the next bucket that has any.
    """
    rows = events.select("timestamp", F.window("timestamp", bucket)["start"].alias("b"))
    inside = rows.select("timestamp", F.lead("timestamp").over(Window.partitionBy("b").orderBy("timestamp")).alias("until")).where("until IS NOT NULL")
    # a row for each bucket of time, few whatever the events
    edges = rows.groupBy("b").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    across = edges.select(F.col("last").alias("timestamp"), F.lead("first").over(Window.orderBy("b")).alias("until")).where("until IS NOT NULL")
    return inside.unionByName(across).where(F.col("until") >= F.col("timestamp") + F.expr(f"INTERVAL {longest}"))


def overview(events: DataFrame, alerts: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What the start page shows: the last day's summary and top lists, the newest alerts, the store's counts."""
    since = now - F.expr("INTERVAL 24 HOURS")
    recent = alerts.where(F.col("timestamp") > since)
    return {"summary": summarize_alerts(alerts, since), "top_ips": top_counts(recent, "ip"), "top_rules": top_counts(recent, "trigger_rule"), "latest": newest(alerts, 10), "stats": stats(events, alerts)}


def alerts_with_events(alerts: DataFrame, events: DataFrame, window: str | None = None) -> DataFrame:
    """Each alert beside the event that caused it, or beside the address's events in the window before it."""
    e = events.select(F.col("ip").alias("e_ip"), F.col("seq").alias("event_seq"), F.col("timestamp").alias("event_time"), F.col("event_type").alias("cause"))
    same = alerts["ip"] == F.col("e_ip")
    if window is None:
        return alerts.join(e, same & (alerts["seq"] == F.col("event_seq"))).drop("e_ip")
    # time is cut into cells of the window's length: an alert meets the events of its own cell and of the one before
    span = F.expr(f"INTERVAL {window}")
    us = F.unix_micros(F.timestamp_micros(F.lit(0)) + span)
    cell = lambda c: F.floor(F.unix_micros(c) / us)
    e = e.withColumn("e_cell", cell(F.col("event_time")))
    a = alerts.withColumn("__cell", F.explode(F.array(cell(F.col("timestamp")), cell(F.col("timestamp")) - 1)))
    met = (a["ip"] == F.col("e_ip")) & (F.col("__cell") == F.col("e_cell"))
    return a.join(e, met & (F.col("event_time") > a["timestamp"] - span) & (F.col("event_time") <= a["timestamp"])).drop("e_ip", "e_cell", "__cell")


def evidence_counts(alerts: DataFrame, events: DataFrame, window: str, span: int = 4) -> DataFrame:
    """Each alert with `evidence`: how many events its address had in the window up to it, (t - window, t]; 0 where there are none.

    No pairs are made: an event enters at its time and leaves a window later, an alert reads the running sum, in linear time.
    An address's time is cut into chunks of `span` windows, each with the events of the window before it, so that a busy
    address is many tasks. Rows without a time have no place: such events are not counted, such alerts get null. Addresses
    that are null are one address.
    """
    w = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {window}"))
    us, length = F.unix_micros("timestamp"), w * span
    chunk = (us - F.pmod(us, length)) / length
    names = alerts.columns
    a = alerts.select(F.struct(*names).alias("a"), "ip", us.alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("delta"), chunk.cast("long").alias("chunk"))
    e = events.where("timestamp IS NOT NULL").select("ip", us.alias("us"), chunk.cast("long").alias("chunk"), w.alias("w"))
    late = F.col("us") + F.col("w") > (F.col("chunk") + 1) * F.col("w") * span
    e = e.withColumn("chunk", F.explode(F.when(late, F.array("chunk", F.col("chunk") + 1)).otherwise(F.array("chunk"))))
    # events of one time of an address are one row
    e = e.groupBy("ip", "chunk", "us", "w").agg(F.count("*").alias("n"))
    step = lambda at, kind, delta: F.struct(at.alias("at"), F.lit(kind).alias("kind"), delta.cast("long").alias("delta"))
    e = e.select("ip", "chunk", F.explode(F.array(step(F.col("us"), 1, F.col("n")), step(F.col("us") + F.col("w"), 0, -F.col("n")))).alias("s")).select("ip", "chunk", "s.*")
    both = a.withColumn("delta", F.col("delta").cast("long")).unionByName(e, allowMissingColumns=True)
    so_far = Window.partitionBy("ip", "chunk").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("evidence", F.sum("delta").over(so_far)).where("kind = 2")
    return counted.select("a.*", F.when(F.col("at").isNotNull(), F.col("evidence")).alias("evidence"))


def by_age(rows: DataFrame, now: Column, age: str | None) -> DataFrame:
    """Rows not older than `age`; one exactly that old stays."""
    return rows if age is None else rows.where(F.col("timestamp") >= now - F.expr(f"INTERVAL {age}"))


def by_capacity(rows: DataFrame, n: int) -> DataFrame:
    """The newest n rows by arrival; 0 keeps all.

    Counts by ranges of seq, BLOCKS of them whatever the rows, tell which range the limit falls into; only its rows are put in order.
    """
    if n <= 0:
        return rows
    ends = rows.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    if ends["lo"] is None:
        return rows
    width = (ends["hi"] - ends["lo"]) // BLOCKS + 1
    block = F.floor((F.col("seq") - ends["lo"]) / width)
    counts_ = {r["b"]: r["c"] for r in rows.groupBy(block.alias("b")).agg(F.count("*").alias("c")).collect()}  # BLOCKS rows at most
    room, edge = n, -1
    for b in sorted(counts_, reverse=True):
        if counts_[b] > room:
            edge = b
            break
        room -= counts_[b]
    last = rows.where(block == edge).orderBy(F.desc("seq")).limit(room)
    return rows.where(block > edge).unionByName(last)


def evictions(rows: DataFrame, now: Column, age: str | None, capacity: int, kind: str) -> DataFrame:
    """How many rows retention drops, by reason."""
    kept = by_age(rows, now, age)
    full = by_capacity(kept, capacity)
    one = lambda a, b, why: a.agg(F.count("*").alias("x")).join(b.agg(F.count("*").alias("y"))).select(F.lit(kind).alias("kind"), F.lit(why).alias("reason"), (F.col("x") - F.col("y")).alias("count"))
    return one(rows, kept, "age").unionByName(one(kept, full, "capacity"))


def _by_day(events: DataFrame, parts_of_day: int):
    day = events.withColumn("event_date", F.to_date("timestamp"))
    salt = F.pmod(F.xxhash64("ip", "seq"), F.lit(parts_of_day))
    return day.repartition("event_date", salt).sortWithinPartitions("event_date", "ip", "timestamp").write.partitionBy("event_date")


def write_events(events: DataFrame, path: str, parts_of_day: int = 8) -> None:
    """Events by day, each in `parts_of_day` parts dealt by hashes of (ip, seq) and in order of address and time within files: days prune, and no day is one task."""
    _by_day(events, parts_of_day).mode("append").parquet(path)


write_alerts = write_events


def capacity_cut(rows: DataFrame, n: int) -> int | None:
    """The seq up to which rows must go so that the newest n by arrival stay; null if there is room for all, or n is 0.

    Rows of one seq go together, so fewer than n may stay. Nothing is sorted: counts of BLOCKS ranges of seq say which one the
    cut lies in, and that one is cut again, down to a single seq.
    """
    ends = rows.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("seq").alias("n")).first()
    if n <= 0 or ends["n"] <= n:
        return None
    lo, hi, room = ends["lo"], ends["hi"], n
    while lo < hi:
        width = (hi - lo) // BLOCKS + 1
        block = F.floor((F.col("seq") - F.lit(lo)) / F.lit(width))
        found = rows.where(F.col("seq").between(lo, hi)).groupBy(block.alias("b")).agg(F.count("*").alias("c")).collect()  # BLOCKS rows at most
        for r in sorted(found, reverse=True):
            if r["c"] > room:
                lo, hi = lo + r["b"] * width, min(hi, lo + (r["b"] + 1) * width - 1)
                break
            room -= r["c"]
    return lo


def prune_stored(spark: SparkSession, path: str, kind: str, now: Column, age: str | None = None, capacity: int = 0, parts_of_day: int = 8) -> DataFrame:
    """Retention on a table of write_events: rows older than `age` go, then all but the newest `capacity` by arrival; gives rows
    (kind, reason, count) of what went, as evictions does.

    Days that go as a whole are deleted, days that the cut goes through are written anew, and no file of another day is touched.
    A day is written beside the table and put in its old one's place when all of it is there; a job that dies before leaves the
    old rows, and one that dies between days is finished by calling again. Readers that began before may miss files
    and must start again. Rows without a time (a folder of their own) have no age, and go for want of room only; a null seq never goes.

    A table that a stream's file sink keeps a log of is refused, since its readers go by that log.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(root, "_spark_metadata")):
        raise ValueError(f"{path} is kept by a stream's file sink")
    went = {}
    for reason in ("age", "capacity"):
        rows, went[reason] = spark.read.parquet(path), 0
        if reason == "age":
            if age is None:
                continue
            first = spark.range(1).select((now - F.expr(f"INTERVAL {age}")).alias("t")).first()["t"]
            gone = F.coalesce(F.col("timestamp") < F.lit(first), F.lit(False))
            near = rows.where(F.col("event_date") <= F.to_date(F.lit(first)))  # later days are not read
        else:
            cut = capacity_cut(rows, capacity)
            if cut is None:
                continue
            gone, near = F.coalesce(F.col("seq") <= F.lit(cut), F.lit(False)), rows
        days = near.groupBy("event_date").agg(F.count_if(gone).alias("gone"), F.count_if(~gone).alias("stay")).where("gone > 0").collect()  # a row a day
        if part := [d["event_date"] for d in days if d["stay"]]:
            same = reduce(or_, [F.col("event_date").eqNullSafe(F.lit(d)) for d in part])
            _by_day(near.where(same & ~gone), parts_of_day).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        for d in days:
            if not d["stay"]:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"event_date={d['event_date'] or '__HIVE_DEFAULT_PARTITION__'}"), True)
        went[reason] = sum(d["gone"] for d in days)
    return spark.createDataFrame([(kind, k, v) for k, v in went.items()], "kind string, reason string, count long")
