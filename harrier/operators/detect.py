"""Detection: events to firings to alerts.

Firings have the columns seq, ip, timestamp, rule, count, pattern, field, group, interval_us, jitter.
Every operator partitions by address. Windows are (t - w, t]: what is w old has expired. Events of one
time count in the order of seq. The batch form replays events in order of (timestamp, seq).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrier.functions.fields import duration_column, duration_text, field, micros, render
from harrier.plans.rules import KINDS, Rule, RuleSet, compile_filter, with_signatures
from harrier.schema import SEVERITIES

_VARS = ["pattern", "field", "group", "interval_us", "jitter"]


def _after(ts: Column, us: int | Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + us)


def _firing(rule: Rule, count: Column, **values: Column) -> list[Column]:
    kinds = {"interval_us": "double", "jitter": "double"}
    return ["seq", "ip", "timestamp", F.lit(rule.name).alias("rule"), count.cast("int").alias("count"), *[values.get(v, F.lit(None)).cast(kinds.get(v, "string")).alias(v) for v in _VARS]]


def signatures(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """A firing for each event and signature whose conditions it meets and of which a pattern matches. No shuffle, one pass."""
    null = lambda kind: F.lit(None).cast(kind)
    return with_signatures(events, rules).select("seq", "ip", "timestamp", "sig.rule", F.lit(1).alias("count"), "sig.pattern", "sig.field", null("string").alias("group"), null("double").alias("interval_us"), null("double").alias("jitter"))


def signature(events: DataFrame, rule: Rule) -> DataFrame:
    return signatures(events, [rule])


#: An address's time is cut into chunks of so many windows.
CHUNK = 4
#: So many events make a part of what is counted and judged, so that a task's rows do not grow with the table.
EVENTS_A_PART = 20_000
#: Up to so many parts are written by Spark's bypass writer (spark.shuffle.sort.bypassMergeThreshold), which keeps no rows in memory.
DEALT = 200


def parts(events: DataFrame) -> int:
    """Parts for all that comes of these events: one a core, and no more of them a part in larger tables. Counting reads no column."""
    return max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // EVENTS_A_PART))


def thresholds(events: DataFrame, rules: list[Rule], n: int | None = None, since: Column | None = None) -> DataFrame:
    """A firing at each matching event by which an address has `threshold` events, or distinct values, in a rule's window.

    Every event enters as +1 at its time and leaves as -1 a window later, expiries first; a running sum
    over both is the window's count, in linear time. For distinct values the pair stands for a run of
    equal values that are less than a window apart. All rules are counted in one pass. An address's time is cut into
    chunks that are counted apart, each with the events of the window before it, so that a busy address is no
    single task: only what it sends within CHUNK windows meets. n: in how many parts (see parts); a hash of the keys deals
    the rows out and leads the order, which settles most comparisons of a sort. since: counts from then on are asked
    for, so an event a rule's window before it takes no part.
    """
    n = n or parts(events)
    ts = F.unix_micros("timestamp")

    def hit(i: int, r: Rule) -> Column:
        value = field(r.distinct) if r.distinct else F.lit("")
        group = field(r.group_by) if r.group_by else F.lit("")
        made = F.struct(F.lit(i).alias("rule"), F.lit(micros(r.window)).cast("long").alias("w"), group.alias("group"), value.alias("value"))
        late = F.lit(True) if since is None else F.col("timestamp") > _after(since, -micros(r.window))
        return F.when(late & compile_filter(r.when) & group.isNotNull() & value.isNotNull(), made)

    of = lambda value: F.element_at(F.array(*[F.lit(value(r)) for r in rules]), F.col("rule") + 1)
    keys = ["key", "ip", "rule", "group", "chunk"]
    end = F.col("us") + F.col("w")

    def dealt(distinct: bool) -> DataFrame:
        """The events that such rules count, in each chunk that they count in, dealt by chunk."""
        hits = [hit(i, r) for i, r in enumerate(rules) if bool(r.distinct) == distinct]
        rows = events.where("timestamp IS NOT NULL").select("seq", "ip", ts.alias("us"), F.explode(F.array_compact(F.array(*hits))).alias("h")).select("seq", "ip", "us", "h.*")
        own = F.floor(F.col("us") / (F.col("w") * CHUNK))
        late = end > (own + 1) * F.col("w") * CHUNK
        rows = rows.withColumn("chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
        rows = rows.withColumn("own", F.floor(F.col("us") / (F.col("w") * CHUNK)) == F.col("chunk"))
        return rows.withColumn("key", F.xxhash64(*keys[1:])).repartition(n, "key")

    step = lambda at, kind, delta: F.struct(at.alias("at"), F.lit(kind).alias("kind"), delta.alias("delta"))

    def counted(part: DataFrame, enters: Column, leaves: Column) -> DataFrame:
        both = part.select("seq", "us", "own", *keys, F.explode(F.array(step(F.col("us"), 1, enters), step(end, 0, leaves))).alias("s"))
        both = both.where("s.kind = 1 OR s.delta <> 0")
        order = Window.partitionBy(*keys).orderBy("s.at", "s.kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("count", F.sum("s.delta").over(order))
        return both.where((F.col("s.kind") == 1) & F.col("own") & (F.col("count") >= of(lambda r: r.threshold)))

    found = []
    if any(not r.distinct for r in rules):
        found.append(counted(dealt(False), F.lit(1), F.lit(-1)))
    if any(r.distinct for r in rules):
        part = dealt(True)
        same = Window.partitionBy(*keys, "value").orderBy("us", "seq")
        part = part.withColumns({"__before": F.lag("us").over(same), "__next": F.lead("us").over(same)})
        enters = F.when(F.col("__before").isNull() | (F.col("__before") + F.col("w") <= F.col("us")), 1).otherwise(0)
        leaves = F.when(F.col("__next").isNull() | (F.col("__next") >= end), -1).otherwise(0)
        found.append(counted(part, enters, leaves))
    fired = reduce(DataFrame.unionByName, found)
    null = lambda kind: F.lit(None).cast(kind)
    return fired.select("seq", "ip", F.timestamp_micros("us").alias("timestamp"), of(lambda r: r.name).alias("rule"), F.col("count").cast("int").alias("count"), null("string").alias("pattern"), null("string").alias("field"), F.when(F.col("group") != "", F.col("group")).alias("group"), null("double").alias("interval_us"), null("double").alias("jitter"))


def threshold(events: DataFrame, rule: Rule) -> DataFrame:
    return thresholds(events, [rule])


def _mark_spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (two hashes of the key, time), with whether each is a gap after the last kept one of its key; only that one is remembered."""
    key, last = None, 0
    for batch in batches:
        one, two, us, gap = (batch.column(batch.num_columns - i).to_numpy() for i in (4, 3, 2, 1))
        new = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(us) else np.empty(0, int)
        keep = np.zeros(len(us), bool)
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(us)], strict=True):
            if not gap[a]:
                keep[a:b] = True
                continue
            at = a
            if key == (one[a], two[a]):
                at = a + int(np.searchsorted(us[a:b], last + gap[a]))
            while at < b:
                keep[at], last = True, us[at]
                at += int(np.searchsorted(us[at:b], last + gap[a]))
            key = (one[a], two[a])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(keep)], [*batch.schema.names[:-4], "kept"])


def marked_spaced(rows: DataFrame, keys: list[str], gap: int | Column, n: int | None = None) -> DataFrame:
    """The rows with `kept`: whether each stays when it must be `gap` or more after the last kept one of its keys.

    A gap of 0 keeps all rows; a gap that is a column must be one of `keys`. The rows of a key pass through one
    task in order of time, which remembers the last kept one only and jumps from it to the next. n: in how many parts.
    """
    sorted_ = rows.where("timestamp IS NOT NULL").select("*", F.xxhash64(*keys).alias("__k1"), F.xxhash64(F.lit(1), *keys).alias("__k2"), F.unix_micros("timestamp").alias("__us"), (F.lit(gap) if isinstance(gap, int) else gap).cast("long").alias("__gap"))
    sorted_ = sorted_.repartition(*[n] * bool(n), "__k1", "__k2").sortWithinPartitions("__k1", "__k2", "__us", "seq")
    return sorted_.mapInArrow(_mark_spaced, T.StructType([*rows.schema.fields, T.StructField("kept", T.BooleanType())]))


def spaced(rows: DataFrame, keys: list[str], gap: int | Column, n: int | None = None) -> DataFrame:
    """The rows kept when each must be `gap` or more after the last kept one of its keys (see marked_spaced)."""
    return marked_spaced(rows, keys, gap, n).where("kept").drop("kept")


def beacon(events: DataFrame, rule: Rule, parts_: int | None = None) -> DataFrame:
    """A firing at each contact by which the last `threshold` contacts of an address with a target are evenly spaced.

    Contacts less than half of min_interval after the last one that counts belong to it.
    """
    n, w, least = rule.threshold, micros(rule.window), micros(rule.min_interval)
    rows = events.where(compile_filter(rule.when)).select("seq", "ip", "timestamp", field(rule.group_by).alias("group")).where("`group` IS NOT NULL")
    rows = spaced(rows, ["ip", "group"], least // 2, parts_)
    rows = rows.repartition(*[parts_] * bool(parts_), "ip", "group")
    order = Window.partitionBy("ip", "group").orderBy("timestamp", "seq")
    gap = F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(order))
    last = order.rowsBetween(-(n - 2), 0)
    rows = rows.withColumn("gap", gap).withColumn("first", F.lag("timestamp", n - 1).over(order))
    rows = rows.withColumns({"mean": F.avg("gap").over(last), "dev": F.stddev_pop("gap").over(last)})
    jitter = F.col("dev") / F.col("mean")
    fired = rows.where(F.col("first").isNotNull() & (_after(F.col("first"), w) > F.col("timestamp")) & (F.col("mean") >= least) & (jitter <= rule.max_jitter))
    return fired.select(*_firing(rule, F.lit(n), group=F.col("group"), interval_us=F.col("mean"), jitter=jitter))


def spread(events: DataFrame, n: int) -> DataFrame:
    """Events in n parts or DEALT, where their source gives fewer; others stay as read.

    What a source gives may be as large as a file's split or row group, most of them empty. So nothing is made of events in
    the tasks that read them, and these hold no rows: rules multiply rows in the parts dealt out.
    """
    n = min(n, DEALT)
    return events if events.isStreaming or events.rdd.getNumPartitions() >= n else events.repartition(n, "seq")


def firings(events: DataFrame, rules: RuleSet, n: int | None = None, since: Column | None = None) -> DataFrame:
    """Firings of all rules but the correlations: a pass for all signatures, one for all thresholds, one for each other rule.

    since: only firings from then on are asked for; events before count for a threshold within its own window.
    """
    n = n or parts(events)
    found, events = [], spread(events, n)
    if some := [r for r in rules.active if r.kind == "signature"]:
        found.append(signatures(events, some))
    if some := [r for r in rules.active if r.kind == "threshold"]:
        found.append(thresholds(events, some, n, since))
    for r in rules.active:
        if r.kind == "beacon":
            found.append(beacon(events, r, n))
        elif r.kind not in ("signature", "threshold", "correlation"):
            found.append(KINDS[r.kind](r)(events))
    return reduce(DataFrame.unionByName, found)


def cooldown(fired: DataFrame, rules: RuleSet, history: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Firings with `kept`: false where an alert of the address less than a cooldown before names the rule.

    history: rows (ip, timestamp, rule) of stored alerts, which count as kept.
    """
    gaps = F.create_map(*[x for r in rules.active for x in (F.lit(r.name), F.lit(rules.cooldown(r)))])
    rows = fired
    if history is not None:
        recent = history.where(F.col("rule").isin([r.name for r in rules.active])).groupBy("ip", "rule").agg(F.max("timestamp").alias("timestamp"))
        rows = rows.unionByName(recent.select(F.lit(-1).cast("long").alias("seq"), "ip", "timestamp", "rule"), allowMissingColumns=True)
    kept = marked_spaced(rows.withColumn("gap", gaps[F.col("rule")]), ["ip", "rule", "gap"], F.col("gap"), n).drop("gap")
    return kept if history is None else kept.where("seq >= 0")


def correlate(judged: DataFrame, rule: Rule, names: list[str], history: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Firings of a correlation: `threshold` rules that fired now, cooled down or not, or were kept in the window before."""
    w = micros(rule.window)
    # dealt by address, which serves the groups and the window
    per = judged.repartition(*[n] * bool(n), "ip").groupBy("ip", "timestamp", "seq").agg(F.collect_set("rule").alias("fired"), F.collect_set(F.when(F.col("kept"), F.col("rule"))).alias("kept"))
    if history is not None:
        old = history.where(F.col("rule").isin(names)).groupBy("ip", "timestamp").agg(F.collect_set("rule").alias("kept"))
        per = per.unionByName(old.select("ip", "timestamp", F.lit(-1).cast("long").alias("seq"), F.array().cast("array<string>").alias("fired"), "kept"))
        per = per.repartition(*[n] * bool(n), "ip")
    before = Window.partitionBy("ip").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = {f"__{i}": F.last(F.when(F.array_contains("kept", name), F.col("timestamp")), ignorenulls=True).over(before) for i, name in enumerate(names)}
    per = per.withColumns(seen)
    live = [F.when(F.array_contains("fired", name) | (_after(F.col(f"__{i}"), w) > F.col("timestamp")), F.lit(name)) for i, name in enumerate(names)]
    per = per.withColumn("names", F.array_sort(F.array_compact(F.array(*live)))).where(F.size("fired") > 0)
    per = per.where(F.size("names") >= rule.threshold)
    return per.select(*_firing(rule, F.size("names"), pattern=F.array_join("names", ", ")))


def _fold(links: list[tuple[str, int, int, int]]):
    """Correlations of an address in order of time; links: (name, threshold, window, cooldown)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, {}
        for batch in batches:
            out = []
            one, two, us, fired, kept = (batch.column(batch.num_columns - i).to_pylist() for i in (5, 4, 3, 2, 1))
            for i, at in enumerate(us):
                if (one[i], two[i]) != key:
                    key, last = (one[i], two[i]), {}
                stay = list(kept[i])
                for name, threshold, window, cooldown in links if fired[i] else ():
                    seen = {*fired[i], *(n for n, t in last.items() if t > at - window)} - {name}
                    if len(seen) >= threshold:
                        free = not cooldown or name not in last or last[name] <= at - cooldown
                        out.append((i, name, len(seen), ", ".join(sorted(seen)), free))
                        if free:
                            stay.append(name)
                last.update(dict.fromkeys(stay, at))
            rows, names, counts, texts, free = zip(*out, strict=True) if out else ((),) * 5
            taken = batch.select([0, 1, 2]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(names, pa.string()), pa.array(counts, pa.int32()), pa.array(texts, pa.string()), pa.array(free, pa.bool_())], [*taken.schema.names, "rule", "count", "pattern", "kept"])

    return run


def correlate_several(judged: DataFrame, links: list[Rule], rules: RuleSet, history: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Firings of several correlations with `kept`, each seeing what all others have kept before, as well as the rules.

    What a correlation keeps is in the other's window from the next event on, so the order of events decides: an address's
    firings pass through one task in order of time, which remembers when each name was last kept and nothing else.
    """
    per = judged.repartition(*[n] * bool(n), "ip").groupBy("ip", "timestamp", "seq").agg(F.collect_set("rule").alias("fired"), F.collect_set(F.when(F.col("kept"), F.col("rule"))).alias("kept"))
    if history is not None:
        old = history.where(F.col("rule").isin([r.name for r in rules.active])).groupBy("ip", "timestamp").agg(F.collect_set("rule").alias("kept"))
        per = per.unionByName(old.select("ip", "timestamp", F.lit(-1).cast("long").alias("seq"), F.array().cast("array<string>").alias("fired"), "kept"))
    rows = per.select("seq", "ip", "timestamp", F.xxhash64("ip").alias("__k1"), F.xxhash64(F.lit(1), "ip").alias("__k2"), F.unix_micros("timestamp").alias("__us"), "fired", "kept")
    rows = rows.repartition(*[n] * bool(n), "__k1", "__k2").sortWithinPartitions("__k1", "__k2", "__us", "seq")
    plan = [(r.name, r.threshold, micros(r.window), rules.cooldown(r)) for r in links]
    found = rows.mapInArrow(_fold(plan), "seq long, ip string, timestamp timestamp, rule string, count int, pattern string, kept boolean")
    kinds = {"interval_us": "double", "jitter": "double"}
    return found.select("seq", "ip", "timestamp", "rule", "count", *[F.col(v) if v == "pattern" else F.lit(None).cast(kinds.get(v, "string")).alias(v) for v in _VARS], "kept")


def prioritize(kept: DataFrame, rules: RuleSet, n: int | None = None) -> DataFrame:
    """One row for each event: the firing of the highest severity, ties to the rule named first; the others' names in order."""
    order = rules.order()
    ords = F.create_map(*[x for i, r in enumerate(order) for x in (F.lit(r.name), F.lit(i))])
    ranks = F.create_map(*[x for r in order for x in (F.lit(r.name), F.lit(-1 - SEVERITIES.index(r.severity)))])
    item = F.struct(ranks[F.col("rule")].alias("rank"), ords[F.col("rule")].alias("ord"), "rule", "count", *_VARS)
    per = kept.repartition(*[n] * bool(n), "ip", "timestamp", "seq").groupBy("ip", "timestamp", "seq").agg(F.array_sort(F.collect_list(item)).alias("all"))
    others = F.array_sort(F.transform(F.slice("all", 2, F.size("all")), lambda x: F.struct(x["ord"], x["rule"])))
    return per.select("ip", "timestamp", "seq", F.col("all")[0].alias("top"), F.transform(others, lambda x: x["rule"]).alias("related_rules"))


def to_alerts(first: DataFrame, events: DataFrame, rules: RuleSet, n: int | None = None) -> DataFrame:
    """Alerts with their reasons from prioritised firings and the events they belong to."""
    events = events.repartition(n, "ip", "timestamp", "seq") if n else events
    rows = first.withColumnsRenamed({"ip": "__ip", "timestamp": "__ts", "seq": "__seq"}).join(events, (F.col("__ip") == F.col("ip")) & (F.col("__ts") == F.col("timestamp")) & (F.col("__seq") == F.col("seq")))
    reason, kind, severity = F.lit(None).cast("string"), F.col("event_type"), F.lit(None).cast("string")
    top = F.col("top")
    # each value is built where a template names it
    values = {"rule": top["rule"], "ip": F.col("ip"), "count": top["count"], "pattern": top["pattern"], "rules": top["pattern"], "field": top["field"], "group": top["group"], "interval": duration_column(top["interval_us"]), "jitter": F.concat(F.bround(top["jitter"] * 100).cast("int").cast("string"), F.lit("%"))}
    for r in rules.active:
        own = {"description": r.description, "window": duration_text(micros(r.window)) if r.window else "", "threshold": r.threshold, "distinct": r.distinct}
        usual = {"signature": "{description}: {pattern} in {field} from {ip}", "correlation": "{description}: {count} rules for {ip} within {window} ({rules})"}.get(r.kind, "{description}: {count} from {ip} within {window}")
        text = r.reason or usual
        mine = top["rule"] == r.name
        reason = F.when(mine, render(text, values | {k: F.lit(v) for k, v in own.items() if "{" + k + "}" in text})).otherwise(reason)
        severity = F.when(mine, F.lit(r.severity)).otherwise(severity)
        if r.alert_type:
            kind = F.when(mine, F.lit(r.alert_type)).otherwise(kind)
    return rows.select(F.sha2(F.concat_ws("/", "ip", "seq", F.col("top.rule")), 256).alias("id"), "seq", "timestamp", "ip", kind.alias("event_type"), severity.alias("severity"), reason.alias("reason"), F.col("top.count").alias("event_count"), F.col("top.rule").alias("trigger_rule"), "related_rules")


def judged(events: DataFrame, rules: RuleSet, history: DataFrame | None = None, since: Column | None = None, n: int | None = None) -> DataFrame:
    """All firings, the correlations' too, with `kept`. history: stored alerts, exploded to (ip, timestamp, rule).

    since: only firings from then on are judged; events before fill the windows.
    """
    n = n or parts(events)
    fired = firings(events, rules, n, since)
    if since is not None:
        fired = fired.where(F.col("timestamp") >= since)
        history = None if history is None else history.where(F.col("timestamp") < since)
    # stored alerts are read by cooldowns and correlations; firings, few beside events, are read twice from here on
    history = None if history is None else history.persist()
    found = cooldown(fired, rules, history, n).persist()
    links = [r for r in rules.active if r.kind == "correlation"]
    names = [r.name for r in rules.active if r.kind != "correlation"]
    if not links:
        return found
    if len(links) > 1:
        return found.unionByName(correlate_several(found, links, rules, history, n))
    return found.unionByName(cooldown(correlate(found, links[0], names, history, n), RuleSet(links, rules.default_cooldown), history, n))


def alert_history(alerts: DataFrame) -> DataFrame:
    """Rows (ip, timestamp, rule) of what stored alerts name."""
    return alerts.select("ip", "timestamp", F.explode(F.array_union(F.array("trigger_rule"), F.coalesce("related_rules", F.array().cast("array<string>")))).alias("rule"))


def detect(events: DataFrame, rules: RuleSet, history: DataFrame | None = None) -> DataFrame:
    """Events to alerts; `history` continues from stored alerts (see alert_history)."""
    n = parts(events)
    found = judged(events, rules, history, n=n).where("kept")
    return to_alerts(prioritize(found, rules, n), events, rules, n)


def halo(rules: RuleSet) -> int:
    """Microseconds of events before a time that alerts from then on depend on: the longest window, and for a beacon's
    window one more, in which a pause of half of min_interval tells which contacts count."""
    return max([0, *(micros(r.window) for r in rules.active if r.kind == "threshold"), *(2 * micros(r.window) for r in rules.active if r.kind == "beacon")])


def _from(rows: DataFrame, since: Column, us: int) -> DataFrame:
    """Rows from `us` before a time on; of a table kept by day, no other day is read."""
    first = _after(since, -us)
    if "event_date" in rows.columns:
        rows = rows.where(F.col("event_date") >= F.to_date(first))
    return rows.where(F.col("timestamp") >= first)


def detect_since(events: DataFrame, alerts: DataFrame, rules: RuleSet, since: Column) -> DataFrame:
    """Alerts from a time on, as a run over all events would give them: of stored events those of the halo are read again,
    of stored alerts (those before that time) those that cooldowns and correlations look back on.

    Alerts are stored as detect gives them. An address whose contacts with a target come less than half of a beacon's
    min_interval apart through all of the halo may count them from another one on than the whole run.
    """
    stored = alert_history(_from(alerts, since, rules.lookback()))
    recent = _from(events, since, halo(rules))
    n = parts(recent)
    found = judged(recent, rules, stored, since, n).where("kept")
    return to_alerts(prioritize(found, rules, n), recent.where(F.col("timestamp") >= since), rules, n)
