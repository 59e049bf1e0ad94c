"""Log lines: reading, limits, times, outcomes.

Parsers take rows with a column `value` and give the same rows with `outcome` (parsed, skipped,
parse_error) and the event columns. Blank lines and lines over MAX_BYTES are dropped first.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions.fields import field

MAX_BYTES = 65_536


def usable(lines: DataFrame) -> DataFrame:
    return lines.where((F.octet_length("value") <= MAX_BYTES) & F.col("value").rlike(r"\S"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and `line_no`, which sorts like the places of a file's lines: where the part of the file begins that a task reads, and a number that grows within it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("line_no"))
    return usable(rows)


def stream_lines(spark: SparkSession, path: str, from_start: bool = True, since: datetime | None = None) -> DataFrame:
    """New files of a folder as they come; a checkpoint remembers those read.

    Without from_start, files last changed before `since` are passed over; the default is the time of the call. A
    job that is to be restarted gives the time of its first start, else what came in between is passed over.
    """
    rows = spark.readStream.text(path)
    if not from_start:
        rows = rows.where(F.col("_metadata.file_modification_time") >= F.lit(since or datetime.now(timezone.utc)))
    return usable(rows)


def keep_only(events: DataFrame, event_types: list[str] | None = None, present: tuple[str, ...] = ()) -> DataFrame:
    """Events of these types that have these fields; all others are left out before they are shipped."""
    rows = events if event_types is None else events.where(F.col("event_type").isin(event_types))
    for name in present:
        rows = rows.where(field(name).isNotNull())
    return rows


def outcomes(parsed: DataFrame, source: str) -> DataFrame:
    """How many lines ended how."""
    return parsed.groupBy(F.lit(source).alias("source"), "outcome").agg(F.count("*").alias("count"))


def part(pattern: str, group: int, text: Column | None = None) -> Column:
    """A group of the first match, null where it is empty or nothing matches."""
    got = F.regexp_extract(F.col("value") if text is None else text, pattern, group)
    return F.when(got != "", got)


def log_time(text: Column) -> Column:
    """RFC 3339, day/month/year:time zone, or Unix seconds with a fraction; null otherwise."""
    seconds = F.when(text.rlike(r"^\d+(\.\d+)?([eE]\+?\d+)?$"), F.timestamp_micros((text.try_cast("decimal(20,6)") * 1_000_000).cast("long")))
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d"), text.try_cast("timestamp"))
    return F.coalesce(seconds, iso, F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def syslog_time(text: Column, now: Column, zone: str = "UTC") -> Column:
    """RFC 3339, or month day time without a year: the year of `now`, the one before if that is over a day ahead."""
    short = F.regexp_replace(text, r"\s+", " ")
    guess = lambda year: F.to_utc_timestamp(F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), short), F.lit("yyyy MMM d HH:mm:ss")), zone)
    this = guess(F.year(now))
    dated = F.when(this > now + F.expr("INTERVAL 24 HOURS"), guess(F.year(now) - 1)).otherwise(this)
    fixed = F.regexp_replace(text, r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d\d-\d\dT"), fixed.try_cast("timestamp")), dated)


def metadata(**values: Column) -> Column:
    """A map of the values that there are."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))
