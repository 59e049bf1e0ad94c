"""Document fingerprints from closed syncmers. DataFrame functions only.

A text is read as units: a run of WHOLE non-blank code points or fewer is one unit, a longer run gives its code
points one by one until so many are left; so what a unit is depends on nothing before it. Of each run of K units the
S-unit runs inside are compared by hash; if the least one lies at either edge, the K-run is a closed
syncmer and anchors the fingerprint at its place, the number of its first unit. Whether a K-run is chosen depends on
nothing around it, so an edit moves only the anchors that overlap it, in unbroken text too.

The fingerprint written out is the text's whole anchor set: the 64-bit hashes in order, 16 hexadecimal digits each, so it
grows with the text. Likeness is the Jaccard likeness of two fingerprints, and can be had from what is written out;
`positional_matches` lines anchors up by place.

A text with units but fewer than K has one anchor, all its units; a text of blanks has its hash as
the only anchor; an empty or null text has none and the empty fingerprint. Two texts without anchors are
alike (1), one is unlike any other (0). Equal texts have equal fingerprints. Documents of
one key follow each other in order of their text's hash, null keys come last, in that order too; every row counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.llm.common import partitions

#: Units of an anchor and of the runs compared inside it, code points of a unit, and ranges of keys found by quantiles.
K, S, WHOLE, RANGES = 5, 2, 8, 256
_RUN = r"[^\x20\x09-\x0D]"
_UNIT = f"{_RUN}{{1,{WHOLE}}}(?!{_RUN})|{_RUN}"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column) -> Column:
    """The hashes of a text's closed syncmers, one place for each K-run, null at each that is none."""

    def from_hashes(h: Column) -> Column:
        return _let(F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b)), lambda m: from_runs(h, m))

    def from_runs(h: Column, m: Column) -> Column:
        # m holds the hash of the S = 2 units from each place; a K-run has those of K - 1 places
        inside = lambda i: F.least(*[F.get(m, i + k) for k in range(1, K - S)])
        edge = lambda i: F.least(F.get(m, i), F.get(m, i + (K - S)))
        own = lambda i: F.xxhash64(F.get(m, i), F.get(m, i + 2), F.get(h, i + (K - 1)))
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.when(edge(i) <= inside(i), own(i)))
        return F.when(F.size(h) >= K, runs).otherwise(F.array(F.xxhash64(h)))

    units = F.transform(F.regexp_extract_all(text, F.lit(f"({_UNIT})"), 0), lambda u: F.xxhash64(u))
    return _let(units, lambda h: F.when(F.size(h) > 0, from_hashes(h)))


def anchor_set(text: Column) -> Column:
    """The distinct hashes of a text's anchors."""
    blank = F.when(text == "", F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(text)))
    return F.array_distinct(F.array_compact(F.coalesce(anchors(text), blank)))


def fingerprint(own: Column) -> Column:
    """All anchors of the set in order, in hexadecimal; empty without an anchor."""
    return F.array_join(F.transform(F.sort_array(own), lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the anchors of either set that both hold."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def placed_anchors(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, place, anchor): every anchor of every text with the number of its first unit."""
    rows = docs.select("doc_id", F.posexplode(anchors(F.coalesce("text", F.lit("")))).alias("place", "anchor"))
    return rows.where("anchor IS NOT NULL")


def positional_matches(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of doc_ids the stretches that both hold: rows a, b, shift, anchors, first, last.

    Anchors that occur once in either text match by hash; matches of one pair with one shift (place in b less place in a)
    are a stretch from its first to its last place in a.
    """
    every = placed_anchors(docs)
    once = every.groupBy("doc_id", "anchor").agg(F.count("*").alias("n"), F.min("place").alias("place")).where("n = 1")
    of = lambda side: once.select(F.col("doc_id").alias(f"{side}_id"), F.col("anchor").alias(f"{side}_anchor"), F.col("place").alias(f"{side}_place"))
    left = pairs.select("a", "b").join(of("a"), F.col("a") == F.col("a_id"))
    met = left.join(of("b"), (F.col("b") == F.col("b_id")) & (F.col("a_anchor") == F.col("b_anchor")))
    return met.groupBy("a", "b", (F.col("b_place") - F.col("a_place")).alias("shift")).agg(F.count("*").alias("anchors"), F.min("a_place").alias("first"), F.max("a_place").alias("last"))


def _range_of(key: Column, bounds: list[float], lo: int = 0) -> Column:
    """How many of the sorted bounds are at or below the key, by halving."""
    if not bounds:
        return F.lit(lo)
    mid = len(bounds) // 2
    return F.when(key >= F.lit(bounds[mid]), _range_of(key, bounds[mid + 1 :], lo + mid + 1)).otherwise(_range_of(key, bounds[:mid], lo))


def with_next(docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Each row of (doc_id, text) with the columns `made` and with `next`: text and those columns of the next row in descending doc_id; the first follows the last.

    Rows are dealt out by ranges of doc_id of about equal size, rows without one by ranges of their text's hash; the first
    row of each range is dealt to the range before it too, so that no task needs more than its own range.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    every = docs.select("doc_id", "h")
    n = min(RANGES, partitions(spark))
    bounds = sorted(set(every.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.001))) if n > 1 else []
    fine = math.ceil(partitions(spark) / n)
    coarse = _range_of(F.col("doc_id"), bounds)
    if fine > 1 and len(bounds) > 1:
        edges = F.array(*[F.lit(b) for b in [bounds[0], *bounds, bounds[-1]]])
        low, high = F.get(edges, coarse), F.get(edges, coarse + 1)
        inner = F.when(high > low, F.least(F.greatest(F.floor((F.col("doc_id") - low) / (high - low) * fine), F.lit(0)), F.lit(fine - 1))).otherwise(0)
        coarse = coarse * fine + inner
    late = -1 - F.shiftrightunsigned("h", 56).cast("int").bitwiseXOR(F.lit(128))  # 256 ranges in the order of signed hashes
    place = F.coalesce(coarse.cast("int"), late)
    # one row for each range: their number is that of the partitions
    firsts = every.groupBy(place.alias("p")).agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("k")).orderBy(F.desc("p")).collect()
    heads = [(f["k"]["doc_id"], ~f["k"]["h"], firsts[i - 1]["p"]) for i, f in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(heads, "k long, k_h long, host int"))
    rows = docs.join(guests, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("k_h")), "left").withColumn("p", place)
    rows = rows.withColumn("at", F.explode(F.when(F.col("host").isNull(), F.array(F.struct(F.col("p").alias("p"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("p").alias("p"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("p"), F.lit(True).alias("guest"))))))
    # the columns are made after the exchange, which so carries the texts alone
    rows = rows.select("doc_id", "text", "h", F.col("at.p").alias("p"), F.col("at.guest").alias("guest")).repartition("p").withColumns(made)
    order = Window.partitionBy("p").orderBy("guest", F.col("doc_id").desc_nulls_last(), "h")
    return rows.withColumn("next", F.lead(F.struct("text", *made)).over(order)).where("NOT guest").drop("p", "guest", "h")


def op4_syncmers(docs: DataFrame) -> DataFrame:
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), {"own": anchor_set(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("following"))
    made = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "following", anchor_set(F.col("edited")).alias("new"))
    # exploding a single value keeps the edited text's anchors from being computed for each use
    made = made.withColumn("new", F.explode(F.array("new")))
    return made.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
