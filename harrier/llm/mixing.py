"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

The words of a source form one stream: its documents in the order of a hash of their content. The
stream is cut into blocks of equal size and may be read up to twice. Slots 0, 1, 2, ... of the
mix take the golden-ratio points frac((slot + 1) * phi); the source in whose share of [0, 1) a point
falls gets the slot, and the k-th slot of a source takes the k-th block of its stream. Ranks within
a source come from counts by (source, chunk of slots) and a short running sum over chunks, so that no
source meets in one task, and so do positions in a stream.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of
its own, last in order; documents of one key and text are interchangeable, every row counts; an
empty table gives an empty result. Input columns other than doc_id, text, source are not read here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.llm.common import WORD, checkpoint, content_order

#: Words in a block, chunks in which a source's stream is put in order, slots in a chunk of the schedule, cells of [0, 1).
BLOCK, CHUNKS, SLOT_CHUNK, CELLS = 256, 1024, 4096, 4096
#: frac(golden ratio), and frac(2**20 * golden ratio), so that large slot numbers keep their fraction.
_PHI, _PHI_HIGH = 0.6180339887498949, 648055.6943541979 % 1


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce("text", F.lit("")), F.col("doc_id"), F.col("source"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Each source's target, from rows (source, source_size).

    Sources in order of code points, null last, weigh `weights`, repeating. They share `share` times
    all words; none takes over `most` times its size, and what it leaves goes to the others by weight.
    That is target = min(most * size, level * weight) at the level which uses everything up.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("w", F.element_at(kinds, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("top", most * F.col("source_size")).withColumn("fill", F.col("top") / F.col("w"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    w = w.withColumn("level", F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "level"))).over(every)["level"])
    return w.select("source", "source_size", F.least("top", F.coalesce(F.col("level") * F.col("w"), F.col("top"))).alias("target"))


def streams(docs: DataFrame, keep: Sequence[str] = ("doc_id",), seed: int = 10, **shares) -> DataFrame:
    """Each document with its source's size, target and words to take, and its place in the source's stream."""
    text = F.col("text")
    rows = docs.select(*keep, F.col("source").alias("source"), words_in(text).alias("size"), content_hash(seed).alias("h"))
    rows = checkpoint(rows.withColumn("chunk", F.pmod("h", F.lit(CHUNKS)).cast("int")))
    part = rows.groupBy("source", "chunk").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("part_at", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    plan = targets(part.groupBy("source").agg(F.sum("part_size").alias("source_size")), **shares)
    part = part.join(plan, part["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    part = part.withColumn("need", F.floor(F.col("target") + 0.5).cast("long")).withColumnRenamed("source", "p_source").withColumnRenamed("chunk", "p_chunk")
    inside = Window.partitionBy("source", "chunk").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(part, placed["source"].eqNullSafe(part["p_source"]) & (placed["chunk"] == part["p_chunk"]))
    return placed.select(*keep, "source", "size", "source_size", "target", "need", "h", (F.col("part_at") + F.col("at")).alias("start"))


def schedule(plan: DataFrame) -> DataFrame:
    """Rows (slot, source, rank, first, last): the source of each slot and the words of its stream that it takes.

    plan: a row (source, need) for each source. A source that the points have left a few blocks short
    gets closing slots after the others; one that they give too many drops the last of them.
    """
    spark = plan.sparkSession
    every = Window.orderBy(F.col("source").asc_nulls_last())
    plan = plan.withColumn("n", F.ceil(F.col("need") / BLOCK).cast("long")).withColumn("sid", F.row_number().over(every))
    slots = plan.agg(F.sum("n")).first()[0] or 0
    ends = plan.withColumn("to", F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(float(max(slots, 1))))
    ends = ends.withColumn("from", F.coalesce(F.lag("to").over(every), F.lit(0.0))).where("n > 0")
    cells = ends.select("sid", "from", "to", F.explode(F.sequence(F.floor(F.col("from") * CELLS), F.least(F.floor(F.col("to") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    point = F.pmod(F.floor((F.col("slot") + 1) / 1048576) * F.lit(_PHI_HIGH) + F.pmod(F.col("slot") + 1, F.lit(1048576)) * F.lit(_PHI), F.lit(1.0))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", point).withColumn("cell", F.floor(F.col("x") * CELLS))
    # the cells number CELLS plus the sources: the scan of a slot touches those of one cell
    dealt = points.join(cells, "cell").where((F.col("x") >= F.col("from")) & (F.col("x") < F.col("to")))
    dealt = dealt.select("slot", "sid", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    counts = dealt.groupBy("sid", "chunk").count()
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(counts, ["sid", "chunk"]).select("slot", "sid", (F.col("ahead") + F.col("own")).alias("rank"))
    got = counts.groupBy("sid").agg(F.sum("count").alias("got"))
    short = plan.where("n > 0").join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < n")
    closing = short.select((F.lit(slots) + F.col("sid")).alias("slot"), "sid", F.explode(F.sequence("got", F.col("n") - 1)).alias("rank"))
    named = ranked.unionByName(closing).join(plan.select("sid", "source", "need", "n"), "sid").where("rank < n")
    first = F.col("rank") * BLOCK
    return named.select("slot", "source", "sid", "rank", first.alias("first"), F.least(first + BLOCK, F.col("need")).alias("last"))


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), seed: int = 10, **shares) -> DataFrame:
    """Each document with `taken`: how many of its words, repeats counted, the scheduled blocks take.

    `pass_words` has the words taken at the first and at the second reading of the stream.
    """
    placed = checkpoint(streams(docs, keep, seed, **shares))
    plan = checkpoint(placed.groupBy("source").agg(F.max("need").alias("need")))
    slots = schedule(plan)
    span = placed.where("size > 0").withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("d_first", F.col("start") + F.col("turn") * F.col("source_size"))
    span = span.where(F.col("d_first") < F.col("need")).withColumn("d_last", F.col("d_first") + F.col("size"))
    span = span.withColumn("rank", F.explode(F.sequence(F.floor(F.col("d_first") / BLOCK), F.floor((F.col("d_last") - 1) / BLOCK))))
    span = span.select("source", "start", "turn", "rank", "d_first", "d_last").alias("d")
    met = span.join(slots.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.rank") == F.col("s.rank")))
    used = F.least("d_last", "last") - F.greatest("d_first", "first")
    first, second = (F.sum(F.when(F.col("turn") == i, used).otherwise(0)) for i in (0, 1))
    took = met.select("d.source", "start", "turn", used.alias("used"), "d_first", "d_last", "first", "last").groupBy("source", "start").agg(first.alias("a"), second.alias("b")).alias("t")
    out = placed.alias("p").join(took, F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.start") == F.col("t.start")) & (F.col("p.size") > 0), "left")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return out.select(*keep, "p.source", "size", "source_size", "target", "h", (a + b).alias("taken"), F.array(a, b).alias("pass_words"))


def op10_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: int = 10) -> DataFrame:
    """The documents as the mix holds them: a row for each reading, its text cut to the words taken.

    Columns are those of `docs`; where there is n_chars, it follows the text. Documents without
    words and those that their source's target leaves out have no row. Of copies the first in order of
    their other columns takes what the schedule gives most.
    """
    names = docs.columns
    took = mix(docs, keep=(), seed=seed)
    # rows of one hash are the same document
    took = took.select(F.col("h").alias("__h"), "size", "pass_words").withColumn("__n", F.row_number().over(Window.partitionBy("__h").orderBy(F.desc("pass_words")))).withColumnRenamed("__h", "__th").withColumnRenamed("__n", "__tn")
    took = took.withColumn("__take", F.explode("pass_words")).where("__take > 0").select("__th", "__tn", F.col("size").alias("__size"), "__take")
    rows = docs.withColumn("__h", content_hash(seed)).withColumn("__n", F.row_number().over(Window.partitionBy("__h").orderBy(content_order(docs, "doc_id", "text", "source"))))
    # two comparisons in place of an equality leave the hash as the only key, by which the rows already lie
    got = rows.join(took, (F.col("__h") == F.col("__th")) & (F.col("__n") <= F.col("__tn")) & (F.col("__n") >= F.col("__tn")))
    text = F.col("text")
    # words with the white space before them, so that lines stay
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), 1), 1, F.greatest(F.col("__take"), F.lit(1)).cast("int")), "")
    got = got.withColumn("__text", F.when(F.col("__take") >= F.col("__size"), text).otherwise(cut))
    made = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return got.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in names])
