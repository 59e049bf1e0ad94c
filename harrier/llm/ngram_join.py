"""Jaccard self-join on word n-grams by vertical partitioning: the global order of n-grams is cut into fragments.

The order puts rare n-grams first: those found in few documents by hash, then the common ones by their count (in powers of
two) and hash. Any order gives the same links; the counts, of all documents, are made from 32 bits and more of each hash,
packed. All n-grams of FREQUENT documents and more are named common, in a table of 2^PLACES counts: an n-gram that falls on a
common one's place counts as common, which costs a little order and no link. So the table is of one size for any input.

Two sets of the wanted likeness share an n-gram among the first of each (so many that what is left could not reach it).
Such prefixes are posted: an n-gram that several sets post is a list. All pairs that share a short list are compared, where
what they share of their prefixes leaves room for the likeness, and each set of a long list with the head with which it
shares most of them; what is left of long lists in several components is compared in blocks, all lists of one head
together. A pair is decided by the sets' segments: a segment holds what a set has in one fragment of the order; each pair's overlap is counted in each
fragment by itself and summed over fragments. So no whole set meets another in one row, and a frequent
n-gram, last in the order, brings nobody together. In blocks a task counts the overlaps of two blocks' sets, a part of
their n-grams after the other, sums them, and sends on as many links as connect the same components.

Words are runs of non-blank characters, A-Z lower-cased; a set has the distinct runs of `size` words, or the whole
sequence where it is shorter. Texts without a word, null ones too, have an empty set and link with nothing. Equal sets are one node.
Repeated rows share a set. Rows without an id are documents for themselves, after all others: they take part, and have a
null component_id where nothing with an id is linked with them. An empty table gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import Scratch, checkpoint, partitions, parts
from harrier.llm.components import components, reshuffled
from harrier.llm.minhash import _across, set_hash, sets_of

#: Documents from which an n-gram is called common, and bits of a hash that name a place of the table that says which are (32 MB in a task).
FREQUENT, PLACES = 16, 25
#: Fragments of the order (the last has the common n-grams), sets of a short list and of a block, and wanted keys that are broadcast.
FRAGMENTS, SHORT, BLOCK, FEW = 4, 16, 256, 500_000
#: n-grams counted by a task before it sends them.
_HELD = 2_000_000
_LATE = 1 << 62


def _doc() -> Column:
    """The document a row belongs to; rows without an id are told apart by their text."""
    return F.coalesce("doc_id", F.lit(_LATE) + F.pmod(F.xxhash64("text"), F.lit(_LATE >> 1)))


def prefix_size(n, percent: int):
    """How many of a set's first n-grams are posted."""
    return n - (percent * n + 99) // 100 + 1


def _steps(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 24 bits that rise from each start on, as 16-bit steps (the highest means: and so many more), and each number's end among them."""
    step = np.diff(values, prepend=0)
    step[starts] = values[starts]
    more, rest = np.divmod(step, 0xFFFF)
    ends = np.cumsum(more + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0xFFFF, "<u2")
    out[ends - 1] = rest
    return out, ends


def _stepped(raw: bytes) -> np.ndarray:
    """The numbers of one start."""
    steps = np.frombuffer(raw, "<u2")
    return np.cumsum(steps, dtype=np.int64)[steps < 0xFFFF]


def _sent(size: int, buckets: int):
    """n-grams of all sets, counted within a task, as buckets of 24 bits each: those seen once, and others with their count."""
    low, shift = buckets.bit_length() - 1, np.uint64(64 - 24 - (buckets.bit_length() - 1))

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        # bucket first, so that one sort puts a bucket's numbers in order
        keys = np.sort(((keys & np.uint64(buckets - 1)) << np.uint64(24)) | (keys >> np.uint64(low)))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(first, len(keys)))
        keys = keys[first].astype(np.int64)
        bucket, own = keys >> 24, keys & 0xFFFFFF
        out = []
        for one in (True, False):
            picked = (count == 1) == one
            ends = np.concatenate([[0], np.cumsum(np.bincount(bucket[picked], minlength=buckets))])
            steps, last = _steps(own[picked], ends[:-1][ends[:-1] < ends[1:]])
            cuts = np.concatenate([[0], last])[ends].tolist()
            out.append(pa.array([steps[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
            if not one:
                cuts, n = ends.tolist(), np.minimum(count[picked], 0xFFFF).astype("<u2")
                out.append(pa.array([n[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), *out], ["bucket", "once", "many", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in parts(batches, 1500, 0):
            own = [x >> shift for x in sets_of(batch.column(0), size) if len(x)]
            held += own
            n += sum(map(len, own))
            if n >= _HELD:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    return run


def _frequencies(buckets: int):
    low = buckets.bit_length() - 1

    def run(rows: pa.Table) -> pa.Table:
        """The places of the n-grams of a bucket that FREQUENT documents have, and the power of two in their number."""
        read = lambda name: [_stepped(x.as_buffer()) for c in rows.column(name).chunks for x in c]
        once, many = np.concatenate(read("once")), np.concatenate(read("many"))
        counts = np.frombuffer(b"".join(x.as_buffer() for c in rows.column("counts").chunks for x in c), "<u2")
        keys = np.concatenate([once, many])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        n = np.add.reduceat(np.concatenate([np.ones(len(once), np.int64), counts.astype(np.int64)])[order], first) if len(keys) else np.empty(0, np.int64)
        some = n >= FREQUENT
        found = (keys[first][some].astype(np.uint64) << np.uint64(low)) | np.uint64(rows.column("bucket")[0].as_py())
        return pa.table({"place": (found >> np.uint64(24 + low - PLACES)).astype(np.int32), "power": np.log2(n[some]).astype(np.int32)})

    return run


class Order:
    """The global order of n-grams: a class for each (0: rare), then the hash. The table has the classes by the first PLACES bits of the hash."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def classes_of(self, items: np.ndarray) -> np.ndarray:
        return self.table[items >> np.uint64(64 - PLACES)]

    def sorted(self, items: np.ndarray) -> np.ndarray:
        """A set (ascending hashes) in the global order."""
        return items[np.argsort(self.classes_of(items), kind="stable")]

    def fragments(self, items: np.ndarray) -> np.ndarray:
        """Each n-gram's fragment: the order is cut at fixed hashes among the rare ones and before the common ones."""
        range_ = ((items >> np.uint64(32)) * np.uint64(FRAGMENTS - 1)) >> np.uint64(32)
        return np.where(self.classes_of(items) > 0, FRAGMENTS - 1, range_.astype(np.int64))


def global_order(texts: DataFrame, size: int) -> Order:
    """Counts the documents of every n-gram; those of FREQUENT documents and more get a class."""
    spark = texts.sparkSession
    buckets = 1 << max(8, (2 * partitions(spark) - 1).bit_length())
    sent = texts.select("text").mapInArrow(_sent(size, buckets), "bucket int, once binary, many binary, counts binary")
    found = sent.groupBy("bucket").applyInArrow(_frequencies(buckets), "place int, power int")
    found = found.groupBy("place").agg(F.max("power").cast("byte").alias("power")).toArrow()  # 2^PLACES rows of 5 bytes at most
    table = np.zeros(1 << PLACES, np.uint8)
    table[found.column("place").to_numpy()] = found.column("power").to_numpy()
    return Order(table)


def _posted(size: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in parts(batches, 1500, 2):
            n, ids, first = [], [], []
            for own in sets_of(batch.column(2), size):
                n.append(len(own))
                ids.append(set_hash(own) if len(own) else None)
                first.append(order.sorted(own)[: prefix_size(len(own), percent)].view(np.int64) if len(own) else np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), lists], ["doc_id", "doc", "n_shingles", "node", "prefix"])

    return run


def _segments(size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each fragment in which a set has something."""
        order = shared.value
        for batch in parts(batches, 1500, 0):
            nodes, fragments, raw = [], [], []
            for own in sets_of(batch.column(0), size):
                node, of = set_hash(own), order.fragments(own)
                for part in np.unique(of).tolist():
                    nodes.append(node), fragments.append(part), raw.append(own[of == part].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(fragments, pa.int32()), pa.array(raw, pa.binary())], ["node", "fragment", "items"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two segments of one fragment share."""
    for batch in batches:
        both = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(batch.column(3), batch.column(4), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(both, pa.int64())], ["a", "b", "least", "both"])


def _least(a: Column, b: Column, percent: int) -> Column:
    """The overlap that two sets of such sizes need."""
    return F.ceil(percent * (a + b) / (100 + percent))


def _near(a: Column, b: Column, percent: int) -> Column:
    """Whether two sizes leave room for the likeness."""
    return F.lit(100) * F.least(a, b) >= percent * F.greatest(a, b)


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, least): all pairs that share short lists and may be alike by what they share of their prefixes."""
    # what pairs may share besides short lists: the long ones that either has
    many = met.where(F.col("size") > SHORT).groupBy(F.col("node").alias("in_long")).agg(F.count("*").alias("long_lists"))
    few = met.where(F.col("size") <= SHORT).join(many, F.col("node") == F.col("in_long"), "left").select("key", "node", "n", F.coalesce("long_lists", F.lit(0)).alias("long_lists"))
    other = few.select(*[F.col(c).alias(f"o_{c}") for c in few.columns])
    both = few.join(other, (F.col("key") == F.col("o_key")) & (F.col("node") > F.col("o_node")) & _near(F.col("n"), F.col("o_n"), percent))
    pairs = both.groupBy(F.col("o_node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("lists"), F.first("n").alias("n"), F.first("o_n").alias("o_n"), F.first(F.least("long_lists", "o_long_lists")).alias("more"))
    pairs = pairs.withColumn("least", _least(F.col("n"), F.col("o_n"), percent))
    # beyond the prefix that ends first in the order, no more can be shared than that set has left
    rest = lambda n: F.floor((percent * n + 99) / 100) - 1
    return pairs.where(F.col("lists") + F.col("more") + F.greatest(rest(F.col("n")), rest(F.col("o_n"))) >= F.col("least")).select("a", "b", "least")


def _heads(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of each set and the head of its lists with which it shares most of them."""
    head = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("o"), "node", "n")).alias("h")).select(reshuffled("key").alias("k"), "h")
    met = rows.join(head, (F.col("key") == F.col("k")) & (F.col("node") != F.col("h.node")) & _near(F.col("n"), F.col("h.n"), percent))
    shared = met.groupBy(F.col("node").alias("b"), F.col("h.node").alias("a")).agg(F.count("*").alias("lists"), F.first(_least(F.col("n"), F.col("h.n"), percent)).alias("least"))
    return shared.groupBy("b").agg(F.max_by(F.struct("a", "least"), F.struct("lists", "a")).alias("x")).select("x.a", "b", "x.least")


def _confirmed(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Of pairs (a, b, least) those that share `least` n-grams: counted in each fragment by itself, summed for each pair."""
    got = pairs.join(segments.select(F.col("node").alias("nb"), "fragment", F.col("items").alias("ib")), F.col("b") == F.col("nb")).select("a", "b", "least", "fragment", "ib")
    of_a = segments.select(reshuffled("node").alias("na"), F.col("fragment").alias("fa"), F.col("items").alias("ia"))
    got = got.join(of_a, (F.col("a") == F.col("na")) & (F.col("fragment") == F.col("fa"))).select("a", "b", "least", "ia", "ib")
    counted = got.mapInArrow(_overlaps, "a long, b long, least long, both long")
    return counted.groupBy("a", "b").agg(F.sum("both").alias("both"), F.first("least").alias("least")).where("both >= least").select("a", "b")


def _open(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of lists whose sets lie in several components."""
    named = rows.join(found.select(F.col("node").alias("id"), F.col("component").alias("c")), F.col("node") == F.col("id"), "left")
    named = named.select("key", "node", F.coalesce("c", "node").alias("component"))
    open_ = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return named.join(open_.select(reshuffled("key").alias("k")), F.col("key") == F.col("k"), "left_semi")


def _blocks(rows: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Links across components among the sets of long lists: lists of one head are a group, whose sets are dealt to blocks that meet in pairs."""
    head = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("o"), "node")).alias("h")).select(reshuffled("key").alias("k"), F.col("h.node").alias("head"))
    group = rows.join(head, F.col("key") == F.col("k")).select("head", "node", "component").distinct()
    sizes = group.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).select(reshuffled("head").alias("g"), "blocks")
    group = group.join(sizes, F.col("head") == F.col("g")).drop("g")
    whole = segments.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("fragment", "items"))).alias("s"))
    whole = whole.select(F.col("node").alias("id"), F.aggregate("s", F.lit(b""), lambda had, x: F.concat(had, x["items"])).alias("items"))
    group = group.join(whole, F.col("node") == F.col("id")).drop("id")
    group = group.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = group.select("head", F.least("own", "to").alias("low"), F.greatest("own", "to").alias("high"), "own", "node", "component", "items")
    return group.groupBy("head", "low", "high").applyInArrow(_forest(percent), "a long, b long")


def _forest(percent: int):
    across = _across(percent)

    def run(rows: pa.Table) -> pa.Table:
        """Of the links between two blocks as many as connect the same components: none that closes a circle."""
        links = across(rows)
        of = dict(zip(rows.column("node").to_pylist(), rows.column("component").to_pylist(), strict=True))
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        keep = []
        for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist(), strict=True):
            x, y = root(of[a]), root(of[b])
            keep.append(x != y)
            up[x] = y
        return links.filter(pa.array(keep, pa.bool_()))

    return run


def _only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is wanted; the wanted ones (a column of long) are broadcast where they are counted to be few."""
    wanted = wanted.toDF("wanted")
    side = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    return rows.join(side, F.col(key) == F.col("wanted"), "left_semi")


def similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): documents whose sets' likeness is `percent` in 100 or more are linked."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select("doc_id", _doc().alias("doc"), "text")
    order = docs.sparkSession.sparkContext.broadcast(global_order(texts, size))
    posted = scratch.keep("posted", texts.mapInArrow(_posted(size, percent, order), "doc_id long, doc long, n_shingles long, node long, prefix array<long>"))
    rows = checkpoint(posted.select("doc_id", "doc", "n_shingles", "node"))
    nodes = posted.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("first_doc"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"))
    nodes = scratch.keep("nodes", nodes)
    scratch.drop("posted")
    scratch.settle()
    spread = nodes.select(F.explode("prefix").alias("key"), "node", "n")
    lists = spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select(reshuffled("key").alias("k"), "size")
    met = scratch.keep("met", spread.join(lists, F.col("key") == F.col("k")).select("key", "node", "n", "size"))
    firsts = checkpoint(nodes.select("node", "first_doc"))
    scratch.drop("nodes")
    pairs = scratch.keep("pairs", _pairs(met, percent))
    long_ = scratch.keep("long", met.where(F.col("size") > SHORT).select("key", "node", "n"))
    scratch.drop("met")
    scratch.settle()
    # only sets that may have a partner are read again
    wanted = pairs.select("a").union(pairs.select("b")).union(long_.select("node")).distinct()
    wanted = scratch.keep("wanted", _only(firsts, "node", wanted))
    some = _only(texts.where("text IS NOT NULL"), "doc", wanted.select("first_doc").distinct())
    segments = _only(some.select("text").mapInArrow(_segments(size, order), "node long, fragment int, items binary"), "node", wanted.select("node"))
    segments = scratch.keep("segments", segments.groupBy("node", "fragment").agg(F.first("items").alias("items")))
    scratch.settle()
    # a pair that shares both kinds of lists may be named twice
    links = scratch.keep("links", _confirmed(pairs.unionByName(_heads(long_, percent)), segments))
    scratch.settle()
    found = components(links)
    more = scratch.keep("more", _blocks(_open(long_, found), segments, percent))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    named = firsts.join(found.select(F.col("node").alias("id"), "component"), F.col("node") == F.col("id"), "left").select("node", "first_doc", F.coalesce("component", "node").alias("component"))
    named = checkpoint(named)
    scratch.close()
    scratch.settle()
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id")).select(reshuffled("component").alias("c"), "component_id")
    named = named.join(least, F.col("component") == F.col("c")).select(F.col("node").alias("id"), "component_id")
    component = F.coalesce("component_id", "doc")
    return rows.join(named, F.col("node") == F.col("id"), "left").select("doc_id", "n_shingles", F.when(component < _LATE, component).alias("component_id"))


def op11_ngram_join(docs: DataFrame) -> DataFrame:
    return similar(docs, 4, 85)
