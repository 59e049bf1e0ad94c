"""Near-duplicate documents by b-bit MinHash with bands, confirmed on full shingle sets.

Documents of one shingle set are one node. Of each node's 100 minima the low 4 bits are packed into
a signature; 20 bands of 5 full minima propose candidates, 25 of 4 where the threshold is below 0.85. A crowded band never yields all its pairs:
each of its nodes is compared with the likeliest of its bands' heads. Bands that the links found leave in several
components are compared as a whole, the large ones block by block, where only links are sent on. A pair whose
collision-corrected bit count lies far below the threshold is dropped; the others are decided by
their whole sets. At similarity 0.85 a link misses all bands once in 100,000 times,
at 0.8 once in 500,000.

Words are runs of non-blank characters, A-Z lower-cased; a set has the distinct runs of
`size` words (three for op8), or the whole sequence where it is shorter. Documents without a word have an empty set, link
with nothing and are kept. Repeated rows share a set; ties fall to the smallest doc_id. Rows with a
null doc_id take part; a component of only such rows has a null id, and its rows are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import Scratch, checkpoint, mixed_bits, parts, shingles, split, word_hashes
from harrier.llm.components import components, reshuffled

#: Minima, rows of a band, low bits kept of a minimum, and by how much an estimate may fall short of the threshold.
MINIMA, ROWS, BITS, SLACK = 100, 5, 4, 0.18
LONGS = -(-MINIMA // 16)
#: Rounds in which a node is compared with the likeliest head of its bands before what is left in several components is
#: compared as a whole, nodes of a band whose pairs are taken one by one, and of a block else.
NEAREST, SMALL, BLOCK = 1, 16, 256


def _seeds(n: int, start: int) -> np.ndarray:
    return mixed_bits(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_XOR = (_seeds(MINIMA, 1) >> np.uint64(32)).astype(np.uint32)
_TIMES = (_seeds(MINIMA, 1001) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BAND = _seeds(ROWS, 2001) | np.uint64(1)


def minima(items: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set's 64-bit hashes."""
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    x = (items >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        low = np.minimum(low, ((x[at : at + 512, None] ^ _XOR) * _TIMES).min(0))
    return low


def bands(low: np.ndarray, width: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each row of minima."""
    parts = low.reshape(len(low), -1, width).astype(np.uint64)
    return mixed_bits((parts * _BAND[:width]).sum(2, dtype=np.uint64) + np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def packed(low: np.ndarray) -> np.ndarray:
    """Signatures: the low BITS = 4 bits of all minima, sixteen minima to a 64-bit number."""
    bits = np.zeros((len(low), LONGS * 16), np.uint64)
    bits[:, :MINIMA] = low & np.uint32(15)
    return (bits.reshape(len(low), LONGS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two signatures by bit counts: the share of equal minima, less what collides by chance."""
    differ = F.lit(0)
    for k in range(LONGS):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    flat, bounds = split(texts)
    hashes = word_hashes(flat) if len(flat) else np.empty(0, np.uint64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.sort(shingles(hashes[a:b], size))
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def set_hash(own: np.ndarray) -> int:
    x = mixed_bits(own + np.uint64(len(own)))
    parts = np.array([x.sum(dtype=np.uint64), np.bitwise_xor.reduce(x), len(own)], np.uint64)
    return int(mixed_bits((parts * _BAND[:3]).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def _signed(size: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1500, 1):
            n, ids, low = [], [], np.zeros((batch.num_rows, MINIMA), np.uint32)
            for i, own in enumerate(sets_of(batch.column(1), size)):
                n.append(len(own))
                ids.append(set_hash(own) if len(own) else None)
                if len(own):
                    low[i] = minima(own)
            keys = bands(low, width).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
            raw = packed(low)
            signatures = pa.ListArray.from_arrays(np.arange(0, raw.size + 1, LONGS, dtype=np.int32), pa.array(raw.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), lists, signatures], ["doc_id", "n_shingles", "node", "bands", "signature"])

    return run


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1500, 0):
            ids, raw = [], []
            for own in sets_of(batch.column(0), size):
                if len(own):
                    ids.append(set_hash(own))
                    raw.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["node", "items"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _across(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """Links between the sets of two blocks, one for two components."""
        nodes, component, own = (rows.column(c).to_numpy() for c in ("node", "component", "own"))
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("items").combine_chunks()]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        flat = lambda side: (np.concatenate([sets[i] for i in side] or [np.empty(0, np.uint64)]), np.repeat(np.arange(len(side)), [len(sets[i]) for i in side]))
        (x, of_x), (y, of_y) = flat(left), flat(right)
        known = np.intersect1d(np.unique(x), np.unique(y), assume_unique=True)
        both = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(known), 4096):
            part = known[at : at + 4096]
            sides = []
            for items, of, n in ((x, of_x, len(left)), (y, of_y, len(right))):
                place = np.minimum(np.searchsorted(part, items), len(part) - 1)
                hit = part[place] == items
                dense = np.zeros((n, len(part)), np.float32)
                dense[of[hit], place[hit]] = 1
                sides.append(dense)
            both += sides[0] @ sides[1].T
        size = np.array([len(s) for s in sets], np.float64)
        ok = (100 * both >= percent * (size[left][:, None] + size[right] - both)) & (component[left][:, None] != component[right])
        i, j = np.nonzero(ok)
        a, b = left[i], right[j]
        pairs = np.sort(np.stack([component[a], component[b]], 1), 1)
        _, first = np.unique(pairs, axis=0, return_index=True)
        return pa.table({"a": pa.array(nodes[a][first], pa.int64()), "b": pa.array(nodes[b][first], pa.int64())})

    return run


def link(scratch: Scratch, met: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int, like: Callable[[Column, Column], Column], least: float) -> DataFrame | None:
    """Components (node, component) of nodes whose sets' similarity is `percent` in 100 or more, among those that share a band.

    met: rows (key, node, n), n nodes sharing the key of a band; signatures: (node, signature); sets: (node, items);
    like: the similarity that two signatures let expect, which must be `least` for a pair to be looked at.
    """

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of rows (a, b) the pairs that link; a's set, which many pairs may name, is sent once for all of them."""
        pairs = pairs.join(sets.select(F.col("node").alias("kb"), F.col("items").alias("ib")), F.col("b") == F.col("kb")).select("a", "b", "ib")
        pairs = pairs.join(sets.select(reshuffled("node").alias("ka"), F.col("items").alias("ia")), F.col("a") == F.col("ka")).select("a", "b", "ia", "ib")
        return pairs.mapInArrow(_linked(percent), "a long, b long")

    def heads(named: DataFrame, order) -> DataFrame:
        """Rows (a, b, like): each crowded band's nodes beside the one that is least in the given order, if of another component and likely alike."""
        head = named.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "component", "signature")).alias("h")).select(reshuffled("key").alias("k"), "h")
        alike = like(F.col("signature"), F.col("h.signature"))
        got = named.join(head, (F.col("key") == F.col("k")) & (F.col("component") != F.col("h.component")) & (alike >= least))
        return got.select(F.col("h.node").alias("a"), F.col("node").alias("b"), alike.alias("like"))

    def still_open(left: DataFrame, found: DataFrame | None) -> DataFrame:
        """The rows of bands whose nodes lie in several components."""
        if found is None:
            return left.withColumn("component", F.col("node"))
        named = left.join(found.select(F.col("node").alias("id"), F.col("component").alias("c")), F.col("node") == F.col("id"), "left")
        named = named.select("key", "node", "n", F.coalesce("c", "node").alias("component"))
        open_ = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        return named.join(open_.select(reshuffled("key").alias("k")), F.col("key") == F.col("k"), "left_semi")

    def signed_(named: DataFrame) -> DataFrame:
        return named.join(signatures.select(F.col("node").alias("id"), "signature"), F.col("node") == F.col("id")).select("key", "node", "n", "component", "signature")

    def across(named: DataFrame) -> DataFrame:
        """Links (a, b) among all nodes of a band that lie in several components.

        Small bands give their pairs, which are decided like the others. The nodes of a larger one are dealt to blocks,
        and blocks meet in pairs: a task counts what all sets of two blocks share and sends a link for two components.
        """
        small = named.where(F.col("n") <= SMALL)
        other = small.select(*[F.col(c).alias(f"o_{c}") for c in ("key", "node", "component", "signature")])
        near = (F.col("component") > F.col("o_component")) & (like(F.col("signature"), F.col("o_signature")) >= least)
        few = small.join(other, (F.col("key") == F.col("o_key")) & near).select(F.col("o_node").alias("a"), F.col("node").alias("b")).distinct()
        large = named.where(F.col("n") > SMALL).select("key", "node", "component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        large = large.join(sets.select(F.col("node").alias("id"), "items"), F.col("node") == F.col("id")).drop("id")
        large = large.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        large = large.select("key", F.least("own", "to").alias("low"), F.greatest("own", "to").alias("high"), "own", "node", "component", "items")
        return confirmed(few).unionByName(large.groupBy("key", "low", "high").applyInArrow(_across(percent), "a long, b long"))

    links, found, left = None, None, met
    for turn in range(NEAREST + 1):
        left = scratch.keep("left", still_open(left, found))
        if left.isEmpty():
            break
        named = signed_(left)
        if turn < NEAREST:
            # each node beside the likeliest of its bands' heads only, which settles nearly all bands
            new = confirmed(heads(named, F.xxhash64(F.lit(turn), "node")).groupBy("b").agg(F.max_by("a", F.struct("like", "a")).alias("a")).select("a", "b"))
        else:
            new = across(named)
        links = scratch.keep("links", new if links is None else links.unionByName(new))
        found = components(links)
    return found


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, kept: links join documents of which the sets' similarity is `percent` in 100 or more."""
    scratch = Scratch(docs.sparkSession)
    plain = docs.select("doc_id", "text")
    signed = scratch.keep("signed", plain.mapInArrow(_signed(size, ROWS if percent >= 85 else ROWS - 1), "doc_id long, n_shingles long, node long, bands array<long>, signature array<long>"))
    rows = checkpoint(signed.select("doc_id", "n_shingles", "node"))
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = scratch.keep("nodes", nodes)
    scratch.drop("signed")
    spread = nodes.select(F.explode("bands").alias("key"), "node")
    crowded = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.keep("met", spread.join(crowded.select(reshuffled("key").alias("k"), "n"), F.col("key") == F.col("k")).select("key", "node", "n"))
    wanted = nodes.join(met.select(F.col("node").alias("id")).distinct(), F.col("node") == F.col("id"), "left_semi").select("node", "first_doc", "signature")
    wanted = scratch.keep("wanted", wanted)
    firsts = checkpoint(nodes.select("node", "first_doc"))
    scratch.drop("nodes")
    texts = plain.join(wanted.select(F.col("first_doc").alias("doc")).hint("merge"), F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
    sets = texts.select("text").mapInArrow(_whole_sets(size), "node long, items binary").join(wanted.select(F.col("node").alias("id")), F.col("node") == F.col("id"), "left_semi")
    sets = scratch.keep("sets", sets.groupBy("node").agg(F.first("items").alias("items")))

    found = link(scratch, met, wanted, sets, percent, estimate, percent / 100 - SLACK)
    named = firsts.join(found.select(F.col("node").alias("id"), "component"), F.col("node") == F.col("id"), "left") if found is not None else firsts.withColumn("component", F.col("node"))
    named = checkpoint(named.select("node", "first_doc", F.coalesce("component", "node").alias("component")))
    scratch.close()
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id")).select(reshuffled("component").alias("c"), "component_id")
    named = named.join(least, F.col("component") == F.col("c")).select(F.col("node").alias("id"), "component_id")
    out = rows.join(named, F.col("node") == F.col("id"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
