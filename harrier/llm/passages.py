"""Substring deduplication: paragraph MinHash with bands, exact Jaccard verification, removal by components.

Paragraphs are of two kinds. One is a line of PARAGRAPH words or more, or a whole text of fewer words, from
five on. The other is a run of PARAGRAPH words that starts where the text itself says so: among any WINDOW
neighbouring five-word shingles the one of the least hash starts a run. Two texts that share
PARAGRAPH + WINDOW - 1 words in a row therefore share a run, wherever the passage lies in lines or texts.

Equal paragraphs of a kind are one node. Lines count as alike where the Jaccard likeness of their shingle
sets is PERCENT in 100 or more, which a line of fifty words is with one word changed: BANDS bands of two minima
propose such pairs (98 in 100 at the threshold, more above it), packed minima thin out what a crowded band
proposes, and whole sets decide. Linked nodes are a class; a class found in two documents or more is repeated, its
paragraphs are removed from all but the document of the smallest id, and documents that share a class are one component.

Words are runs of non-blank characters, A-Z lower-cased. Texts of fewer than five words, empty and null ones
have no paragraph. A document is its doc_id: rows that repeat an id are parts of one document. Rows without an
id are a document for each text, after all others, and have a null component_id unless they share a
passage with a document that has an id. Repeats inside one document are no repeats; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import Scratch, checkpoint, mixed_bits, parts, split, word_hashes
from harrier.llm.components import components, reshuffled
from harrier.llm.minhash import _seeds, link

#: Words of a paragraph and of a shingle, shingles of which one starts a paragraph, likeness in 100 that links lines, and words handled at once.
PARAGRAPH, SHINGLE, WINDOW, PERCENT, _SLICE = 32, 5, 20, 80, 1_000_000
_ITEMS = PARAGRAPH - SHINGLE + 1
#: Bands of two minima, minima in a mark (four bits each), and the share of equal ones from which a pair is looked at.
BANDS, MARKS, LEAST = 4, 16, 0.375
#: Documents without an id come after all others.
_LATE = 1 << 62
_XOR = (_seeds(MARKS, 5001) >> np.uint64(32)).astype(np.uint32)
_TIMES = (_seeds(MARKS, 6001) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BAND = _seeds(BANDS, 7001)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling; the last places look no further than the end."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def paragraphs(hashes: np.ndarray, bounds: np.ndarray, lines: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of all texts: each paragraph's text, place (shingle), shingle count and node (odd for a line); all shingles; and how many are runs, which come first.

    bounds and lines are the bounds of the texts and of their lines among the words.
    """
    s = hashes.copy()
    for k in range(1, SHINGLE):
        s[: max(0, len(s) - k)] = mixed_bits(s[: max(0, len(s) - k)] + np.uint64(k)) + hashes[k:]
    s = mixed_bits(s)
    count = np.diff(bounds) - SHINGLE + 1  # shingles of each text
    low = np.uint64((1 << 32) - 1)
    packed = (s & ~low) | np.arange(len(s), dtype=np.uint64)
    least = _least(packed, WINDOW)
    long_ = np.flatnonzero(count >= _ITEMS)
    # a run must end with its text: what starts a run is sought among the places where one fits, in windows that lie in them
    fits = count[long_] - _ITEMS + 1
    starts = bounds[:-1][long_]
    brief = fits < WINDOW
    mark = np.zeros(len(s) + 1, np.int32)
    np.add.at(mark, starts[~brief], 1)
    np.add.at(mark, (starts + fits - WINDOW + 1)[~brief], -1)
    at = (least[np.cumsum(mark[:-1]) > 0] & low).astype(np.int64)
    if brief.any():  # fewer places than a window: the least of them
        own = np.stack([starts[brief], starts[brief] + fits[brief]], 1).ravel()
        at = np.concatenate([at, (np.minimum.reduceat(np.append(packed, packed[-1:]), own)[::2] & low).astype(np.int64)])
    at = np.unique(at)
    runs = len(at)
    # lines of that length, and texts that are shorter than a run
    short = np.flatnonzero((count >= 1) & (count < _ITEMS))
    from_, to = bounds[:-1][short], bounds[1:][short]
    if lines is not None:
        wide = np.flatnonzero(np.diff(lines) >= PARAGRAPH)
        from_, to = np.concatenate([from_, lines[:-1][wide]]), np.concatenate([to, lines[1:][wide]])
    at, items = np.concatenate([at, from_]), np.concatenate([np.full(runs, _ITEMS), to - from_ - SHINGLE + 1])
    text = np.searchsorted(bounds, at, "right") - 1
    total = _sums(s)
    node = mixed_bits(total[at + items] - total[at] + items.astype(np.uint64))
    kind = (np.arange(len(at)) >= runs).astype(np.uint64)
    return text, at, items, (node & ~np.uint64(1)) | kind, s, runs


def _sums(s: np.ndarray) -> np.ndarray:
    """Sums of what the shingles before each place hash to; repeats and order do not enter twice the same way."""
    place = mixed_bits(s + np.uint64(7))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(place, dtype=np.uint64)])


def banded(s: np.ndarray, at: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each paragraph's bands (paragraph, band), and its mark: four bits of each minimum."""
    keys, mark = np.zeros((len(at), BANDS), np.uint64), np.zeros(len(at), np.uint64)
    if not len(at):
        return keys, mark
    x = (s >> np.uint64(32)).astype(np.uint32)
    spans = np.stack([at, at + items], 1).ravel()
    x = np.append(x, np.uint32(0))  # a span may end with the last shingle
    before = np.zeros(0, np.uint64)
    for f in range(MARKS):
        own = np.minimum.reduceat((x ^ _XOR[f]) * _TIMES[f], spans)[::2].astype(np.uint64)
        mark |= (mixed_bits(own) & np.uint64(15)) << np.uint64(4 * f)
        if f % 2 and f < 2 * BANDS:
            keys[:, f // 2] = mixed_bits((before << np.uint64(32) | own) + _BAND[f // 2])
        before = own
    return keys, mark


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of batches of about _SLICE words, with word hashes and the bounds of texts and of lines."""
    for batch in parts(batches, 2000, column):
        cut = pc.split_pattern(pc.fill_null(batch.column(column), ""), "\n")
        flat, lines = split(cut.flatten())
        rows = cut.offsets.to_numpy().astype(np.int64)
        rows = rows - rows[0]
        bounds = lines[rows]
        hashes = word_hashes(flat) if len(flat) else np.empty(0, np.uint64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _SLICE, "right")) - 1)
            yield batch.slice(at, to - at), hashes[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], lines[rows[at] : rows[to] + 1] - bounds[at]
            at = to


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct paragraph of a text; bands and mark of lines only."""
    for part, hashes, bounds, lines in _slices(batches, 1):
        if len(hashes) < SHINGLE:
            continue
        text, at, items, node, s, runs = paragraphs(hashes, bounds, lines)
        first = _first_of(text, node)
        first.sort()
        text, at, items, node, runs = text[first], at[first], items[first], node[first], int((first < runs).sum())
        keys, mark = banded(s, at[runs:], items[runs:])
        sizes = np.where(np.arange(len(at)) < runs, 0, BANDS)
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
        marks = np.concatenate([np.zeros(runs, np.int64), mark.view(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(part.column(0).to_numpy()[text]), pa.array((at - bounds[text]).astype(np.int32)), pa.array(items.astype(np.int32)), bands, pa.array(marks)], ["node", "doc", "place", "items", "bands", "mark"])


def _first_of(text: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The first place of each node in each text."""
    order = np.lexsort((np.arange(len(text)), node, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (node[order][1:] != node[order][:-1])
    return order[new]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the wanted nodes of each document."""
    for part, hashes, bounds, lines in _slices(batches, 0):
        if len(hashes) < SHINGLE:
            continue
        _, at, items, node, s, _ = paragraphs(hashes, bounds, lines)
        asked = np.unique(np.array([x for own in part.column(1).to_pylist() for x in own], np.int64))
        first = np.flatnonzero(np.isin(node.view(np.int64), asked))
        ids, place = np.unique(node[first].view(np.int64), return_index=True)
        raw = [np.unique(s[at[i] : at[i] + items[i]]).tobytes() for i in first[place]]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["node", "items"])


def _like(a: Column, b: Column) -> Column:
    """The share of equal minima in two marks."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return 1 - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))) / MARKS


def _doc() -> Column:
    """The document a row belongs to."""
    return F.coalesce("doc_id", F.lit(_LATE) + F.pmod(F.xxhash64("text"), F.lit(_LATE >> 1)))


def repeated(docs: DataFrame) -> DataFrame:
    """Rows (doc, place, items, class, first_doc): the paragraphs whose class is in two documents or more; place and items count shingles."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(_doc().alias("doc"), "text").where("text IS NOT NULL")
    every = scratch.keep("every", texts.mapInArrow(_emit, "node long, doc long, place int, items int, bands array<long>, mark long"))
    # a node's documents meet as their least and greatest only, most of it before the exchange
    nodes = every.groupBy("node").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.first("bands").alias("bands"), F.first("mark").alias("mark"))
    nodes = scratch.keep("nodes", nodes.where("lo < hi OR size(bands) > 0"))
    spread = nodes.select(F.explode("bands").alias("key"), "node")
    crowded = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(reshuffled("key").alias("k"), "n")
    met = scratch.keep("met", spread.join(crowded, F.col("key") == F.col("k")).select("key", "node", "n"))
    wanted = nodes.join(met.select(F.col("node").alias("w")).distinct(), F.col("node") == F.col("w"), "left_semi")
    wanted = scratch.keep("wanted", wanted.select("node", "lo", F.col("mark").alias("signature")))
    where = wanted.groupBy("lo").agg(F.collect_set("node").alias("nodes"))
    sets = texts.join(where, F.col("doc") == F.col("lo")).select("text", "nodes").mapInArrow(_sets, "node long, items binary")
    sets = scratch.keep("sets", sets.groupBy("node").agg(F.first("items").alias("items")))
    found = link(scratch, met, wanted.select("node", "signature"), sets, PERCENT, _like, LEAST)
    scratch.drop("met", "wanted", "sets", "left", "links", "open")
    classes = nodes.select("node", "lo", "hi")
    if found is not None:
        classes = classes.join(found.withColumnRenamed("node", "id"), F.col("node") == F.col("id"), "left").where("component IS NOT NULL OR lo < hi")
        classes = scratch.keep("classes", classes.select("node", "lo", "hi", F.coalesce("component", "node").alias("class")))
        whole = classes.groupBy("class").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("hi")).where("first_doc < hi").select(reshuffled("class").alias("c"), "first_doc")
        classes = classes.select("node", "class").join(whole, F.col("class") == F.col("c")).select(F.col("node").alias("id"), "class", "first_doc")
    else:
        classes = classes.where("lo < hi").select(F.col("node").alias("id"), F.col("node").alias("class"), F.col("lo").alias("first_doc"))
    hits = checkpoint(every.select("node", "doc", "place", "items").join(classes, F.col("node") == F.col("id")).select("doc", "place", "items", "class", "first_doc"))
    scratch.close()
    return hits


def op9_passages(docs: DataFrame) -> DataFrame:
    """A row for each document: component_id (smallest doc_id that repeated passages connect it with, itself included), links (documents that hold its passages first), n_repeated and n_removed paragraphs, removed_words, duplicate (something is removed)."""
    hits = repeated(docs)
    apart = hits.where("doc <> first_doc").select(F.col("doc").alias("a"), F.col("first_doc").alias("b")).distinct()
    found = components(apart).withColumnRenamed("node", "c_doc")
    removed = F.col("doc") != F.col("first_doc")
    # spans that overlap are one: of the places of a document, each removed paragraph adds what lies beyond the ones before it
    spans = F.sort_array(F.collect_set(F.when(removed, F.struct("place", (F.col("place") + F.col("items") + SHINGLE - 1).alias("end")))))
    per = hits.groupBy("doc").agg(F.count("*").alias("n_repeated"), F.count(F.when(removed, True)).alias("n_removed"), F.countDistinct(F.when(removed, F.col("first_doc"))).alias("links"), spans.alias("spans"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).alias("words")), lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["words"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["place"]))).alias("words")))["words"]
    per = per.select(F.col("doc").alias("p_doc"), "n_repeated", "n_removed", "links", covered.alias("removed_words"))
    out = docs.select("doc_id", _doc().alias("doc")).join(per, F.col("doc") == F.col("p_doc"), "left").join(found, F.col("doc") == F.col("c_doc"), "left")
    component = F.coalesce("component", "doc_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", F.when(component < _LATE, component).alias("component_id"), zero("links"), zero("n_repeated"), zero("n_removed"), zero("removed_words"), (F.coalesce("n_removed", F.lit(0)) > 0).alias("duplicate"))
