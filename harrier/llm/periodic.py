"""Periodic runs of words by internal pattern matching: dyadic blocks, a suffix array, and a wavelet matrix over it.

A run is a maximal stretch of words with smallest period q whose length is `least` or more and `times` (4) periods or
more. Let b be the largest power of two up to (3q + 1) / 2. A run then holds a block of b words that starts at a multiple
of b, and the same words again q places on. So for each b the blocks ask where they occur next:

* the suffixes of each text are sorted by their first 1, 2, 4, ... words; a block's occurrences are a range of the array;
* a wavelet matrix over the array's places gives the least place of a range from some place on (range successor);
* occurrences in the window up to b places on lie at multiples of the first one, and only that can be the smallest period
  of a run; those in the window beyond, up to 4b/3, are an arithmetic progression: one or two are candidates themselves,
  of three and more (then the block has their distance p for a period) the only candidate is the distance
  between the ends of the two stretches of period p that hold the block and its later occurrence;
* prefix polynomials of the words extend each candidate to both sides by bisection. What is found is then compared word by word.

A block whose first word does not come again within 4b/3 places asks nothing, so that plain texts ask little.

Words are runs of non-blank characters, as written. Null and empty texts have no words, no runs and an empty collapsed
text. Texts never meet, so repeated rows and ties of ids need no rule; an empty table gives an empty result. A text is
handled as a whole, in memory of some 40 bytes and twice log2(n) bits a word. Other columns than `keep` and the text are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import mixed_bits, parts, split

#: Least length of a run, words handled at once (a longer text is handled alone), and bytes of text read at once.
LEAST, _SLICE, _BYTES = 6, 400_000, 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Wavelet:
    """Places in the order of an array, as a bit vector a binary digit: counts and order statistics of any range in a step a digit."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for digit in range(max(1, int(values.max(initial=0)).bit_length()) - 1, -1, -1):
            bits = (values >> digit) & 1
            padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
            padded[: len(bits)] = bits
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((digit, packed, before, int(len(bits) - bits.sum())))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def _ones(self, packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least value of each range [lo, hi) that is `least` or more; -1 where there is none."""
        a, b, below = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        beyond = least >= 1 << len(self.levels)
        for digit, packed, before, zeros in self.levels:
            ones_a, ones_b = self._ones(packed, before, a), self._ones(packed, before, b)
            up = (least >> digit) & 1 == 1
            below += np.where(up, (b - ones_b) - (a - ones_a), 0)
            a, b = np.where(up, zeros + ones_a, a - ones_a), np.where(up, zeros + ones_b, b - ones_b)
        none = beyond | (below >= hi - lo)
        a, b, rank, found = lo.copy(), hi.copy(), np.where(none, 0, below), np.zeros(len(lo), np.int64)
        for digit, packed, before, zeros in self.levels:
            ones_a, ones_b = self._ones(packed, before, a), self._ones(packed, before, b)
            smaller = (b - ones_b) - (a - ones_a)
            up = rank >= smaller
            rank = np.where(up, rank - smaller, rank)
            found |= up.astype(np.int64) << digit
            a, b = np.where(up, zeros + ones_a, a - ones_a), np.where(up, zeros + ones_b, b - ones_b)
        return np.where(none, -1, found)


def blocks(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of all texts, a text after the other, as deep as blocks reach; and the blocks that ask: rows (place, size, lo, hi).

    ids: the words as numbers; bounds: those of the texts among them.
    """
    n = len(ids)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    wide = n.bit_length()
    low = (1 << wide) - 1
    key = text * (int(ids.max()) + 1) + ids
    packed = np.sort((key << wide) | np.arange(n)) if int(key.max()).bit_length() + wide < 63 else None
    array = packed & low if packed is not None else np.lexsort((np.arange(n), key))
    own = key[array]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    # how far on the same word comes again
    again = np.full(n, n, np.int64)
    again[array[:-1][~new[1:]]] = (array[1:] - array[:-1])[~new[1:]]
    inside = np.arange(n) - bounds[text]
    rest = bounds[text + 1] - np.arange(n)
    longest = int(np.diff(bounds).max())
    rank = np.full(n + 1, -1, np.int64)
    asked, size = [], 1
    at = np.arange(n)  # places of the array whose suffixes are not told apart yet
    while True:
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        lo = at[first]
        rank[array[at]] = np.repeat(lo, count)
        many = np.repeat(count > 1, count)
        if size > 1:
            place = array[at[many]]
            ask = (inside[place] % size == 0) & (rest[place] >= size) & (3 * again[place] < 4 * size)
            start = np.repeat(lo, count)[many][ask]
            asked.append(np.stack([place[ask], np.full(int(ask.sum()), size), start, start + np.repeat(count, count)[many][ask]]))
        at = at[many]
        if not len(at) or 8 * size > 3 * longest:
            break
        place = array[at]
        second = rank[np.minimum(place + size, n)] + 1
        if 3 * wide + 1 < 63:
            order = np.sort((rank[place] << (2 * wide + 1)) | (second << wide) | place)
            array[at], told = order & low, order >> wide
        else:
            order = np.lexsort((second, rank[place]))
            array[at], told = place[order], None
            own_rank, own_second = rank[place][order], second[order]
        new = np.concatenate([[True], told[1:] != told[:-1] if told is not None else (own_rank[1:] != own_rank[:-1]) | (own_second[1:] != own_second[:-1])])
        size *= 2
    return array, np.concatenate(asked, 1) if asked else np.zeros((4, 0), np.int64)


class _Equal:
    """Prefix polynomials modulo 2^64: whether two stretches of words are equal, in one step (but for chance)."""

    def __init__(self, ids: np.ndarray):
        with np.errstate(over="ignore"):
            self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(ids), _BASE))])
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed_bits(ids.astype(np.uint64) + np.uint64(1)) * self.power[:-1])])

    def __call__(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[i + size] - self.sums[i]) * self.power[j - i] == self.sums[j + size] - self.sums[j]

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i and from j > i on are equal, `most` at most."""
        lo, hi = np.zeros(len(i), np.int64), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self(i, j, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def back(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before i and before j > i are equal, `most` at most."""
        lo, hi = np.zeros(len(i), np.int64), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self(i - mid, j - mid, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo


def candidates(tree: Wavelet, equal: _Equal, asked: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that blocks propose; end: where each block's text ends."""
    place, size, lo, hi = asked
    near = tree.successor(lo, hi, place + 1) - place
    ok = (near > 0) & (near <= size)
    out = [(place[ok], near[ok])]
    wide = size >= 8  # smaller blocks have no period beyond their size to find
    place, size, lo, hi, end = place[wide], size[wide], lo[wide], hi[wide], end[wide]
    top = place + (4 * size - 2) // 3  # 3q < 4b - 1
    one = tree.successor(lo, hi, place + size + 1)
    ok = (one >= 0) & (one <= top)
    place, lo, hi, end, top, one = (x[ok] for x in (place, lo, hi, end, top, one))
    two = tree.successor(lo, hi, one + 1)
    pair = (two >= 0) & (two <= top)
    three = np.where(pair, tree.successor(lo, hi, np.where(pair, two, 0) + 1), -1)
    many = (three >= 0) & (three <= top)
    out += [(place[~many], (one - place)[~many]), (place[pair & ~many], (two - place)[pair & ~many])]
    place, end, one, step = place[many], end[many], one[many], (two - one)[many]
    ends = [at + step + equal.ahead(at, at + step, end - at - step) for at in (place, one)]
    out.append((place, ends[1] - ends[0]))
    place, period = (np.concatenate(x) for x in zip(*out, strict=True))
    return place[period > 0], period[period > 0]


def runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of all texts: rows (text, start, length, period), in order of text, start and period; starts count from the text's first word."""
    none = np.zeros((4, 0), np.int64)
    if len(ids) < least:
        return none
    array, asked = blocks(ids, bounds)
    text = np.searchsorted(bounds, asked[0], "right") - 1
    asking = np.unique(text)
    if not len(asking):
        return none
    # only texts whose blocks ask: a text's suffixes lie where its words do
    sizes = np.diff(bounds)[asking]
    first = np.cumsum(sizes) - sizes
    take = np.repeat(bounds[:-1][asking] - first, sizes) + np.arange(sizes.sum())
    shift = np.repeat(bounds[:-1][asking] - first, sizes)
    own = np.searchsorted(asking, text)
    move = bounds[:-1][text] - first[own]
    asked = asked - np.stack([move, np.zeros_like(move), move, move])
    ids, array = ids[take], array[take] - shift
    equal = _Equal(ids)
    end = (first + sizes)[own]
    place, period = candidates(Wavelet(array), equal, asked, end)
    own = np.searchsorted(first, place, "right") - 1
    end = (first + sizes)[own]
    fits = place + period < end
    place, period, own, end = place[fits], period[fits], own[fits], end[fits]
    right = place + period + equal.ahead(place, place + period, end - place - period)
    left = place - equal.back(place, place + period, place - first[own])
    long_ = right - left >= np.maximum(least, 4 * period)
    found = np.unique(np.stack([left, right, period])[:, long_], axis=1)
    found = _compared(ids, found, first, sizes, least)
    # a stretch of several periods has the smallest for its period
    found = found[:, np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(0)])] if found.shape[1] else found
    own = np.searchsorted(first, found[0], "right") - 1
    out = np.stack([asking[own], found[0] - first[own], found[1] - found[0], found[2]])
    return out[:, np.lexsort((out[3], out[1], out[0]))]


def _compared(ids: np.ndarray, found: np.ndarray, first: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """The stretches (left, right, period) word by word; one that polynomials took for longer than it is gives its parts."""
    wrong, at = [], 0
    shifts = found[1] - found[0] - found[2]
    while at < found.shape[1]:
        to = max(at + 1, int(np.searchsorted(np.cumsum(shifts[at:]), 4_000_000, "right")) + at)
        size = shifts[at:to]
        i = np.repeat(found[0, at:to] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        same = ids[i] == ids[i + np.repeat(found[2, at:to], size)]
        if not same.all():
            wrong += np.unique(np.repeat(np.arange(at, to), size)[~same]).tolist()
        at = to
    if not wrong:
        return found
    more = []
    for left, right, q in found[:, wrong].T.tolist():
        same = np.concatenate([[False], ids[left : right - q] == ids[left + q : right], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        more += [(left + a, left + b + q, q) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a + q >= max(least, 4 * q)]
    kept = np.delete(found, wrong, axis=1)
    return np.unique(np.concatenate([kept, np.array(more, np.int64).reshape(-1, 3).T], 1), axis=1)


def _found(at_text: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4000, at_text, _BYTES):
            words, bounds = split(batch.column(at_text), lower=False)
            coded = words.dictionary_encode()
            ids = coded.indices.to_numpy().astype(np.int64)
            got, at = [], 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _SLICE, "right")) - 1)
                one = runs(ids[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], least)
                got.append(one + np.array([[at], [0], [0], [0]]))
                at = to
            text, start, length, period = np.concatenate(got, 1) if got else np.zeros((4, 0), np.int64)
            # a word goes if a run holds it after that run's first period
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, bounds[text] + start + period, 1)
            np.add.at(cover, bounds[text] + start + length, -1)
            stays = np.cumsum(cover[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stays)])[bounds].astype(np.int32)
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), words if stays.all() else words.filter(pa.array(stays))), " ")
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(counts), spans), collapsed], [*batch.schema.names[:-1], "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """The `keep` columns, the runs of each text as structs (start, length, period) by start and period, and the text with each run cut to its first period."""
    rows = docs.select(*keep, F.col("text").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_found(len(keep), least), f"{schema}runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeated_text() -> Column:
    """The text of `documents` as op12 takes it: where crc32(doc_id) ends in 0, the words from some place on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i))))).otherwise(F.lit(""))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when((h % 10 == 0) & F.col("text").isNotNull(), F.transform(F.array(words), again)[0]).otherwise(F.col("text"))


def op12_periodic(docs: DataFrame) -> DataFrame:
    """A row for each document: its runs' count, the run of the greatest exponent, and digests of all runs and of the collapsed text. A null doc_id changes no word."""
    rows = periodic_runs(docs.select("doc_id", repeated_text().alias("text")))
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  runs come by start and period, so the first of equals stays
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda had, x: F.when(more(x, had), x).otherwise(had))
    rows = rows.withColumn("best", best)
    lines = F.concat_ws("", F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period AS exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
