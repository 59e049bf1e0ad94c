"""Phrase collocations: counts of all n-grams by Rabin-Karp fingerprints, of which the frequent ones alone become text.

Prefix polynomials over the words' hashes give the fingerprint of any phrase of one to `most` words inside a piece, and of
the empty phrase before each word, whose count is the language's number of words. Sizes are counted one after the other: a phrase
can be frequent only if its parts of a word less are, which a bit table of their fingerprints says (one bit too many
costs a row, none is missing). A task counts the phrases of its texts by fingerprint, comparing the words of equal
fingerprints, and sends what it has in buckets: fingerprint, a second one by which different phrases of one fingerprint
are told apart, a document that holds the phrase, and its count, packed as bytes. Each bucket is summed by itself;
phrases of `least` occurrences or more are looked up in the document named, which must give both fingerprints
again, and only those become text. All that follows are joins of that table with itself.

A phrase cut after its first words has the score floor(1000000 * a * a / (l * r)), a, l and r being the counts of the whole
and of the parts; the cut of the lowest score counts, ties to the shortest first part. Phrases that lie in a longer one with
half of their occurrences or more are dropped.

A-Z are lower-cased; pieces end at `.,;:!?` and line ends, words at blanks and tabs. Null texts count as empty, a null language
as `und`. Repeated rows count each; ties are broken by score, count and the phrase's bytes; an empty table, or
one without frequent phrases, gives an empty result. Columns other than doc_id, lang and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.llm.common import checkpoint, mixed_bits, partitions, parts, split, word_hashes

#: Words of a phrase at most, occurrences of a frequent one, phrases reported of a language, and bits of the table of frequent parts at most (32 MB).
MOST, LEAST, TOP, MOST_BITS = 3, 10, 2000, 1 << 28
#: Bytes of text read and words counted at once, and phrases held by a task before it sends them.
_READ, _SLICE, _HELD = 3_000_000, 500_000, 1_000_000
#: Parts in which a language's phrases are ranked before the whole.
_RANKED = 64
#: Bases of the two polynomials (odd, so that powers have inverses modulo 2^64), and bytes: separators of pieces become line feeds, tabs blanks.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[list(_BREAKS)], _BYTES[list(_BLANKS)] = 10, 32
_BYTES[65:91] += 32


def _plain(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased, a line feed for each end of a piece and a blank for each tab."""
    texts = pc.fill_null(texts, "").combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.empty(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(_BYTES[raw]))


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, each word's piece, and the texts' bounds among the words."""
    cut = pc.split_pattern(_plain(texts), "\n")
    words, bounds = split(cut.flatten(), lower=False)
    rows = cut.offsets.to_numpy().astype(np.int64)
    return words, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), bounds[rows - rows[0]]


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class Prints:
    """Fingerprints of any phrases of a slice, from prefix polynomials over its words' hashes.

    lang: a hash of each word's language, which enters as the phrase's size does. Fewer bits than 64 let phrases collide (for tests).
    """

    def __init__(self, hashes: np.ndarray, lang: np.ndarray, bits: int = 64):
        n = len(hashes)
        self.lang, self.drop = lang, np.uint64(64 - bits)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, n)[:n])]) for base in _BASES]
        self.back = [_powers(pow(base, -1, 1 << 64), n) for base in _BASES]

    def _at(self, which: int, at: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[which][at + size] - self.sums[which][at]) * self.back[which][at]

    def first(self, at: np.ndarray, size: int) -> np.ndarray:
        return mixed_bits(self._at(0, at, size) ^ mixed_bits(self.lang[at] + np.uint64(size + 1))) >> self.drop

    def second(self, at: np.ndarray, size: int) -> np.ndarray:
        """32 bits by which phrases of one fingerprint are told apart."""
        return mixed_bits(self._at(1, at, size) + mixed_bits(self.lang[at] + np.uint64(size + 1))) >> np.uint64(32)


def starts(piece: np.ndarray, size: int) -> np.ndarray:
    """Where phrases of a size start."""
    n = len(piece)
    if size < 2:
        return np.arange(n)
    return np.flatnonzero(piece[: n - size + 1] == piece[size - 1 :]) if n >= size else np.empty(0, np.int64)


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, and where groups of equal rows begin in it."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(np.logical_or, [c[order][1:] != c[order][:-1] for c in columns])
    return order, np.flatnonzero(new)


def _counted(prints: Prints, ids: np.ndarray, doc: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(fingerprint, second one, document, count) of each phrase that starts at the places, whose words are compared where fingerprints are equal."""
    key, lang = prints.first(at, size), prints.lang
    order = np.argsort(key)
    key, here = key[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    again = np.flatnonzero(~new)  # each with the one before it
    one, two = here[again], here[again - 1]
    if not reduce(np.logical_and, [ids[one + k] == ids[two + k] for k in range(size)], lang[one] == lang[two]).all():  # a collision: by the words themselves
        order, first = _grouped([key, lang[here], *(ids[here + k] for k in range(size))])
        key, here = key[order], here[order]
    else:
        first = np.flatnonzero(new)
    if not len(first):
        return key, key, doc[:0], np.empty(0, np.int64)
    return key[first], prints.second(here[first], size), np.minimum.reduceat(doc[here], first), np.diff(np.append(first, len(here)))


def _summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums of counts by both fingerprints, with the least document."""
    key, check, doc, count = (np.concatenate(x) for x in zip(*held, strict=True))
    order, first = _grouped([key, check])
    if not len(first):
        return key, check, doc, count
    return key[order][first], check[order][first], np.minimum.reduceat(doc[order], first), np.add.reduceat(count[order], first)


_PACKED = "bucket int, keys binary, checks binary, docs binary, counts binary"


def _sent(buckets: int, sizes: list[int], gate, bits: int):
    """A row a bucket with the phrases of these sizes that a task has counted; buckets are by mixed fingerprints.

    gate: bits of the fingerprints of frequent phrases of a word less; what has a part that is not among them is not frequent.
    """

    def rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, check, doc, count = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (mixed_bits(key) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        full = np.flatnonzero(np.diff(ends, prepend=0))

        def cut(x: np.ndarray, kind: str) -> list[bytes]:
            x = x[order].astype(kind)
            return [x[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if a < b]

        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(cut(x, k), pa.binary()) for x, k in ((key, "<u8"), (check, "<u4"), (doc, "<u4"), (count, "<u8" if count.max(initial=0) >> 32 else "<u4")))], ["bucket", "keys", "checks", "docs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        known = None if gate is None else gate.value

        def may(key: np.ndarray) -> np.ndarray:
            place = key & np.uint64(8 * len(known) - 1)
            return known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1

        for batch in parts(batches, 2000, 2, _READ):
            words, piece, bounds = pieces(batch.column(2))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            ids = coded.indices.to_numpy()
            hashes = word_hashes(coded.dictionary)[ids]
            of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            doc, lang = batch.column(0).to_numpy()[of], word_hashes(batch.column(1))[of]
            a = 0
            while a < len(ids):  # phrases end with their piece, so a slice may begin with any
                b = len(ids) if a + _SLICE >= len(ids) else int(np.searchsorted(piece, piece[a + _SLICE]))
                b = b if b > a else int(np.searchsorted(piece, piece[a], "right"))
                prints = Prints(hashes[a:b], lang[a:b], bits)
                for size in sizes:
                    at = starts(piece[a:b], size)
                    if known is not None:
                        fine = may(prints.first(np.arange(b - a - size + 2), size - 1)) if b - a >= size - 1 else np.zeros(0, bool)
                        at = at[fine[at] & fine[at + 1]]
                    held.append(_counted(prints, ids[a:b], doc[a:b], at, size))
                    n += len(held[-1][0])
                a = b
            if n > _HELD:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    return run


def _frequent(least: int):
    def run(rows: pa.Table) -> pa.Table:
        """The phrases of a bucket that occur `least` times or more."""
        read = lambda name, kind: np.frombuffer(b"".join(x.as_buffer() for x in rows.column(name).combine_chunks()), kind)
        keys, checks, docs = read("keys", "<u8"), read("checks", "<u4"), read("docs", "<u4")
        counts = np.concatenate([np.frombuffer(c.as_buffer(), "<u4" if 2 * len(c.as_buffer()) == len(k.as_buffer()) else "<u8").astype(np.int64) for c, k in zip(rows.column("counts"), rows.column("keys"), strict=True)])
        key, check, doc, count = _summed([(keys, checks, docs, counts)])
        kept = count >= least
        return pa.table({"key": key[kept].view(np.int64), "check": check[kept].astype(np.int64), "doc": doc[kept].astype(np.int64), "f": count[kept]})

    return run


def _spelled(most: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The asked phrases (key, check, f) of each document as text."""
        for batch in parts(batches, 200, 1, _READ):
            words, piece, bounds = pieces(batch.column(1))
            hashes = word_hashes(words) if len(words) else np.empty(0, np.uint64)
            langs = word_hashes(batch.column(0))
            out: list[tuple] = []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                asked, lang = batch.column(2)[i].values, batch.column(0)[i].as_py()
                wanted: dict[int, list] = {}
                for k, c, f in zip(*(asked.field(j).to_pylist() for j in range(3)), strict=True):
                    wanted.setdefault(k % (1 << 64), []).append((c, f))
                keys = np.array(sorted(wanted), np.uint64)
                prints, spell = Prints(hashes[a:b], np.full(b - a, langs[i]), bits), words[a:b]
                for size in range(most + 1):
                    at = starts(piece[a:b], size)
                    own = prints.first(at, size)
                    hit = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
                    at, own = at[hit], own[hit]
                    second = prints.second(at, size)
                    _, first = np.unique(np.stack([own, second]), axis=1, return_index=True) if bits < 64 else np.unique(own, return_index=True)
                    for k in first.tolist():
                        for c, f in wanted[int(own[k])]:
                            if c == second[k]:
                                out.append((lang, size, " ".join(spell[int(at[k]) : int(at[k]) + size].to_pylist()), f))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "size", "phrase", "f"])

    return run


def _gate(found: DataFrame):
    """A bit for each frequent phrase, in a table of at most MOST_BITS bits whatever the corpus: more phrases only let more through."""
    n = found.count()
    bits = min(MOST_BITS, 1 << max(15, (16 * n - 1).bit_length()))
    place = F.pmod("key", F.lit(bits))
    rows = found.groupBy(F.expr(f"pmod(key, {bits}L) div 32768").alias("at")).agg(F.bitmap_construct_agg(place % 32768).alias("own")).collect()  # MOST_BITS in all
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[4096 * r["at"] : 4096 * (r["at"] + 1)] = np.frombuffer(r["own"], np.uint8)
    return found.sparkSession.sparkContext.broadcast(out)


def _buckets(spark: SparkSession) -> int:
    """Some for each partition, so that a bucket stays small whatever the input."""
    return max(64, 4 * partitions(spark))


def frequent_phrases(docs: DataFrame, most: int = MOST, least: int = LEAST, bits: int = 64) -> DataFrame:
    """Rows (lang, size, phrase, f): all phrases of up to `most` words that occur `least` times in a language or more; size 0 is the empty phrase before each word."""
    texts = docs.select(F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1 << 32)).alias("doc"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    levels, gate = [], None
    for size in range(1, most + 1):
        sent = texts.mapInArrow(_sent(_buckets(docs.sparkSession), [0, 1] if size == 1 else [size], gate, bits), _PACKED)
        levels.append(checkpoint(sent.groupBy("bucket").applyInArrow(_frequent(least), "key long, check long, doc long, f long")))
        if gate is not None:
            gate.unpersist()
        gate = _gate(levels[-1])
    asked = reduce(DataFrame.unionByName, levels).groupBy(F.col("doc").alias("at")).agg(F.collect_list(F.struct("key", "check", "f")).alias("asked"))
    named = texts.join(asked, F.col("doc") == F.col("at")).select("lang", "text", "asked").mapInArrow(_spelled(most, bits), "lang string, size int, phrase string, f long")
    # rows alike in id, language and text are alike in what they are asked
    return checkpoint(named.groupBy("lang", "size", "phrase").agg(F.max("f").alias("f")))


def scored(phrases: DataFrame) -> DataFrame:
    """Rows (lang, size, phrase, a, l, r, score) of all phrases of two words or more by their lowest-scoring cut."""
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = phrases.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "size", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = phrases.where("size > 0")
    for side, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(part.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("f").alias(count)), (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).drop("of", "part")
    score = F.expr("CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    rows = scored(phrases)
    # what lies in each longer phrase: all shorter stretches of two words or more
    longer = phrases.where("size > 2").select("lang", "f", F.split("phrase", " ").alias("words"), F.explode(F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> struct(i, n))))")).alias("at"))
    inner = longer.select("lang", F.array_join(F.slice("words", F.col("at.i"), F.col("at.n")), " ").alias("inner"), "f")
    inner = inner.groupBy(F.col("lang").alias("of"), "inner").agg(F.max("f").alias("held"))
    rows = rows.join(inner, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inner")), "left").where("held IS NULL OR 100 * held < 50 * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most rows: its best are found in parts first
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_RANKED))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = phrases.where("size = 0").select(F.col("lang").alias("n_lang"), F.col("f").alias("n"))
    return rows.join(n, F.col("lang") == F.col("n_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(docs: DataFrame) -> DataFrame:
    return collocations(frequent_phrases(docs))
