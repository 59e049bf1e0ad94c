"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key's decimal text, mod `modulus`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def _shared(spark: SparkSession) -> str:
    """The shared folder that the session names; only a session without one (tests, a laptop) gets one below its warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; Spark deletes the files when nothing refers to them any more."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to the shared folder while an operator runs. A table that has been replaced is deleted at once.

    What the operator's own result still reads must be given to `checkpoint` instead.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{_shared(spark)}/{uuid.uuid4().hex}"
        self.at: dict[str, str] = {}
        self.made = 0

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table and read it again; an older one of that name goes."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        self.drop(name)
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.at.pop(name, None):
                self._delete(path)

    def settle(self) -> None:
        """Have the driver collect its garbage: Spark then deletes the shuffle files of tables that are done with, which else stay until it happens to."""
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        self.at.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def content_order(df: DataFrame, *but: str) -> Column:
    """What rows alike in the columns `but` are told apart by, so that a choice among them is the same in every run."""
    return F.to_json(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in df.columns if c not in but]))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@cache
def _tables() -> dict:
    return {}


def per_worker(name: str, key, make: Callable):
    """What `make` gives, kept in this Python worker until something else is asked for: one model at a time."""
    kept = _tables().get(name)
    if kept is None or kept[0] != key:
        _tables().clear()
        kept = _tables()[name] = (key, make())
    return kept[1]


def split(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased unless told otherwise, and each text's bounds among them."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    empty = np.asarray(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), bool)
    if empty.any():  # at a text's edges
        before = np.concatenate([[0], np.cumsum(~empty)])
        flat, bounds = flat.filter(pa.array(~empty)), before[bounds - bounds[0]]
    return flat, bounds - bounds[0]


def parts(batches: Iterable[pa.RecordBatch], rows: int = 2500, column: int | None = None, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what is made from a part stays small.

    With `column`, the texts of a part have `most` bytes at most, or it is a single row.
    """
    for batch in batches:
        at = 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)) if column is not None and batch.num_rows else None
        while at < batch.num_rows:
            to = min(batch.num_rows, at + rows)
            if ends is not None:
                to = min(to, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))))
            yield batch.slice(at, to - at)
            at = to


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    import pandas as pd

    coded = words.dictionary_encode()
    known = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)
    return known[coded.indices.to_numpy()]


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` words; of the whole sequence where it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = hashes[: n - size + 1].copy()
    for k in range(1, size):
        out = mixed_bits(out + np.uint64(k)) + hashes[k : n - size + 1 + k]
    return mixed_bits(out)
