"""Files that grow: a data source for streams whose offsets are places in files.

Each micro-batch holds the whole lines appended since the last one. Offsets name files by what they are (device, inode and
their first bytes), so that a checkpoint says after any restart what has been read, and a renamed file is known again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from glob import escape, glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from harrier.sources.lines import MAX_BYTES, usable

HEAD, BLOCK, ROWS = 64, 65_536, 8192
#: What a rotated file is called: its old name and a number or a date.
_ROTATED = re.compile(r"[.-]\d[\d-]*$")


def _last_line_end(f, size: int) -> int:
    """Where the last whole line of a file's first `size` bytes ends."""
    while size:
        start = max(0, size - BLOCK)
        f.seek(start)
        at = f.read(size - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        size = start
    return 0


def _place(path: str) -> dict | None:
    """What a file is and how far its whole lines reach; null if it has gone."""
    try:
        with open(path, "rb") as f:
            was = os.fstat(f.fileno())
            return {"id": f"{was.st_dev}:{was.st_ino}", "head": f.read(min(HEAD, was.st_size)).decode("latin-1"), "end": _last_line_end(f, was.st_size)}
    except FileNotFoundError:
        return None


def _same(old: dict | None, new: dict | None) -> bool:
    """Whether a file is the one it was, grown or not."""
    return bool(old and new) and old["id"] == new["id"] and new["head"].startswith(old["head"]) and new["end"] >= old["end"]


def _rotated(path: str) -> list[str]:
    return sorted(p for p in glob(escape(path) + "[.-]*") if _ROTATED.fullmatch(p[len(path) :]))


@dataclass
class Slice(InputPartition):
    """The lines that begin in [start, end) of a file; `first` is where the part of it that is read begins."""

    path: str
    id: str
    first: int
    start: int
    end: int


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.from_start = options["path"], options.get("from_start", "true") == "true"
        self.slice = int(options.get("slice_bytes", 64 << 20))
        self.strict = options.get("fail_on_loss", "true") == "true"

    def initialOffset(self) -> dict:
        # another offset than any that is found later, so that even a first batch of nothing is logged
        return {} if self.from_start else {"": "ends"}

    def latestOffset(self) -> dict:
        found = {}
        for path in sorted(glob(self.path)):
            # a name that the pattern also catches once it is rotated is the old name's business
            if os.path.isdir(path) or ((m := _ROTATED.search(path)) and os.path.exists(path[: m.start()])):
                continue
            place = _place(path)
            old = {p["id"]: p for p in map(_place, _rotated(path)) if p}
            found[path] = {"now": place or {}, "old": old}
        return found

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        """What was appended, cut into slices, so that a file that has grown much is many tasks."""
        if "" in start:
            return []
        made = []
        for path, at in end.items():
            before = start.get(path, {"now": {}, "old": {}})
            was = before["now"]
            if at["now"]:
                known = was if _same(was, at["now"]) else before["old"].get(at["now"]["id"])
                made += self._cut(path, at["now"], known["end"] if _same(known, at["now"]) else 0)
            for place in at["old"].values():
                known = was if was and was["id"] == place["id"] else before["old"].get(place["id"])
                if _same(known, place):
                    made += self._cut(path, place, known["end"])
        return made

    def _cut(self, path: str, place: dict, first: int) -> list[Slice]:
        if first >= place["end"]:
            return []
        for p in [path, *_rotated(path)]:
            now = _place(p)
            if _same(place, now):
                return [Slice(p, place["id"], first, a, min(a + self.slice, place["end"])) for a in range(first, place["end"], self.slice)]
        if self.strict:
            raise FileNotFoundError(f"bytes {first} to {place['end']} of {path} are gone")
        return []

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            was = os.fstat(f.fileno())
            if f"{was.st_dev}:{was.st_ino}" != part.id or was.st_size < part.end:
                # renamed or cut since the batch was planned; the batch is planned anew from the same offsets
                raise FileNotFoundError(f"{part.path} is not the file it was")
            at = part.start
            if at > part.first:  # the line that holds the byte before belongs to the slice before
                f.seek(at - 1)
                at += _skip(f) - 1
            else:
                f.seek(at)
            values, places = [], []
            while at < part.end:
                line, begin = f.readline(MAX_BYTES + 2), at
                at += len(line)
                if not line.endswith(b"\n"):
                    at += _skip(f)
                    continue
                values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                places.append(begin)
                if len(values) >= ROWS:
                    yield _batch(values, part, places)
                    values, places = [], []
            if values:
                yield _batch(values, part, places)


def _batch(values: list[str], part: Slice, places: list[int]) -> pa.RecordBatch:
    n = len(values)
    return pa.record_batch([pa.array(values, pa.string()), pa.array([part.path] * n, pa.string()), pa.array([part.id] * n, pa.string()), pa.array(places, pa.int64())], names=["value", "file", "file_id", "place"])


def _skip(f) -> int:
    """Reads on to the next line; gives how many bytes that was."""
    n = 0
    while piece := f.readline(BLOCK):
        n += len(piece)
        if piece.endswith(b"\n"):
            break
    return n


class FollowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "followed_lines"

    def schema(self) -> str:
        return "value string, file string, file_id string, place long"

    def streamReader(self, schema) -> FollowReader:
        return FollowReader(self.options)


def follow_lines(spark: SparkSession, path: str, from_start: bool = True, slice_bytes: int = 64 << 20, fail_on_loss: bool = True) -> DataFrame:
    """A stream of the lines appended to files, each read once: value, file, file_id, and `place`, the byte its line begins at.

    path: a file, or a pattern; it must be seen by the driver and all executors, and files may come later. A line counts once
    its end is written. Blank lines and those over MAX_BYTES are dropped; bytes that are no UTF-8 are replaced.

    Rotation: a file that was renamed to its name and a number or date is read to its end under the new name, and the new
    file from its start. A file that has become shorter, or begins otherwise, is read from its start. Files that were
    rotated before the first batch are not read. What is written and cut off again between two batches is lost; of what a
    batch was to hold and cannot be found any more an error tells, or, without fail_on_loss, nothing.

    Without from_start a stream begins where files end at its first batch, which is empty; files that come later are read whole.
    """
    spark.dataSource.register(FollowSource)
    options = {"path": path, "from_start": str(from_start).lower(), "slice_bytes": str(slice_bytes), "fail_on_loss": str(fail_on_loss).lower()}
    return usable(spark.readStream.format("followed_lines").options(**options).load())
