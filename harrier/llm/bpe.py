"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A text is cut into the matches of the tokenizer's pattern. The distinct matches of a batch that
are no token themselves become token-position rows, each with its successor; a recursive query joins these
with the merge table and contracts the leftmost pair of the lowest rank in each match, until no
pair is left. A match of over SHORT bytes goes through a second query that keeps the last state only and
contracts in one step all places of that pair, up to the first that makes a pair of lower rank, which is
what one at a time, leftmost first, comes to. The bytes of each text's ids are looked up in the token table, one after
the other.

Nulls count as empty texts, which have no tokens. Rows never meet, so repeated rows and ties need
no rule; an empty table gives an empty result. Columns other than the key and the text are only
carried where `keep` names them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import parts, per_worker

#: Matches sent through one recursive query and the squares of their sizes (which bound its state), matches after which a Python worker forgets those that it has not met since the last time, and bytes of a short match.
QUERY_PIECES, QUERY_SQUARES, CACHED_PIECES, SHORT = 40_000, 6_000_000, 300_000, 64

_SPACE = r"\t-\r\x20\x85\xa0  -     　"

#: Position and next position share a number with the rank, 22 bits each: far more than SHORT.
_MERGE = """
WITH RECURSIVE t(step, w, p, id, next_p, next_id) AS (
  SELECT 0, w, p, id, next_p, next_id FROM base
  UNION ALL
  (WITH least AS (
     SELECT w, min((m.id::BIGINT << 44) | (p::BIGINT << 22) | next_p) AS best
     FROM t JOIN merges m ON m.l = t.id AND m.r = t.next_id GROUP BY w
   ), pair AS (
     SELECT w, (best >> 44)::INTEGER AS made, ((best >> 22) & 4194303)::INTEGER AS first, p AS second, t.next_p AS after, t.next_id AS after_id
     FROM least JOIN t USING (w) WHERE p = (best & 4194303)
   )
   SELECT step + 1, w, p, CASE WHEN p = first THEN made ELSE id END, CASE WHEN p = first THEN after ELSE next_p END,
     CASE WHEN p = first THEN after_id WHEN next_p = first THEN made ELSE next_id END
   FROM t JOIN pair USING (w) WHERE p <> second)
)
SELECT w, id FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY w, p
"""

#: t has the rows that the last step changed, recurring.t the last state of all; -1 marks a place that has gone.
#: run: neighbouring places of one pair overlap, and every second one is taken. lower: merges of lower rank than a part of theirs.
_MERGE_LONG = """
WITH RECURSIVE t(w, p, id) USING KEY (w, p) AS (
  SELECT w, p, id FROM base
  UNION ALL
  (WITH live AS (
     SELECT w, p, id, lag(id) OVER f AS before, lead(id) OVER f AS next_id, lead(p) OVER f AS next_p, lead(id, 2) OVER f AS after, row_number() OVER f AS k
     FROM recurring.t WHERE id >= 0 AND w IN (SELECT w FROM t) WINDOW f AS (PARTITION BY w ORDER BY p)
   ), pairs AS (
     SELECT w, p, next_p, before, after, k, m.id AS made FROM live JOIN merges m ON m.l = live.id AND m.r = live.next_id
   ), hits AS (
     SELECT *, k - row_number() OVER (PARTITION BY w ORDER BY k) AS run FROM pairs JOIN (SELECT w, min(made) AS made FROM pairs GROUP BY w) USING (w, made)
   ), apart AS (
     SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY w, run ORDER BY k) % 2 = 1
   ), placed AS (
     SELECT w, k, p, next_p, made, after, CASE WHEN lag(k) OVER (PARTITION BY w ORDER BY k) = k - 2 THEN made ELSE before END AS before FROM apart
   ), cut AS (
     SELECT w, min(k) AS k FROM (
       SELECT w, k FROM placed JOIN lower x ON x.l = made AND x.r = after WHERE x.id < made
       UNION ALL
       SELECT w, k FROM placed JOIN lower x ON x.l = before AND x.r = made WHERE x.id < made) GROUP BY w
   ), chosen AS (
     SELECT placed.w, p, next_p, made FROM placed LEFT JOIN cut ON placed.w = cut.w WHERE placed.k <= coalesce(cut.k, placed.k)
   )
   SELECT w, p, made FROM chosen UNION ALL SELECT w, next_p, -1 FROM chosen)
)
SELECT w, id FROM t WHERE id >= 0 ORDER BY w, p
"""

def load_ranks(path: str) -> bytes:
    """The rank file's content; read once, where the plan is made."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """The merge and token tables of one rank file in an in-memory DuckDB of one thread."""

    def __init__(self, content: bytes, pattern: str):
        import duckdb
        import regex

        # Rust's \s is the White_Space property; name its members, as other engines differ.
        plain = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.find = regex.compile(plain).findall
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, out = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(rank)
        # executors share no folder: what a query holds is bounded, and nothing is spilled
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        as_int = lambda x: pa.array(x, pa.int32())
        self._table("merges", pa.table({"l": as_int(left), "r": as_int(right), "id": as_int(out)}))
        self.con.execute("CREATE TABLE lower AS SELECT * FROM merges WHERE id < greatest(l, r)")
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        tokens = [b""] * len(self.sizes)
        for token, rank in self.ranks.items():
            tokens[rank], self.sizes[rank] = token, len(token)
        self.flat, self.firsts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def merge(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """Each piece's ids by the recursive queries, which one the longest piece decides."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        first = np.cumsum(sizes) - sizes
        place, ids = (np.arange(len(flat)) - np.repeat(first, sizes)).astype(np.int32), self.byte_ids[flat]
        after = np.append(ids[1:], np.int32(-1))
        after[np.cumsum(sizes) - 1] = -1  # no merge has it
        base = pa.table({"w": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes), "p": place, "id": ids, "next_p": place + np.int32(1), "next_id": after})
        self.con.register("base", base)
        out = self.con.execute(_MERGE if sizes.max(initial=0) <= SHORT else _MERGE_LONG).fetchnumpy()
        self.con.unregister("base")
        ids, ends = np.asarray(out["id"], "<u4"), np.cumsum(np.bincount(out["w"], minlength=len(pieces)))
        return [ids[a:b] for a, b in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), strict=True)]

    def _unknown(self, chunks: Iterable[str]) -> list[str]:
        known, older, out = self.known, self.older, []
        for x in chunks:
            if x not in known:
                own = older.get(x)
                if own is None:
                    out.append(x)
                else:
                    known[x] = own
        return out

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of all these chunks of text."""
        known, ranks, cut = self.known, self.ranks, [self.find(x) for x in chunks]
        ask, raws = [], []
        for x in self._unknown({x for own in cut for x in own}):
            raw = x.encode()
            rank = ranks.get(raw)
            if rank is None:
                ask.append(x), raws.append(raw)
            else:
                known[x] = rank.to_bytes(4, "little")
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        order = np.argsort(sizes, kind="stable").tolist()  # matches of like length end after about as many steps
        sizes, i = sizes.tolist(), 0
        while i < len(order):
            least, to = sizes[order[i]], i + 1
            squares = least**2
            while to < len(order) and to - i < QUERY_PIECES and (squares := squares + sizes[order[to]] ** 2) <= QUERY_SQUARES and (sizes[order[to]] > SHORT) == (least > SHORT):
                to += 1
            for k, own in zip(order[i:to], self.merge([raws[k] for k in order[i:to]]), strict=True):
                known[ask[k]] = own.tobytes()
            i = to
        for x, own in zip(chunks, cut, strict=True):
            if len(own) != 1:
                known[x] = b"".join([known[y] for y in own])

    def encode_all(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk of text as little-endian 32-bit numbers."""
        if len(self.known) > CACHED_PIECES:
            self.known, self.older = {}, self.known
        for i in range(0, len(chunks), CACHED_PIECES):
            self.learn(self._unknown(chunks[i : i + CACHED_PIECES]))
        return [self.known[x] for x in chunks]

    def decode_all(self, sequences: list[memoryview]) -> list[memoryview]:
        """The bytes of each id sequence, by the token table."""
        ids = np.frombuffer(b"".join(sequences), "<u4")
        bounds = np.cumsum([0, *(len(x) // 4 for x in sequences)])
        return _taken(self.flat, self.firsts, self.sizes, ids, bounds)


#: Two white-space characters of which the last is a blank: a text without such a place may be cut before every blank.
_IRREGULAR = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "


def _chunked(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks whose matches don't depend on their surroundings, and each text's chunks: codes and the bounds of each text."""
    odd = np.asarray(pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False), bool)
    parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    coded = parts.flatten().dictionary_encode()
    bounds, codes = parts.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    words = coded.dictionary.to_pylist()
    chunks = [" " + x for x in words]
    first = codes[bounds[:-1]]  # a text's first part has no blank before it
    for i in np.flatnonzero(odd):
        first[i] = len(words)
        words.append(texts[int(i)].as_py())
    heads, inverse = np.unique(first, return_inverse=True)
    codes[bounds[:-1]] = len(chunks) + inverse
    chunks += [words[h] for h in heads]
    used, codes = np.unique(codes, return_inverse=True)
    return [chunks[u] for u in used], codes, bounds


def _taken(flat: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    """Of stretches of bytes (first, size) those that each text's codes name, one after the other."""
    own = sizes[codes]
    ends = np.cumsum(own)
    at = np.concatenate([[0], ends])[bounds]
    out = flat[np.repeat(firsts[codes] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
    return [memoryview(out[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _joined(values: list[bytes], codes: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    """Each text's values, one after the other."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return _taken(np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes, sizes, codes, bounds)


def _round_trip(content: bytes, pattern: str, texts_of: int, digests: bool):
    key = (hashlib.sha256(content).hexdigest(), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or per_worker("bpe", key, lambda: Codec(content, pattern))
            for part in parts([batch], texts_of, batch.num_columns - 1):
                texts = pc.fill_null(part.column(part.num_columns - 1), "")
                chunks, codes, bounds = _chunked(texts)
                ids = _joined(codec.encode_all(chunks), codes, bounds)
                back = codec.decode_all(ids)
                n = [len(x) // 4 for x in ids]
                first, second = ([hashlib.sha256(x).hexdigest() if digests else bytes(x) for x in y] for y in (ids, back))
                kind = pa.string() if digests else pa.binary()
                names = [*part.schema.names[:-1], "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64()), pa.array(first, kind), pa.array(second, kind)], names)

    return run


def round_trip(docs: DataFrame, path: str, pattern: str, keep: Sequence[str] = ("doc_id",), digests: bool = False, texts_of: int = 1500) -> DataFrame:
    """Encode each text by the rank file at `path`, then decode the ids.

    Gives the `keep` columns, n_tokens, and either `ids` (binary, little-endian unsigned 32-bit)
    with `decoded` (the decoded bytes), or the SHA-256 of both as lower-case hex.
    """
    rows = docs.select(*keep, F.col("text").alias("__text"))
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids binary, decoded binary"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_round_trip(load_ranks(path), pattern, texts_of, digests), f"{schema}, {made}")


def op2_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
