"""Approximate nearest neighbours by a navigable small-world graph whose nodes are cells of rows.

Distinct vectors are dealt to cells, each to the cell whose head is nearest. The heads are means, fitted on SAMPLE vectors at
most; over them a small-world graph is built. A query walks the graph with a beam as wide as the number of cells it has to see and
is compared with all rows of the cells it has found. How many cells that are is measured: of PROBES queries at most the
nearest rows are found by brute force in a pass over all rows, and so many cells are taken that SURE of these rows lie in
them. So the work is that of a few cells where vectors lie in clusters, and of a share of all that falls with the rows where they are noise.

Cells are put together to shards of much the same number of rows, and a cell that is larger than a shard is cut by a hash. A
shard's rows and the queries that come to it are one partition: rows first, which are held, then queries, which pass in
batches. So the shard's size bounds a task's memory. A shard gives its k best of a query, and a task's results are cut to k a
query before they are exchanged. Nodes of the graph are inserted in the order of a hash, upper levels first, in batches
that walk in lockstep. All rows are indexed; recall is measured in the tests.

Equal vectors are one row of a cell that carries the k + 1 smallest ids of its rows, as many as a query can return and
its own, so copies cost nothing and ties fall to the smaller id. A query's candidates are all rows but
its own: a row that repeats its id, or id and vector, is one of them. Rows equal in id and vector are asked once, rows
of one id with several vectors one by one; `query_row` numbers them in the order of the vectors' hashes.
Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without an id;
vectors are compared with those of their own length only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from harrier.llm.common import checkpoint

#: Rows from which heads are fitted, rows of a cell, cells at most, rounds of the fit; queries that measure, and the share of their neighbours that must be seen.
SAMPLE, CELL, CELLS, ROUNDS, PROBES, SURE = 65_536, 512, 4096, 6, 256, 0.98
#: Shards wanted, and their rows at least and at most; queries compared at once, and bytes of them that are sent at once.
SHARDS, LEAST, MOST, QUERIES, SENT = 64, 256, 131_072, 1024, 16_000_000
#: Neighbours of a head on the ground and above, beam widths.
GROUND, ABOVE, BUILD_BEAM = 32, 12, 64
#: A walk looks for one in so many cells at most; for more of them a query is compared with all heads, which costs less than meeting them on a walk.
WALKED = 8
#: Share of a level's nodes on the next, nodes walked together, nodes expanded in one step at least.
_STEP, _BATCH, _EXPAND = 16, 256, 4


class Graph:
    """Unit vectors (n, d) and neighbour arrays, from the ground up; -1 fills free places. Level k holds the first sizes[k] nodes."""

    def __init__(self, unit: np.ndarray, links: list[np.ndarray] | None = None):
        self.unit = np.ascontiguousarray(unit, np.float32)
        n = len(unit)
        sizes = [n]
        while sizes[-1] > 4 * _STEP:
            sizes.append(sizes[-1] // _STEP)
        self.sizes = sizes
        self.links = links if links is not None else [np.full((s, GROUND if k == 0 else ABOVE), -1, np.int32) for k, s in enumerate(sizes)]
        if links is None:
            self._build()

    def _build(self) -> None:
        done = 0
        while done < len(self.unit):
            new = np.arange(done, min(len(self.unit), done + min(_BATCH, max(32, done))))
            start = None
            for level in range(len(self.sizes) - 1, -1, -1):
                here = new[new < self.sizes[level]]
                if done and level < len(self.sizes):
                    start, near = self.walk(self.unit[new], level, min(done, self.sizes[level]), BUILD_BEAM if len(here) else 1, start)
                    found, near = start[: len(here)], near[: len(here)]
                else:  # the first batch links among itself
                    near = self.unit[here] @ self.unit[here].T
                    np.fill_diagonal(near, -2)
                    order = np.argsort(-near, 1, kind="stable")[:, :BUILD_BEAM]
                    found, near = here[order], np.take_along_axis(near, order, 1)
                    found = np.where(near > -2, found, -1)
                if len(here):
                    self._link(here, found, near, level)
            done += len(new)

    def _diverse(self, found: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row than to any taken before; then the nearest others."""
        rows, width = found.shape
        vectors = self.unit[found]
        among = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros((rows, width), bool)
        for j in range(width):
            hidden = (taken & (among[:, j, :] > near[:, j : j + 1])).any(1)
            taken[:, j] = (found[:, j] >= 0) & ~hidden & (taken.sum(1) < most)
        rank = np.where(taken, 0, np.where(found >= 0, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, 1, kind="stable")[:, :most]
        return np.take_along_axis(found, order, 1)

    def _link(self, nodes: np.ndarray, found: np.ndarray, near: np.ndarray, level: int) -> None:
        links = self.links[level]
        most = links.shape[1]
        chosen = self._diverse(found, near, most)
        links[nodes, : chosen.shape[1]] = chosen
        # reverse links: each target keeps a diverse choice of its old and new neighbours
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        for at in range(0, len(target), 2048):
            s, t = source[at : at + 2048], target[at : at + 2048]
            nodes_t, first, count = np.unique(t, return_index=True, return_counts=True)
            wide = np.full((len(nodes_t), int(count.max(initial=0))), -1, np.int32)
            wide[np.repeat(np.arange(len(nodes_t)), count), np.arange(len(t)) - np.repeat(first, count)] = s
            own = np.concatenate([links[nodes_t], wide], 1)
            like = np.einsum("rd,rkd->rk", self.unit[nodes_t], self.unit[own])
            like[own < 0] = -3
            by = np.argsort(-like, 1, kind="stable")
            own, like = np.take_along_axis(own, by, 1), np.take_along_axis(like, by, 1)
            again = np.concatenate([np.zeros((len(own), 1), bool), own[:, 1:] == own[:, :-1]], 1)
            own = np.where(again, -1, own)
            links[nodes_t] = self._diverse(own, like, most)

    def walk(self, queries: np.ndarray, level: int, limit: int, beam: int, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search on a level among its first `limit` nodes: ids and likenesses, nearest first, -1 where fewer."""
        q, links = len(queries), self.links[level]
        entry = np.zeros((q, 1), np.int32) if start is None else start[:, : min(start.shape[1], 4)]
        seen = np.zeros((q, limit + 1), bool)  # the last place stands for -1
        rows = np.arange(q)[:, None]
        ids = np.full((q, beam + entry.shape[1]), -1, np.int32)
        like = np.full(ids.shape, -3, np.float32)
        ids[:, : entry.shape[1]] = np.where(entry < limit, entry, -1)
        like[:, : entry.shape[1]] = np.where(ids[:, : entry.shape[1]] >= 0, np.einsum("qd,qkd->qk", queries, self.unit[ids[:, : entry.shape[1]]]), -3)
        seen[rows, ids] = True
        seen[:, limit] = True
        order = np.argsort(-like, 1, kind="stable")[:, :beam]
        ids, like = np.take_along_axis(ids, order, 1), np.take_along_axis(like, order, 1)
        open_ = ids >= 0
        live, expand = np.arange(q), max(_EXPAND, beam // 16)
        while len(live):
            rank = np.cumsum(open_[live], 1)
            pick = open_[live] & (rank <= expand)
            go = pick.any(1)
            live, pick = live[go], pick[go]
            if not len(live):
                break
            slot = np.argsort(~pick, 1, kind="stable")[:, :expand]
            node = np.where(np.take_along_axis(pick, slot, 1), np.take_along_axis(ids[live], slot, 1), -1)
            open_[live] &= ~pick
            next_ = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(live), -1)
            next_ = np.where(next_ < limit, next_, -1)
            at = live[:, None]
            fresh = ~seen[at, next_]
            next_ = np.where(fresh, next_, -1)
            seen[at, next_] = True
            score = np.einsum("qd,qkd->qk", queries[live], self.unit[next_])
            score[next_ < 0] = -3
            # one place twice among the new ones: the second is dropped
            by = np.argsort(next_, 1, kind="stable")
            ordered = np.take_along_axis(next_, by, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, by[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            score[twice] = -3
            all_ids = np.concatenate([ids[live], np.where(score > -3, next_, -1)], 1)
            all_like = np.concatenate([like[live], score], 1)
            all_open = np.concatenate([open_[live], score > -3], 1)
            best = np.argsort(-all_like, 1, kind="stable")[:, :beam]
            ids[live], like[live], open_[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_like, all_open))
        return ids, like

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        start = None
        for level in range(len(self.sizes) - 1, 0, -1):
            start, _ = self.walk(queries, level, self.sizes[level], 8, start)
        return self.walk(queries, 0, self.sizes[0], beam, start)[0]


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _wide(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length, as rows."""
    ends, raw = column.buffers()[1:]
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]].view(kind).astype(np.float64).reshape(len(column), -1)


def _of_length(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """A batch's rows by the length of their vectors: the length, the rows and the vectors."""
    lengths = np.asarray(pc.binary_length(batch.column("vector"))) // np.dtype(kind).itemsize
    for dim in np.unique(lengths).tolist():
        own = batch if (lengths == dim).all() else batch.take(pa.array(np.flatnonzero(lengths == dim)))
        yield dim, own, _wide(own.column("vector"), kind)


def _means(unit: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The unit means of the vectors nearest to each head; a head that nothing is near to stays."""
    cell = _nearest_head(unit, heads)
    order = np.argsort(cell, kind="stable")
    used, first = np.unique(cell[order], return_index=True)
    sums = np.add.reduceat(unit[order].astype(np.float64), first)
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    out = heads.copy()
    out[used] = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), heads[used])
    return out


def _nearest_head(unit: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *((unit[at : at + 2048] @ heads.T).argmax(1) for at in range(0, len(unit), 2048))])


def _fit(cells: dict[int, int], kind: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The heads of the cells for vectors of one length, and the graph over them."""
        rows = rows.sort_values(["place", "vector"])
        unit = _unit(np.stack([np.frombuffer(v, kind) for v in rows["vector"]])).astype(np.float32)
        dim = unit.shape[1]
        heads = unit[: cells[dim]]
        for _ in range(ROUNDS if len(heads) > 1 else 0):
            heads = _means(unit, heads)
        return pd.DataFrame({"dim": [dim], "heads": [heads.tobytes()], "links": [[x.tobytes() for x in Graph(heads).links]]})

    return run


def _graph(heads: bytes, links: list[bytes], dim: int) -> Graph:
    return Graph(np.frombuffer(heads, np.float32).reshape(-1, dim), [np.frombuffer(x, np.int32).reshape(-1, GROUND if i == 0 else ABOVE) for i, x in enumerate(links)])


def _measure(k: int, kind: str, shared):
    """How many rows each cell has, and the k nearest rows of each measuring query in a task: their likeness, and the place of their cell among those next to the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs, probes = shared.value
        places = {d: np.argsort(np.argsort(-(_unit(q).astype(np.float32) @ graphs[d].unit.T), 1, kind="stable"), 1) for d, q in probes.items()}
        counts = {d: np.zeros(len(g.unit), np.int64) for d, g in graphs.items()}
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, _, vectors in _of_length(batch, kind):
                unit = _unit(vectors).astype(np.float32)
                cell = _nearest_head(unit, graphs[dim].unit)
                counts[dim] += np.bincount(cell, minlength=len(counts[dim]))
                if dim not in probes:
                    continue
                like = _unit(probes[dim]).astype(np.float32) @ unit.T
                top = np.argpartition(-like, k, 1)[:, : k + 1] if like.shape[1] > k + 1 else np.broadcast_to(np.arange(like.shape[1]), like.shape)
                score = np.where((vectors[top] == probes[dim][:, None]).all(2), -2, np.take_along_axis(like, top, 1))  # not the query's own row
                place = np.take_along_axis(places[dim], cell[top], 1)
                if dim in best:
                    score, place = np.concatenate([best[dim][0], score], 1), np.concatenate([best[dim][1], place], 1)
                by = np.argsort(-score, 1, kind="stable")[:, :k]
                best[dim] = np.take_along_axis(score, by, 1), np.take_along_axis(place, by, 1)
        for dim, n in counts.items():
            used = np.flatnonzero(n)
            yield _measured(dim, used, np.full(len(used), np.nan), n[used])
        for dim, (score, place) in best.items():
            some = score > -2
            yield _measured(dim, np.nonzero(some)[0], score[some], place[some])

    return run


def _measured(dim: int, which: np.ndarray, score: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    score = score.astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(which), dim, np.int32)), pa.array(which.astype(np.int64)), pa.array(score, mask=np.isnan(score)), pa.array(n.astype(np.int64))], ["dim", "which", "score", "n"])


def _dealt(counts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each cell's first shard and its number of shards, and the shards in all; they are numbered from `first` on."""
    size = min(MOST, max(LEAST, math.ceil(counts.sum() / SHARDS)))
    start, parts, held = np.empty(len(counts), np.int64), np.maximum(1, -(-counts // size)), 0
    at = first
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > size:
            at, held = at + 1, 0
        start[cell] = at
        if n > size:
            at, held = at + int(parts[cell]), 0
        else:
            held += n
    return start, parts, at + 1


_ROWS = "shard int, kind int, vector binary, ids array<long>, query_row long, cells array<int>"


def _place(kind: str, shared):
    """Rows of the index, each with its cell and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs, dealt, _ = shared.value
        for batch in batches:
            for dim, own, vectors in _of_length(batch, kind):
                cell, (start, parts) = _nearest_head(_unit(vectors).astype(np.float32), graphs[dim].unit), dealt[dim]
                shard = start[cell] + own.column("place").to_numpy() % parts[cell]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32)), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.zeros(len(cell), np.int32)), own.column("vector"), own.column("ids"), pa.nulls(len(cell), pa.int64()), cells], ["shard", "kind", "vector", "ids", "query_row", "cells"])

    return run


def _route(kind: str, shared):
    """Queries, once for each shard in which they have cells to see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs, dealt, wanted = shared.value
        for batch in batches:
            for dim, own, vectors in _of_length(batch, kind):
                graph, (start, parts), beam = graphs[dim], dealt[dim], wanted[dim]
                step = max(1, min(_BATCH, SENT // (8 * dim * min(int(parts.sum()), beam * int(parts.max())))))
                for at in range(0, len(vectors), step):
                    unit = _unit(vectors[at : at + step]).astype(np.float32)
                    found = graph.search(unit, beam) if WALKED * beam < len(graph.unit) else np.argsort(-(unit @ graph.unit.T), 1)[:, :beam]
                    query, cell = np.nonzero(found >= 0)[0], found[found >= 0]
                    n = parts[cell]
                    query, cell, shard = np.repeat(query, n), np.repeat(cell, n), np.repeat(start[cell] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    order = np.lexsort((cell, shard, query))
                    query, cell, shard = query[order], cell[order], shard[order]
                    first = np.flatnonzero(np.concatenate([[True], (query[1:] != query[:-1]) | (shard[1:] != shard[:-1])]))
                    ones = pa.array(np.arange(len(first) + 1, dtype=np.int32))
                    mine = own.take(pa.array(at + query[first]))
                    cells = pa.ListArray.from_arrays(pa.array(np.append(first, len(cell)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), pa.array(np.ones(len(first), np.int32)), mine.column("vector"), pa.ListArray.from_arrays(ones, mine.column("vec_id")), mine.column("query_row"), cells], ["shard", "kind", "vector", "ids", "query_row", "cells"])

    return run


class Shard:
    """The rows of a shard, those of a cell side by side."""

    def __init__(self, batches: list[pa.RecordBatch], k: int, kind: str):
        cell = np.concatenate([b.column("cells").flatten().to_numpy() for b in batches])
        ids, some = [], []
        for b in batches:
            n = np.diff(b.column("ids").offsets.to_numpy())
            own = np.zeros((len(n), k + 1), np.int64)
            own[np.arange(k + 1) < n[:, None]] = b.column("ids").flatten().to_numpy()
            ids.append(own), some.append(n)
        ids, some = np.concatenate(ids), np.concatenate(some)
        order = np.lexsort((ids[:, 0], cell))  # rows come in any order
        self.ids, self.some = ids[order], some[order]
        self.vectors = np.concatenate([_wide(b.column("vector"), kind) for b in batches])[order]
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.unit = (self.vectors / self.norms[:, None]).astype(np.float32)
        self.cells, self.first = np.unique(cell[order], return_index=True)
        self.last = np.append(self.first[1:], len(cell))

    def near(self, unit: np.ndarray, query: np.ndarray, cells: np.ndarray, most: int) -> np.ndarray:
        """The `most` nearest rows of each query in its cells (pairs of query and cell), nearest first, -1 where fewer."""
        found, bound = [], np.full(len(unit), -3, np.float32)
        at = np.searchsorted(self.cells, cells)
        live = (at < len(self.cells)) & (self.cells[np.minimum(at, len(self.cells) - 1)] == cells)
        order = np.argsort(at[live], kind="stable")
        query, at = query[live][order], at[live][order]
        used, first = np.unique(at, return_index=True)
        held = 0
        for cell, own in zip(used.tolist(), np.split(query, first[1:]), strict=True):
            a, b = self.first[cell], self.last[cell]
            like = unit[own] @ self.unit[a:b].T
            fresh = bound[own] < -2
            if b - a > most and fresh.any():
                bound[own[fresh]] = np.partition(like[fresh], b - a - most, 1)[:, b - a - most]
            row, node = np.nonzero(like >= bound[own][:, None])
            found.append((own[row], a + node, like[row, node]))
            held += len(row)
            if held > 16 * most * len(unit):
                found = [self._best(found, most)]
                q, _, s = found[0]
                held, last = len(q), np.flatnonzero(np.concatenate([q[1:] != q[:-1], [True]]))
                full = np.diff(last, prepend=-1) == most
                bound[q[last[full]]] = s[last[full]]
        out = np.full((len(unit), most), -1, np.int64)
        if found:
            q, node, _ = self._best(found, most)
            starts = np.searchsorted(q, q)
            out[q, np.arange(len(q)) - starts] = node
        return out

    @staticmethod
    def _best(found: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
        q, node, like = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(4.0 * q - like)  # by query, then the likest
        q, node, like = q[order], node[order], like[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < most
        return q[keep], node[keep], like[keep]


def _scan(k: int, kind: str):
    def answered(shard: Shard, batch: pa.RecordBatch) -> pa.RecordBatch:
        queries = _wide(batch.column("vector"), kind)
        own_ids, rows = batch.column("ids").flatten().to_numpy(), batch.column("query_row").to_numpy()
        n = np.diff(batch.column("cells").offsets.to_numpy())
        found = shard.near(_unit(queries).astype(np.float32), np.repeat(np.arange(len(queries)), n), batch.column("cells").flatten().to_numpy(), 2 * k)
        score = np.einsum("qd,qkd->qk", queries, shard.vectors[found]) / (np.linalg.norm(queries, axis=1)[:, None] * shard.norms[found])
        wide = shard.ids[found]
        live = (found >= 0)[:, :, None] & (np.arange(k + 1) < shard.some[found][:, :, None])
        # the query's own row: the first of its id among those of its vector
        same = live & (wide == own_ids[:, None, None]) & (shard.vectors[found] == queries[:, None, :]).all(2)[:, :, None]
        live &= ~(same & (np.cumsum(same, 2) == 1))
        wide, live = wide.reshape(len(queries), -1), live.reshape(len(queries), -1)
        score = np.where(live, np.repeat(score, k + 1, 1), -np.inf)
        by = np.lexsort((wide, -score), axis=1)[:, :k]
        wide, score = np.take_along_axis(wide, by, 1), np.take_along_axis(score, by, 1)
        live = score > -np.inf
        times = live.sum(1)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(own_ids, times)), pa.array(np.repeat(rows, times)), pa.array(wide[live]), pa.array(score[live])], ["query_id", "query_row", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's rows come before the queries that are asked of it."""
        held: list[pa.RecordBatch] = []
        at, shard = None, None
        for batch in batches:
            key = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
                number, asks = divmod(int(key[a]), 2)
                if number != at:
                    held, at, shard = [], number, None
                if not asks:
                    held.append(batch.slice(a, b - a))
                    continue
                if shard is None and held:
                    shard, held = Shard(held, k, kind), []
                for c in range(a, b if shard is not None else a, QUERIES):
                    yield answered(shard, batch.slice(c, min(b, c + QUERIES) - c))

    return run


def nearest(vectors: DataFrame, queries: str, k: int = 5) -> DataFrame:
    """Rows query_id, rank, vec_id, score, query_row: the k nearest found by cosine of each row of vectors (vec_id, embedding) that the condition `queries` picks."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    # floats stay floats on their way, half as long; all is computed from doubles
    kind = "<f4" if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else "<f8"
    width = np.dtype(kind).itemsize
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", x if kind == "<f4" else x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    flat = rows.mapInArrow(_flat(kind), "vec_id long, vector binary")
    # the limit holds within tasks before the exchange, so a very common vector sends few rows
    least = flat.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    once = least.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    once = checkpoint(once.select("vector", "ids", F.xxhash64(F.lit(1), "vector").bitwiseAND(F.lit((1 << 62) - 1)).alias("place"), (F.length("vector") / width).cast("int").alias("dim")))
    sizes = {r["dim"]: r["n"] for r in once.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_row int")
    one_of = F.create_map(*[F.lit(y) for d, n in sizes.items() for y in (d, max(1, math.ceil(n / SAMPLE)))])
    drawn = once.where(F.col("place") % one_of[F.col("dim")] == 0).select("dim", "place", "vector")
    fitted = drawn.groupBy("dim").applyInPandas(_fit({d: min(CELLS, max(1, n // CELL)) for d, n in sizes.items()}, kind), "dim int, heads binary, links array<binary>").collect()
    graphs = {r["dim"]: _graph(r["heads"], r["links"], r["dim"]) for r in fitted}

    asked = rows.where(queries).select("vec_id", "embedding").mapInArrow(_flat(kind), "vec_id long, vector binary").distinct()
    asked = asked.withColumn("query_row", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.xxhash64("vector"), "vector")) - 1)
    asked = checkpoint(asked.select("vec_id", F.col("query_row").cast("long").alias("query_row"), "vector", F.length("vector").alias("length")))
    some = asked.withColumn("r", F.row_number().over(Window.partitionBy("length").orderBy(F.xxhash64(F.lit(2), "vector"), "vec_id", "query_row"))).where(F.col("r") <= PROBES)
    probes: dict[int, list[np.ndarray]] = {}
    for r in some.select("vector").collect():
        probes.setdefault(len(r["vector"]) // width, []).append(np.frombuffer(r["vector"], kind).astype(np.float64))
    probing = spark.sparkContext.broadcast((graphs, {d: np.stack(v) for d, v in probes.items()}))
    seen = checkpoint(once.select("vector").mapInArrow(_measure(k, kind, probing), "dim int, which long, score double, n long"))
    counts = {d: np.zeros(len(g.unit), np.int64) for d, g in graphs.items()}
    for r in seen.where("score IS NULL").groupBy("dim", "which").agg(F.sum("n").alias("n")).collect():
        counts[r["dim"]][r["which"]] = r["n"]
    best = Window.partitionBy("dim", "which").orderBy(F.desc("score"), "n")
    near = seen.where("score IS NOT NULL").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    wanted = {r["dim"]: r["p"] + 1 for r in near.groupBy("dim").agg(F.percentile("n", SURE).alias("p")).collect()}
    # a walk misses some of the cells that it looks for: its beam is a little wider
    beams = {d: min(len(g.unit), math.ceil(1.05 * wanted.get(d, 1)) + 2) for d, g in graphs.items()}
    dealt, shards = {}, 0
    for d in sorted(graphs):
        start, parts, shards = _dealt(counts[d], shards)
        dealt[d] = start, parts

    shared = spark.sparkContext.broadcast((graphs, dealt, beams))
    met = once.select("vector", "ids", "place").mapInArrow(_place(kind, shared), _ROWS).unionByName(asked.drop("length").mapInArrow(_route(kind, shared), _ROWS))
    met = met.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    found = met.mapInArrow(_scan(k, kind), "query_id long, query_row long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.col("query_row").cast("int").alias("query_row"))


def _flat(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as bytes."""
        for batch in batches:
            lists, width = batch.column(1), np.dtype(kind).itemsize
            ends = lists.offsets.to_numpy()
            raw = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], kind)
            flat = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(((ends - ends[0]) * width).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["vec_id", "vector"])

    return run


def op6_ann(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, "vec_id % 50 = 0")
