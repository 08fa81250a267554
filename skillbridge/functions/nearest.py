"""Per-task helper of the nearest-neighbour operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CELLS = 4_000_000  # entries of a distance block held at once
_PAIRS = 20_000  # pairs measured exactly at once
_TILE = 512  # queries of a tile of rough distances, which stays in a core's cache
_FIRST, _POINTS = 512, 1024  # points of a tile: while limits are unknown, and then
_HELD = 2_000_000  # pairs that wait to be measured


def vectors(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix of doubles; vectors must have one length."""
    if not len(column):
        return np.empty((0, 0))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if sizes.min() != sizes.max():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} components")
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), int(sizes[0]))


def limits_of(queries: np.ndarray, known: np.ndarray | None, k: int) -> np.ndarray:
    """A bound of each query's ``k``-th distance, from ``known`` rows of the corpus, with room for rounding."""
    out = np.full(len(queries), np.inf)
    if known is None or not len(queries):
        return out
    norms = np.einsum("ij,ij->i", known, known)
    step = max(1, _CELLS // len(known))
    for lo in range(0, len(queries), step):
        some = queries[lo : lo + step]
        own = np.einsum("ij,ij->i", some, some)
        rough = own[:, None] + norms[None, :] - 2.0 * (some @ known.T)
        far = np.partition(rough, k - 1, axis=1)[:, k - 1]
        out[lo : lo + step] = np.maximum(far, 0.0) + 1e-9 * (1.0 + own + norms.max())
    return out


class TopK:
    """The ``k`` nearest rows per query among all rows offered, ties broken by id.

    A matrix product finds the rows that can matter; only those are measured exactly, by
    differences, so that equal vectors have equal distances wherever they are met.
    """

    def __init__(self, queries: np.ndarray, k: int, limit: np.ndarray | None = None) -> None:
        """``limit``: distances beyond which each query is known to have no hit."""
        self.queries = queries
        self.k = k
        self.norms = np.einsum("ij,ij->i", queries, queries)
        self.centre = queries.mean(axis=0) if len(queries) else np.zeros(queries.shape[1])
        moved = queries - self.centre
        self.half = np.einsum("ij,ij->i", moved, moved) / 2
        self.seen = 0
        self.limit = np.full(len(queries), np.inf) if limit is None else limit.copy()
        self.query = np.empty(0, dtype=np.int64)
        self.dist = np.empty(0)
        self.rows: pa.Table | None = None

    def offer(self, points: np.ndarray, rows: pa.Table, id_col: str) -> None:
        if not len(points) or not len(self.queries):
            return
        if points.shape[1] != self.queries.shape[1]:
            raise ValueError(f"vectors of {points.shape[1]} and of {self.queries.shape[1]} components")
        lo = 0
        while lo < len(points):
            # limits get better while few rows have been seen, so that later steps let little pass
            step = max(_FIRST, 2 * self.seen)
            self._offer(points[lo : lo + step], rows.slice(lo, step), id_col)
            self.seen += min(step, len(points) - lo)
            lo += step

    def _offer(self, points: np.ndarray, rows: pa.Table, id_col: str) -> None:
        thinned, waiting, n = False, [], 0
        rough = self._moved(points)
        for lo in range(0, len(self.queries), _TILE):
            query, point = self._near(lo, rough)
            if not thinned and len(query) > 8 * self.k * min(_TILE, len(self.queries) - lo):
                self._measure(waiting, points, rows, id_col)
                keep = self._thin(points, rows[id_col])
                points, rows, rough = points[keep], rows.take(pa.array(keep)), rough[:, keep]
                thinned, waiting, n = True, [], 0
                query, point = self._near(lo, rough)
            waiting.append((query, point))
            n += len(query)
            if n > _HELD:
                self._measure(waiting, points, rows, id_col)
                waiting, n = [], 0
        self._measure(waiting, points, rows, id_col)

    def _measure(self, waiting: list[tuple[np.ndarray, np.ndarray]], points: np.ndarray, rows: pa.Table, id_col: str) -> None:
        """The exact distances of pairs, and what they change."""
        if not sum(len(q) for q, _ in waiting):
            return
        query, point = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
        dist = np.empty(len(query))
        for lo in range(0, len(query), _PAIRS):
            part = slice(lo, lo + _PAIRS)
            diff = self.queries[query[part]] - points[point[part]]
            # summed in order, as the built-in expression does, so that both agree to the bit
            dist[part] = np.cumsum(np.square(diff, out=diff), axis=1, out=diff)[:, -1]
        near = dist <= self.limit[query]
        query, dist, point = query[near], dist[near], point[near]
        if len(query):
            self._merge(query, dist, rows.take(pa.array(point)), id_col)

    def _moved(self, points: np.ndarray) -> np.ndarray:
        """Points around the queries' centre as columns, the last row half their squared norms; see ``_near``."""
        moved = points - self.centre
        half, norms = np.einsum("ij,ij->i", moved, moved) / 2, np.einsum("ij,ij->i", points, points)
        largest = max(float(half.max()), float(self.half.max()), float(norms.max()))
        # short numbers are twice as fast, as long as they hold the values
        kind = np.float32 if largest < 1e30 else np.float64
        out = np.empty((points.shape[1] + 2, len(points)), dtype=np.float64)
        out[:-2], out[-2], out[-1] = moved.T, half, norms
        self.rounding = 4 * (points.shape[1] + 8) * float(np.finfo(kind).eps)
        return out if kind is np.float64 else out.astype(np.float32)

    def _near(self, first: int, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a tile of queries that may be among the nearest, with room for rounding.

        With q and p around the queries' centre, a distance is within the limit if the product q p less p p / 2
        reaches (q q - limit) / 2: one matrix product and one comparison for a pair.
        """
        own = slice(first, first + _TILE)
        kind, half = rough.dtype, self.half[own]
        tile = np.empty((len(half), rough.shape[0] - 1), dtype=kind)
        tile[:, :-1], tile[:, -1] = self.queries[own] - self.centre, -1
        limit, found = self.limit[own], []
        lo, width = 0, rough.shape[1]
        while lo < width:
            hi = min(width, lo + _POINTS)
            product = tile @ rough[:-1, lo:hi]
            room = 1e-9 * (1.0 + self.norms[own] + float(rough[-1, lo:hi].max()))
            room += self.rounding * (half + float(rough[-2, lo:hi].max()))
            # the k-th of these points is only of use to queries that have no k rows yet
            if hi - lo > self.k and not np.isfinite(limit).all():
                kth = half - np.partition(product, hi - lo - self.k, axis=1)[:, hi - lo - self.k]
                limit = np.minimum(limit, 2 * (kth + room))
            least = half - limit / 2 - room
            # rounded towards what lets more pass
            least = np.nextafter(least.astype(kind), kind.type(-np.inf))
            cell = _true_cells(product >= least[:, None])
            found.append((first + cell // (hi - lo), lo + cell % (hi - lo)))
            lo = hi
        query, point = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return query, point

    def _thin(self, points: np.ndarray, ids: pa.ChunkedArray) -> np.ndarray:
        """Keep the ``k`` lowest ids of each group of equal vectors; no query needs more."""
        _, group = np.unique(points, axis=0, return_inverse=True)
        order = np.lexsort((_sortable(ids), group.ravel()))
        return np.sort(order[_rank(group.ravel()[order]) < self.k])

    def _merge(self, query: np.ndarray, dist: np.ndarray, found: pa.Table, id_col: str) -> None:
        query = np.concatenate([self.query, query])
        dist = np.concatenate([self.dist, dist])
        rows = found if self.rows is None else pa.concat_tables([self.rows, found])
        order = np.lexsort((_sortable(rows[id_col]), dist, query))
        rank = _rank(query[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.query, self.dist = query[order], dist[order]
        self.rows = rows.take(pa.array(order))
        full = rank == self.k - 1
        self.limit[self.query[full]] = self.dist[full]


def _true_cells(flags: np.ndarray) -> np.ndarray:
    """Places of the few true cells of a matrix, looked for eight at a time."""
    flat = flags.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return some[flat[some]]


def _sortable(ids: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(ids.type):
        return ids.to_numpy()
    return np.array(ids.to_pylist(), dtype=np.str_)


def _rank(groups: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal values."""
    start = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else groups
    return np.arange(len(groups)) - np.repeat(start, np.diff(np.r_[start, len(groups)]))
