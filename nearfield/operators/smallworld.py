"""A hierarchical small-world graph over the distinct vectors of one part, in matrices.

Equal vectors are one node with several ids: copies cost no links, tie as they should, and cannot close a
neighbourhood off. A graph is built from exact neighbours, found by matrix products of blocks of
nodes with all nodes (a part is bounded), thinned by the diversity rule, linked both ways, and mended until every node can be
reached from the entry. Searches walk for a block of queries at once: each step expands a few nodes of every query's beam.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from .flat import matrix

#: Nearest nodes that links are chosen from, and what is chosen from when links meet links back.
CANDIDATES, MEETING = 48, 96
#: Cells of the largest matrices of a block (doubles or flags). Several tasks share a machine: a block's matrices are some 8 MB each.
_CELLS = 1 << 20
#: The same of a block of narrow walks: flags that take a byte each, and doubles of far fewer cells, as few nodes are new to a step.
_WALKED = 1 << 22
#: Beams from this width on, if their links are as many as the nodes, meet most nodes: distances of a block are one product then.
WIDE = 512
#: How far distances of a product may be from those summed row by row.
_SLACK = 1e-9


def level_of(vec_id: int, m: int) -> int:
    x = (vec_id * 0x9E3779B97F4A7C15 + 100) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x ^= x >> 31
    return int(-math.log((x + 1) / 2**64) / math.log(m))


class Beam:
    """Ends a walk when the ``ef`` nearest found are nearer than all that is left to visit."""

    def __init__(self, ef: int):
        self.ef, self.held = ef, 0

    def done(self, d: float, worst: float) -> bool:
        return self.held >= self.ef and d > worst

    def takes(self, d: float, worst: float) -> bool:
        return self.held < self.ef or d < worst

    def entered(self, node: int, d: float) -> None:
        self.held += 1

    def left(self, node: int, d: float) -> None:
        self.held -= 1

    def over(self) -> bool:
        return self.held > self.ef

    def results(self, found: list[tuple[float, int]]) -> list[tuple[float, int]]:
        return found


class Within(Beam):
    """Finds what lies within ``eps``; looks at ``least`` nodes at least, and keeps ``most`` at most if that is given."""

    def __init__(self, eps: float, least: int = 100, most: int | None = None):
        super().__init__(2**62 if most is None else most)
        self.eps, self.least = eps, least

    def done(self, d: float, worst: float) -> bool:
        return (self.held >= self.least and d > self.eps) or super().done(d, worst)

    def results(self, found: list[tuple[float, int]]) -> list[tuple[float, int]]:
        return [x for x in found if x[0] <= self.eps]


class Documents(Beam):
    """Counts documents instead of nodes: keeps the nodes of the ``ef`` nearest, returns those of the first ``n``."""

    def __init__(self, doc_of: np.ndarray, n: int, ef: int):
        super().__init__(max(ef, n + 1))
        self.doc_of, self.n, self.nodes = doc_of, n, Counter()

    def entered(self, node: int, d: float) -> None:
        self.nodes[self.doc_of[node]] += 1
        self.held = len(self.nodes)

    def left(self, node: int, d: float) -> None:
        doc = self.doc_of[node]
        self.nodes[doc] -= 1
        if not self.nodes[doc]:
            del self.nodes[doc]
        self.held = len(self.nodes)

    def results(self, found: list[tuple[float, int]]) -> list[tuple[float, int]]:
        docs: dict = {}
        for at, (_, node) in enumerate(found):
            docs.setdefault(self.doc_of[node], at)
        first = sorted(docs.values())
        return found[: first[self.n]] if len(first) > self.n else found


def padded(row: np.ndarray, value: np.ndarray, n: int, fill) -> np.ndarray:
    """Values of rows (sorted by row) side by side, rows filled up."""
    counts = np.bincount(row, minlength=n)
    out = np.full((n, int(counts.max(initial=0))), fill, dtype=value.dtype)
    out[row, np.arange(len(row)) - (np.cumsum(counts) - counts)[row]] = value
    return out


def apart(x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, some at a time."""
    step, d = max(1, _CELLS // max(1, x.shape[1])), np.zeros(len(row), dtype=x.dtype)
    for a in range(0, len(row), step):
        d[a : a + step] = 1 - np.einsum("ij,ij->i", x[row[a : a + step]], x[col[a : a + step]])
    return d


def first_of(row: np.ndarray, most: int) -> np.ndarray:
    """Flags of the first ``most`` entries of each row (sorted by row)."""
    return np.arange(len(row)) - np.searchsorted(row, row) < most


def nearest(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, distances) of the k nearest rows of x to each row of q, nearest first; ``own`` rows are left out.

    A threshold from a sixteenth of the rows leaves few to be sorted; where it leaves too few, all are.
    """
    n, k = len(x), min(k, len(x) - (own is not None))
    ids, dist = np.full((len(q), max(k, 0)), -1, dtype=np.int32), np.full((len(q), max(k, 0)), np.inf, dtype=np.float32)
    if k <= 0:
        return ids, dist
    for a in range(0, len(q), max(1, _CELLS // n)):
        s = q[a : a + max(1, _CELLS // n)] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[a : a + len(s)]] = -np.inf
        rank = 2 * -(-k // 16)
        some = s[:, ::16]
        if some.shape[1] > 4 * rank:
            least = np.partition(some, some.shape[1] - rank, axis=1)[:, some.shape[1] - rank]
            row, col = np.nonzero(s >= least[:, None])
            counts = np.bincount(row, minlength=len(s))
            few = np.flatnonzero(counts < k)
            if len(few):
                keep = counts[row] >= k
                top = np.argpartition(-s[few], k - 1, axis=1)[:, :k]
                row, col = np.concatenate([row[keep], np.repeat(few, k)]), np.concatenate([col[keep], top.ravel()])
            value = s[row, col]
            order = np.lexsort((col, -value, row))
            row, col, value = row[order], col[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            first = place < k
            ids[a + row[first], place[first]], dist[a + row[first], place[first]] = col[first], 1 - value[first]
        else:
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            ids[a : a + len(s)], dist[a : a + len(s)] = order, 1 - np.take_along_axis(s, order, 1)
    return ids, dist


def diverse(x: np.ndarray, found: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of the nodes found for each row (nearest first, -1 fills up): those nearer to the row's node than to any taken before.

    Places that are left go to the nearest of the rest, so that sparse parts stay connected.
    """
    out = np.full((len(found), most), -1, dtype=np.int32)
    c = found.shape[1]
    if not c:
        return out
    for a in range(0, len(found), max(1, _CELLS // (4 * c * max(c, x.shape[1])))):
        f, d = found[a : a + max(1, _CELLS // (4 * c * max(c, x.shape[1])))], dist[a : a + max(1, _CELLS // (4 * c * max(c, x.shape[1])))]
        v = x[f]
        between = 1 - v @ v.transpose(0, 2, 1)
        taken, n = np.zeros(f.shape, dtype=bool), np.zeros(len(f), dtype=int)
        for t in range(c):
            ok = (f[:, t] >= 0) & (n < most) & ~(taken & (between[:, t] < d[:, t, None])).any(1)
            taken[:, t] = ok
            n += ok
        # taken ones first, then the nearest of the rest
        order = np.argsort(np.where(taken, 0, np.where(f >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        out[a : a + len(f), : order.shape[1]] = np.take_along_axis(f, order, 1)
    return out


class Layer:
    """The links of one level, by local numbers; ``nodes`` are their numbers in the graph."""

    def __init__(self, nodes: np.ndarray, x: np.ndarray, links: np.ndarray | None = None):
        self.nodes, self.x = nodes, x
        self.links = np.full((len(nodes), 0), -1, dtype=np.int32) if links is None else links

    @cached_property
    def xf(self) -> np.ndarray:
        """Walks compare in double precision, links are chosen in single."""
        return self.x.astype(np.float32)

    def connect(self, found: np.ndarray, dist: np.ndarray, m: int, most: int, first: int = 0) -> None:
        """Give the nodes from ``first`` on their links (m of what was found), and those that they link to links back (``most`` in all)."""
        mine = diverse(self.xf, found, dist, m)
        row, col = np.nonzero(mine >= 0)
        source, target = (row + first).astype(np.int64), mine[row, col].astype(np.int64)
        old_row, old_col = np.nonzero(self.links >= 0)
        pairs = np.concatenate([source * len(self.nodes) + target, target * len(self.nodes) + source, old_row * len(self.nodes) + self.links[old_row, old_col]])
        pairs = np.unique(pairs)
        row, col = (pairs // len(self.nodes)).astype(np.int32), (pairs % len(self.nodes)).astype(np.int32)
        del pairs, source, target, old_row, old_col
        full = np.flatnonzero(np.bincount(row, minlength=len(self.nodes)) > most)
        d = apart(self.xf, row, col)
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        # many may link to one node: rows beyond what is chosen from would widen the matrices of all
        some = first_of(row, max(MEETING, most))
        row, col, d = row[some], col[some], d[some]
        links, far = padded(row, col, len(self.nodes), -1), padded(row, d, len(self.nodes), np.inf)
        out = np.full((len(self.nodes), most), -1, dtype=np.int32)
        out[:, : min(most, links.shape[1])] = links[:, :most]
        if len(full):
            out[full] = diverse(self.xf, links[full, :MEETING], far[full, :MEETING], most)
        self.links = out

    def reached(self, start: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(self.nodes), dtype=bool)
        seen[start] = True
        front = np.asarray(start)
        while len(front):
            near = np.unique(self.links[front])
            front = near[near >= 0]
            front = front[~seen[front]]
            seen[front] = True
        return seen

    def _extend(self, source: np.ndarray, target: np.ndarray) -> None:
        """More links; sources are sorted."""
        place = (self.links >= 0).sum(1)
        offset = np.arange(len(source)) - np.searchsorted(source, source)
        width = int((place[source] + offset).max()) + 1
        if width > self.links.shape[1]:
            self.links = np.hstack([self.links, np.full((len(self.nodes), width - self.links.shape[1]), -1, dtype=np.int32)])
        self.links[source, place[source] + offset] = target

    def _leads_to(self, entry: int) -> np.ndarray:
        """Which nodes have a way to the entry."""
        row, col = np.nonzero(self.links >= 0)
        to = self.links[row, col]
        order = np.argsort(to, kind="stable")
        source, first = row[order], np.searchsorted(to[order], np.arange(len(self.nodes) + 1))
        seen = np.zeros(len(self.nodes), dtype=bool)
        seen[entry] = True
        front = np.array([entry])
        while len(front):
            size = first[front + 1] - first[front]
            front = np.unique(source[np.repeat(first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
            front = front[~seen[front]]
            seen[front] = True
        return seen

    def repair(self, entry: int) -> None:
        """Link to every node that cannot be reached from the entry: from the nearest that can, a few at a time. Then link those without a way to it."""
        while True:
            seen = self.reached(np.array([entry]))
            lost, there = np.flatnonzero(~seen), np.flatnonzero(seen)
            if not len(lost):
                break
            near, dist = nearest(self.xf[there], self.xf[lost], 1)
            source = there[near[:, 0]]
            # of those that would link to many, the nearest come first and bring others along
            order = np.lexsort((dist[:, 0], source))
            source, target = source[order], lost[order]
            some = np.arange(len(source)) - np.searchsorted(source, source) < 4
            source, target = source[some], target[some]
            self._extend(source, target)
        seen = self._leads_to(entry)
        lost, there = np.flatnonzero(~seen), np.flatnonzero(seen)
        if len(lost):
            self._extend(lost, there[nearest(self.xf[there], self.xf[lost], 1)[0][:, 0]])


class Graph:
    """Nodes by number; links by level; distance 1 - product."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, m: int = 16, ef: int = 150):
        self.m, self.ef = m, ef
        self.hops = self.seen = 0
        ids = np.asarray(ids, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        x, ids = np.asarray(x, dtype=np.float64)[order], ids[order]
        x += 0.0  # no negative zeros
        first, node = _distinct(x)
        x = _at(x, first)
        self._set(x, ids, node)
        self.layers: list[Layer] = []
        levels = np.array([level_of(int(i), m) for i in ids[first]], dtype=np.int64)
        for at in range(int(levels.max(initial=-1)) + 1):
            nodes = np.flatnonzero(levels >= at)
            layer = Layer(nodes, _at(self.x, nodes))
            found, dist = nearest(layer.xf, layer.xf, CANDIDATES, np.arange(len(nodes)))
            layer.connect(found, dist, m, 2 * m if at == 0 else m)
            self.layers.append(layer)
        self._mend()

    def _set(self, x: np.ndarray, ids: np.ndarray, node: np.ndarray) -> None:
        """Vectors of the nodes, and the ids of all rows with their nodes, by node and id."""
        order = np.lexsort((ids, node))
        self.x = x
        self.ids, self.node = ids[order], node[order]
        self.first = np.searchsorted(self.node, np.arange(len(x) + 1))

    def _mend(self) -> None:
        self.entry = int(self.layers[-1].nodes[0]) if self.layers else -1
        for layer in self.layers:
            layer.repair(int(np.searchsorted(layer.nodes, self.entry)))

    @property
    def links(self) -> list[dict[int, list[int]]]:
        return [{int(n): [int(layer.nodes[y]) for y in out if y >= 0] for n, out in zip(layer.nodes, layer.links, strict=True)} for layer in self.layers]

    @classmethod
    def of_table(cls, rows: pa.Table, m: int = 16, ef: int = 150) -> Graph:
        """A stored graph; gaps, foreign or double links and a missing entry are errors."""
        out = cls.__new__(cls)
        out.m, out.ef, out.hops, out.seen = m, ef, 0, 0
        heads = rows.filter(rows["links"].is_valid()).sort_by("node").combine_chunks()
        n = heads.num_rows
        entry = np.flatnonzero(heads["entry"].to_numpy(zero_copy_only=False))
        node = rows["node"].to_numpy()
        if heads["node"].to_pylist() != list(range(n)) or len(entry) != 1 or (len(node) and not 0 <= node.min() <= node.max() < n):
            raise ValueError("nodes or the entry of a graph are missing")
        out._set(matrix(heads["embedding"]), rows["vec_id"].to_numpy(), node)
        outer = heads["links"].combine_chunks() if isinstance(heads["links"], pa.ChunkedArray) else heads["links"]
        starts, inner = outer.offsets.to_numpy(), outer.values
        bounds, values = inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)
        depth = np.diff(starts)
        out.layers = []
        for at in range(int(depth.max(initial=0))):
            nodes = np.flatnonzero(depth > at)
            begin = bounds[starts[nodes] + at]
            size = bounds[starts[nodes] + at + 1] - begin
            row = np.repeat(np.arange(len(nodes)), size)
            to = values[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            local = np.searchsorted(nodes, to)
            if len(to) and (nodes[np.minimum(local, len(nodes) - 1)] != to).any():
                raise ValueError("a node links to one that is not on its level")
            out.layers.append(Layer(nodes, _at(out.x, nodes), padded(row, local.astype(np.int32), len(nodes), -1)))
        out.entry = int(entry[0])
        if depth[out.entry] != len(out.layers):
            raise ValueError("the entry is not on the highest level")
        out.check()
        return out

    def table(self) -> pa.Table:
        """One row an id: node, id, links by level (null for all but a node's least id), whether it is the entry, vector."""
        head = np.zeros(len(self.ids), dtype=bool)
        head[self.first[:-1]] = True
        cells = self._cells(head)
        x = _at(self.x, self.node)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1)[: len(x) + 1], pa.int32()), pa.array(x.ravel()))
        return pa.table({
            "node": pa.array(self.node, pa.int64()), "vec_id": pa.array(self.ids, pa.int64()), "links": cells,
            "entry": pa.array((self.node == self.entry) & head), "embedding": vectors,
        })

    def _cells(self, head: np.ndarray) -> pa.ListArray:
        """Links of each node by level, in lists that are cut from one array: at the first rows of nodes, null at others."""
        offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        has = [layer.links >= 0 for layer in self.layers]
        owner = np.concatenate([np.zeros(0, dtype=np.int64), *(np.repeat(layer.nodes, h.sum(1)) for layer, h in zip(self.layers, has, strict=True))])
        to = np.concatenate([np.zeros(0, dtype=np.int32), *(layer.nodes.astype(np.int32)[layer.links[h]] for layer, h in zip(self.layers, has, strict=True))])
        # by node, levels of a node in turn
        to = to[np.argsort(owner, kind="stable")]
        nodes = np.concatenate([np.zeros(0, dtype=np.int64), *(layer.nodes for layer in self.layers)])
        sizes = np.concatenate([np.zeros(0, dtype=np.int64), *(h.sum(1) for h in has)])[np.argsort(nodes, kind="stable")]
        levels = np.zeros(len(head), dtype=np.int64)
        levels[head] = np.bincount(nodes, minlength=len(self.x))
        return pa.ListArray.from_arrays(offsets(levels), pa.ListArray.from_arrays(offsets(sizes), pa.array(to, pa.int32())), mask=pa.array(~head))

    def check(self) -> None:
        for layer in self.layers:
            if not len(layer.links.T):
                continue
            row, col = np.nonzero(layer.links >= 0)
            to = layer.links[row, col]
            if (to == row).any() or len(np.unique(row * len(layer.nodes) + to)) != len(row):
                raise ValueError("a node links to itself, or twice to another")

    def degrees(self) -> tuple[int, int]:
        """Least and greatest in-degree on level 0; self-links and double links are errors."""
        self.check()
        if not self.layers:
            return (0, 0)
        to = self.layers[0].links
        count = np.bincount(to[to >= 0], minlength=len(self.x))
        return int(count.min()), int(count.max())

    def _wide(self, layer: Layer, ef: int) -> bool:
        return ef >= WIDE and ef * layer.links.shape[1] >= len(layer.nodes)

    def _spread(self, layer: Layer, q: np.ndarray, start: np.ndarray, ef: int, good: np.ndarray | None) -> np.ndarray:
        """As ``_walk``, for wide beams: each step opens all of a query's beam that is not open yet. With ``good`` flags only such nodes count and are found."""
        n = len(layer.nodes)
        out, dist = np.full((len(q), ef), -1, dtype=np.int32), q @ layer.x.T
        np.subtract(1, dist, out=dist)
        self.seen += dist.size
        reach: dict[bytes, np.ndarray] = {}
        for i, d in enumerate(dist):
            if ef >= n:
                # a beam without an edge opens all that links lead to, in whatever order: that depends on the start only
                if (key := start[i].tobytes()) not in reach:
                    reach[key] = np.flatnonzero(layer.reached(start[i][start[i] >= 0]))
                found = reach[key] if good is None else reach[key][good[reach[key]]]
                self.hops += len(reach[key])
                near = d[found]
                found = found[np.argsort(near)[: np.count_nonzero(near <= np.inf)]]
                out[i, : len(found)] = found
                continue
            new = start[i][start[i] >= 0]
            seen = np.zeros(n + 1, dtype=bool)  # the last flag takes the -1 that fill links up
            seen[-1] = True
            held, far = np.zeros(0), np.inf
            while len(new):
                seen[new] = True
                near = d[new] if good is None else d[new[good[new]]]
                held = np.concatenate([held, near[near <= far]])
                if len(held) >= ef:
                    held = np.partition(held, ef - 1)[:ef]
                    far = held[-1]
                new = new[d[new] <= far]
                self.hops += len(new)
                met = np.zeros(n + 1, dtype=bool)
                met[layer.links[new]] = True
                new = np.flatnonzero(met & ~seen)
            seen[:-1] &= d <= far
            found = np.flatnonzero(seen[:-1] if good is None else seen[:-1] & good)
            found = found[np.argsort(d[found], kind="stable")[:ef]]
            out[i, : len(found)] = found
        return out

    def _walk(self, layer: Layer, q: np.ndarray, start: np.ndarray, ef: int, good: np.ndarray | None = None) -> np.ndarray:
        """Local numbers of the ``ef`` nearest that the walks find, nearest first (-1 fills up), for queries of one block; ``good`` is for wide beams."""
        n, ef = len(layer.nodes), min(ef, len(layer.nodes))
        if self._wide(layer, ef):
            return self._spread(layer, q, start, ef, good)
        width = max(4, ef // 64)
        seen = np.zeros((len(q), n), dtype=bool)
        ids, dist, open_ = np.full((len(q), ef), -1, dtype=np.int32), np.full((len(q), ef), np.inf), np.zeros((len(q), ef), dtype=bool)
        live, new_row, new = np.arange(len(q)), *np.nonzero(start >= 0)
        new = start[new_row, new]
        while len(live):
            # the same node may be reached twice in one step
            key = np.unique(new_row * n + new)
            row, node = key // n, key % n
            fresh = ~seen[row, node]
            row, node = row[fresh], node[fresh]
            seen[row, node] = True
            self.seen += len(row)
            if len(row):
                d = 1 - np.einsum("ij,ij->i", layer.x[node], q[row])
                place = np.searchsorted(live, row)
                all_d = np.hstack([dist[live], padded(place, d, len(live), np.inf)])
                all_i = np.hstack([ids[live], padded(place, node.astype(np.int32), len(live), -1)])
                all_o = np.hstack([open_[live], np.ones((len(live), all_d.shape[1] - ef), dtype=bool)])
                order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
                ids[live], dist[live] = np.take_along_axis(all_i, order, 1), np.take_along_axis(all_d, order, 1)
                open_[live] = np.take_along_axis(all_o, order, 1) & (ids[live] >= 0)
            live = live[open_[live].any(1)]
            next_ = np.argsort(~open_[live], axis=1, kind="stable")[:, :width]
            take = np.take_along_axis(open_[live], next_, 1)
            cur = np.where(take, np.take_along_axis(ids[live], next_, 1), -1)
            flags = open_[live]
            np.put_along_axis(flags, next_, False, axis=1)
            open_[live] = flags
            self.hops += int(take.sum())
            row, at = np.nonzero(cur >= 0)
            near = layer.links[cur[row, at]]
            who, col = np.nonzero(near >= 0)
            new_row, new = live[row[who]], near[who, col].astype(np.int64)
        return ids

    def _block(self, ef: int) -> int:
        if not self.layers:
            return 1024
        width = max(4, min(ef, len(self.x)) // 64)
        degree = self.layers[0].links.shape[1] or 1
        if self._wide(self.layers[0], min(ef, len(self.x))):
            return int(max(1, _CELLS // len(self.x)))
        return int(max(1, min(_WALKED // max(1, len(self.x)), _WALKED // (width * degree * max(1, self.x.shape[1])))))

    def _descend(self, q: np.ndarray, level: int = 0) -> np.ndarray:
        """Starts on ``level``, by node number."""
        start = np.full((len(q), 1), self.entry, dtype=np.int64)
        for layer in self.layers[: level : -1]:
            local = np.where(start >= 0, np.searchsorted(layer.nodes, start), -1)
            found = self._walk(layer, q, local, 4)
            start = np.where(found >= 0, layer.nodes[found], -1)
        return start

    def nodes_near(self, q: np.ndarray, ef: int, start: np.ndarray | None = None, good: np.ndarray | None = None) -> np.ndarray:
        """Nodes of the ``ef`` nearest found for each query, -1 fills up; from ``start`` nodes on level 0, if given."""
        if not self.layers:
            return np.full((len(q), 0), -1, dtype=np.int64)
        q, out = np.asarray(q, dtype=np.float64), []
        step, more = self._block(ef), () if good is None else (good,)
        if start is None and ef >= len(self.x) >= WIDE:
            # where a beam as wide as the graph starts does not matter: its queries share the entry
            start = np.full((len(q), 1), self.entry, dtype=np.int64)
        for a in range(0, len(q), step):
            part = q[a : a + step]
            out.append(self._walk(self.layers[0], part, self._descend(part) if start is None else start[a : a + step], ef, *more))
        return np.vstack(out) if out else np.full((0, 0), -1, dtype=np.int32)

    def _distances(self, v: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Summed row by row in double precision: equal vectors tie."""
        return 1 - (self.x[nodes] * v).sum(1)

    def _until(self, v: np.ndarray, nodes: np.ndarray, p: int, bound: Callable[[np.ndarray, np.ndarray], float | None]) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) in order, of nodes as a walk finds them: as many as it takes to be sure of those within ``bound(nodes, distances)``, which is None if they are too few."""
        while True:
            some = nodes[:p]
            d = self._distances(v, some)
            order = np.lexsort((some, d))
            some, d = some[order], d[order]
            if p >= len(nodes) or ((far := bound(some, d)) is not None and d[-1] > far + _SLACK):
                return some, d
            p *= 4

    def grown(self, q: np.ndarray, ef: int, answer: Callable[[int, np.ndarray, bool], object | None], good: np.ndarray | None = None) -> Iterator[tuple[int, object]]:
        """(query, ``answer(query, nodes, last)``) for each query and what a beam finds, nearest first; the beam is doubled while the answer is None, up to all nodes (``last``).

        Queries are answered block by block, and each answer is handed on at once: neither what beams hold nor what they find is kept.
        """
        left = np.arange(len(q))
        while len(left):
            again, step, last = [], self._block(ef), ef >= len(self.x)
            for a in range(0, len(left), step):
                some = left[a : a + step]
                for i, nodes in zip(some.tolist(), self.nodes_near(q[some], ef, good=good), strict=True):
                    found = answer(i, nodes[nodes >= 0], last)
                    if found is None and not last:
                        again.append(i)
                    else:
                        yield i, found
            left, ef = np.array(again, dtype=int), 2 * ef

    def rows_of(self, nodes: np.ndarray, dist: np.ndarray, k: int | None, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(distance, id) of the rows of such nodes, the k least."""
        out: list[tuple[float, int]] = []
        for n, d in zip(nodes.tolist(), dist.tolist(), strict=True):
            if k is not None and len(out) >= k and d > out[k - 1][0]:
                break
            a, b = self.first[n], self.first[n + 1]
            ids = self.ids[a:b] if allowed is None else self.ids[a:b][allowed[a:b]]
            out += [(d, i) for i in ids[:k].tolist()]
            if k is not None and len(out) > k:
                out.sort()
        return sorted(out)[:k]

    def search_all(self, q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """(distance, id) of the k nearest rows found for each query; ``allowed``: flags of rows, in the order of ``ids``.

        Forbidden nodes are walked through; the beam grows until it holds ``ef`` nodes with an allowed row.
        """
        ef = max(ef, k)
        if allowed is None:
            return _in_order(self.grown(q, ef, lambda i, nodes, last: self._rows_near(q[i], nodes, k)))
        good = np.zeros(len(self.x), dtype=bool)
        good[self.node[allowed]] = True
        want = min(ef, int(good.sum()))
        # wide beams count good nodes only, so they need not grow
        wide = bool(self.layers) and self._wide(self.layers[0], min(ef, len(self.x)))

        def answer(i: int, nodes: np.ndarray, last: bool) -> list | None:
            nodes = nodes[good[nodes]]
            return self._rows_near(q[i], nodes, k, allowed) if wide or last or len(nodes) >= want else None

        return _in_order(self.grown(q, ef, answer, good if wide else None))

    def _rows_near(self, v: np.ndarray, nodes: np.ndarray, k: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        return self.rows_of(*self._until(v, nodes, 2 * k + 32, lambda some, d: d[k - 1] if len(d) >= k else None), k, allowed)

    def range_all(self, q: np.ndarray, eps: float, least: int = 100, allowed: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """(distance, id) of the rows found within ``eps``: the beam grows until it reaches beyond."""
        return _in_order(self.range_each(q, eps, least, allowed))

    def range_each(self, q: np.ndarray, eps: float, least: int = 100, allowed: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """``range_all`` by query, as they are answered."""

        def answer(i: int, nodes: np.ndarray, last: bool) -> list | None:
            if not last and not (len(nodes) and self._distances(q[i], nodes[-1:])[0] > eps):
                return None
            nodes, d = self._until(q[i], nodes, 128, lambda some, d: eps)
            return self.rows_of(nodes[d <= eps], d[d <= eps], None, allowed)

        return self.grown(q, max(1, least), answer)

    def documents_all(self, q: np.ndarray, doc_of: np.ndarray, n: int, ef: int) -> list[list[tuple[float, int]]]:
        """(distance, id) of rows in order, up to the first row of document n + 1, with it; ``doc_of``: documents of rows, in the order of ``ids``."""
        return _in_order(self.documents_each(q, doc_of, n, ef))

    def documents_each(self, q: np.ndarray, doc_of: np.ndarray, n: int, ef: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """``documents_all`` by query, as they are answered."""
        number = np.argsort(self.ids)

        def bound(nodes: np.ndarray, d: np.ndarray) -> float | None:
            docs: set[int] = set()
            for y, far in zip(nodes.tolist(), d.tolist(), strict=True):
                docs.update(doc_of[self.first[y] : self.first[y + 1]].tolist())
                if len(docs) > n:
                    return far
            return None

        def answer(i: int, nodes: np.ndarray, last: bool) -> list | None:
            nodes, d = self._until(q[i], nodes, 64, bound)
            if (far := bound(nodes, d)) is None:
                return self.rows_of(nodes, d, None) if last else None
            rows = self.rows_of(nodes[d <= far], d[d <= far], None)
            docs = doc_of[number[np.searchsorted(self.ids, [i for _, i in rows], sorter=number)]].tolist()
            met: set[int] = set()
            for at, doc in enumerate(docs):
                met.add(doc)
                if len(met) > n:
                    return rows[: at + 1]
            return rows

        return self.grown(q, max(ef, n + 1), answer)

    def flat_all(self, q: np.ndarray, k: int, ef: int, entries: int = 1) -> list[list[tuple[float, int]]]:
        """Level 0 only, from ``entries`` nodes picked by a hash of the query, each with a walk of its own."""
        if not len(self.x):
            return [[] for _ in q]
        out: list[list[tuple[float, int]]] = []
        starts = np.array([[_entry(v, salt, len(self.x)) for salt in range(entries)] for v in q], dtype=np.int64).reshape(len(q), entries)
        # what beams hold is not kept from block to block
        step = self._block(max(ef, k))
        for a in range(0, len(q), step):
            walks = [self.nodes_near(q[a : a + step], max(ef, k), starts[a : a + step, [s]]) for s in range(entries)]
            for v, *near in zip(q[a : a + step], *walks, strict=True):
                if len(near) == 1:
                    out.append(self._rows_near(v, near[0][near[0] >= 0], k))
                    continue
                nodes = np.unique(np.concatenate(near))
                nodes = nodes[nodes >= 0]
                d = self._distances(v, nodes)
                order = np.lexsort((nodes, d))
                out.append(self.rows_of(nodes[order], d[order], k))
        return out

    def search(self, q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        return self.search_all(np.asarray(q)[None], k, ef, allowed)[0]

    def search_flat(self, q: np.ndarray, k: int, ef: int, entries: int = 1) -> list[tuple[float, int]]:
        return self.flat_all(np.asarray(q)[None], k, ef, entries)[0]

    def search_until(self, q: np.ndarray, stop: Beam, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(distance, id) of what a stop condition keeps, node by node; the condition and ``allowed`` see row numbers in the order of ``ids``."""
        if not self.layers:
            return []
        layer = self.layers[0]
        start = self._descend(np.asarray(q, dtype=np.float64)[None])[0]
        near: list[tuple[float, int]] = []
        visited: set[int] = set()
        best: list[tuple[float, int]] = []

        def meet(nodes: list[int]) -> None:
            self.seen += len(nodes)
            visited.update(nodes)
            for d, n in zip((1 - (self.x[nodes] * q).sum(1)).tolist(), nodes, strict=True):
                if not stop.takes(d, -best[0][0] if best else math.inf):
                    continue
                heapq.heappush(near, (d, n))
                for row in range(self.first[n], self.first[n + 1]):
                    if allowed is None or allowed[row]:
                        heapq.heappush(best, (-d, -row))
                        stop.entered(row, d)
                while stop.over():
                    far = heapq.heappop(best)
                    stop.left(-far[1], -far[0])

        meet([int(n) for n in start if n >= 0])
        while near:
            d, n = heapq.heappop(near)
            if stop.done(d, -best[0][0] if best else math.inf):
                break
            self.hops += 1
            new = [y for y in layer.links[n].tolist() if y >= 0 and y not in visited]
            if new:
                meet(new)
        found = stop.results(sorted((-d, -row) for d, row in best))
        return sorted((d, int(self.ids[row])) for d, row in found)

    def remove(self, ids: np.ndarray) -> None:
        """Rows leave; a node without rows leaves too, and what linked to it chooses anew among its own links and the node's."""
        gone = np.isin(self.ids, ids)
        if not gone.any():
            return
        kept_ids, kept_node = self.ids[~gone], self.node[~gone]
        stays = np.zeros(len(self.x), dtype=bool)
        stays[kept_node] = True
        number = np.cumsum(stays) - 1
        layers = []
        for at, layer in enumerate(self.layers):
            live = stays[layer.nodes]
            local = np.cumsum(live) - 1
            links = layer.links
            dead = (links >= 0) & ~live[links]
            hit = np.flatnonzero(live & dead.any(1))
            most = 2 * self.m if at == 0 else self.m
            chosen, some = np.full((len(hit), most), -1, dtype=np.int32), max(1, _CELLS // max(1, links.shape[1] ** 2))
            for a in range(0, len(hit), some):
                chosen[a : a + some] = _anew(layer, live, dead, hit[a : a + some], most)
            links = links.copy()
            if chosen.shape[1] > links.shape[1]:
                links = np.hstack([links, np.full((len(links), chosen.shape[1] - links.shape[1]), -1, dtype=np.int32)])
            links[hit] = -1
            links[hit, : chosen.shape[1]] = chosen
            links = links[live]
            links = np.where(links >= 0, local[links], -1).astype(np.int32)
            nodes = number[layer.nodes[live]]
            if len(nodes):
                layers.append(Layer(nodes, layer.x[live], links))
        self.layers = layers
        self._set(self.x[stays], kept_ids, number[kept_node])
        self._mend()

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows join, and replace those of the same ids: equal vectors join their node, others are linked with what walks find and among each other."""
        ids, x = np.asarray(ids, dtype=np.int64), np.asarray(x, dtype=np.float64) + 0.0
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.remove(ids)
        if not len(self.x):
            self.__init__(x, ids, self.m, self.ef)
            return
        n = len(self.x)
        first, node = _distinct(np.vstack([self.x, x]))
        # numbers of the nodes that were here do not change: they come first and are distinct
        new = first[first >= n] - n
        walked = self.nodes_near(x[new], self.ef) if len(new) else np.zeros((0, 0), dtype=np.int32)
        levels = np.array([level_of(int(i), self.m) for i in ids[new]], dtype=np.int64)
        starts = {at: self._starts(x[new][levels >= at], at) for at in range(1, len(self.layers)) if (levels >= at).any()}
        all_x = np.vstack([self.x, x[new]])
        self._set(all_x, np.concatenate([self.ids, ids]), np.concatenate([self.node, node[n:]]))
        for at in range(int(levels.max(initial=-1)) + 1):
            which = np.flatnonzero(levels >= at)
            if at >= len(self.layers):
                self.layers.append(Layer(np.zeros(0, dtype=np.int64), self.x[:0]))
            layer = self.layers[at]
            old = len(layer.nodes)
            nodes = np.concatenate([layer.nodes, n + which])
            layer.nodes, layer.x = nodes, _at(self.x, nodes)
            layer.xf = layer.x.astype(np.float32)
            layer.links = np.vstack([layer.links, np.full((len(which), layer.links.shape[1]), -1, dtype=np.int32)])
            there = (walked if at == 0 else starts.get(at, np.full((len(which), 0), -1)))[:, :CANDIDATES]
            among, _ = nearest(layer.xf[old:], layer.xf[old:], CANDIDATES, np.arange(len(which)))
            found = np.hstack([there, np.where(among >= 0, among + old, -1)]).astype(np.int64)
            dist = np.full(found.shape, np.inf, dtype=np.float32)
            row, col = np.nonzero(found >= 0)
            dist[row, col] = apart(layer.xf, row + old, found[row, col])
            order = np.argsort(dist, axis=1, kind="stable")[:, :CANDIDATES]
            layer.connect(np.take_along_axis(found, order, 1), np.take_along_axis(dist, order, 1), self.m, 2 * self.m if at == 0 else self.m, old)
        self._mend()

    def _starts(self, q: np.ndarray, at: int) -> np.ndarray:
        """Local numbers near the queries on an upper level."""
        layer, out = self.layers[at], []
        for a in range(0, len(q), self._block(self.ef)):
            part = q[a : a + self._block(self.ef)]
            start = self._descend(part, at)
            out.append(self._walk(layer, part, np.where(start >= 0, np.searchsorted(layer.nodes, start), -1), self.ef))
        return np.vstack(out)

    def move(self, i: int, x: np.ndarray) -> None:
        """Give the row of the i-th id another vector; where its node was and is its alone, the node keeps its number."""
        vec_id, node = self.ids[i], int(self.node[i])
        n, alone = len(self.x), int((self.node == node).sum()) == 1
        self.add(np.array([vec_id]), np.asarray(x)[None])
        if alone and len(self.x) == n:
            self._renumber(np.insert(np.arange(n - 1), node, n - 1))

    def _renumber(self, order: np.ndarray) -> None:
        """Node order[j] gets the number j."""
        number = np.argsort(order)
        for layer in self.layers:
            nodes = number[layer.nodes]
            by = np.argsort(nodes)
            local = np.append(np.argsort(by), -1)
            layer.nodes, layer.x, layer.xf, layer.links = nodes[by], layer.x[by], layer.xf[by], local[layer.links[by]].astype(np.int32)
        self.entry = int(number[self.entry])
        self._set(self.x[order], self.ids, number[self.node])


def _at(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of x by number; x itself where these are all rows in turn, which most levels 0 and tables without copies are."""
    return x if len(rows) == len(x) and (rows == np.arange(len(x))).all() else x[rows]


def _in_order(answers: Iterator[tuple[int, list]]) -> list[list]:
    return [found for _, found in sorted(answers, key=lambda a: a[0])]


def _anew(layer: Layer, live: np.ndarray, dead: np.ndarray, hit: np.ndarray, most: int) -> np.ndarray:
    """What nodes that linked to dead ones choose among their own links and those of the dead."""
    links = layer.links
    row, col = np.nonzero(dead[hit])
    two = links[links[hit[row], col]]
    who, step = np.nonzero(two >= 0)
    own_row, own_col = np.nonzero(links[hit] >= 0)
    pairs = np.unique(np.concatenate([row[who] * len(live) + two[who, step], own_row * len(live) + links[hit][own_row, own_col]]).astype(np.int64))
    r, c = pairs // len(live), pairs % len(live)
    ok = live[c] & (c != hit[r])
    r, c = r[ok], c[ok]
    d = apart(layer.xf, hit[r], c)
    order = np.lexsort((c, d, r))
    r, c, d = r[order], c[order], d[order]
    first = first_of(r, MEETING)
    r, c, d = r[first], c[first], d[first]
    return diverse(layer.xf, padded(r, c.astype(np.int32), len(hit), -1), padded(r, d, len(hit), np.inf), most)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct vector, in order; the number of each row's vector)."""
    if not len(x):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not x.shape[1]:
        return np.zeros(1, dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    view = np.ascontiguousarray(x).view([("", np.void, x.itemsize * x.shape[1])])["f0"].ravel()
    _, first, inverse = np.unique(view, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first, kind="stable"), kind="stable")
    return np.sort(first), rank[inverse.ravel()]


def _entry(q: np.ndarray, salt: int, n: int) -> int:
    h = int(np.frombuffer(np.round(np.ascontiguousarray(q[:16], dtype=np.float64), 6).tobytes(), np.uint64).sum(dtype=np.uint64)) ^ (salt * 0x9E3779B97F4A7C15)
    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    return (h >> 20) % max(n, 1)
