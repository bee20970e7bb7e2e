"""A layered proximity graph (HNSW) over one shard's vectors, held in memory while it is built or searched.

Follows the published algorithm: greedy descent through sparse upper layers, a beam on the bottom layer, and diversified
neighbour lists. Vectors stay in one matrix, so the distances to all unseen neighbours of a node are one product.
"""

from __future__ import annotations

import heapq

import numpy as np

from tessel.functions.metrics import Metric

#: Fixed values of the index format.
M, M_BOTTOM, EF_BUILD, MAX_LEVEL = 16, 32, 128, 16
_WRAP = (1 << 64) - 1


def level_of(vector_id: int) -> int:
    """A node's layer, from its id alone: SplitMix64, then four zero bits for each layer up."""
    h = (vector_id + 0x9E3779B97F4A7C15) & _WRAP
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _WRAP
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _WRAP
    h ^= h >> 31
    level = 0
    while level < MAX_LEVEL and h & 15 == 0:
        level, h = level + 1, h >> 4
    return level


def levels_of(ids: np.ndarray) -> np.ndarray:
    """The same for many ids at once."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    zeros = np.stack([(h >> np.uint64(4 * i)) & np.uint64(15) == 0 for i in range(16)])
    return np.minimum(np.cumprod(zeros, axis=0).sum(axis=0), MAX_LEVEL).astype(np.int32)


#: Rows that are linked as one block, and numbers that a step of that computes at once: at most, and where a processor's cache is to hold them.
BLOCK, PAIRS, CACHED = 10_000, 2_000_000, 250_000
#: Nodes that diverse_many() takes at once from a list.
RUN = 32
#: An empty place in a beam.
NOWHERE = np.uint64(0xFFFFFFFFFFFFFFFF)


def ordered(distances: np.ndarray) -> np.ndarray:
    """float32 values as integers in the same order; of zeros, neither is the lesser."""
    bits = (distances + np.float32(0)).astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)


class Frozen:
    """A graph as arrays, for searches of many queries at once.

    All queries of a block take their steps together: each expands its nearest node that isn't expanded yet, and the distances
    to all new neighbours of all queries are one product. A beam is a row of integers (distance, node, whether expanded), so sorting a row sorts by
    distance and then node. Every query goes exactly the way it would go alone.
    """

    def __init__(self, metric: Metric, ids: np.ndarray, vectors: np.ndarray, levels: np.ndarray, counts: np.ndarray, links: np.ndarray) -> None:
        """counts has the number of neighbours of each node on each of its layers, by node and layer; links are the neighbours themselves."""
        self.metric, self.ids, self.levels, self.rows = metric, ids, levels, vectors.astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.rows, self.rows))
        n, starts = len(ids), np.concatenate([[0], np.cumsum(levels + 1)]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.links = []
        for layer in range(int(levels.max()) + 1 if n else 0):
            here = np.flatnonzero(levels >= layer)
            slot = starts[here] + layer
            size = counts[slot]
            table = np.full((n, max(1, int(size.max()))), -1, np.int32)
            for j in range(table.shape[1]):
                has = size > j
                table[here[has], j] = links[ends[slot[has]] + j]
            self.links.append(table)
        self.entry = int(np.argmax(levels)) if n else -1

    def faults(self) -> int:
        """How many rules of a sound graph are broken: ids once each, targets that exist and reach the layer, no loops, no repeats, degrees and levels within bounds."""
        n, bad = len(self.ids), 0
        bad += len(np.unique(self.ids)) != n or bool((self.levels < 0).any()) or bool((self.levels > MAX_LEVEL).any())
        for layer, table in enumerate(self.links):
            real = table >= 0
            inside = table < n
            bad += bool((table < -1).any()) + bool(not inside.all()) + (real.sum(axis=1).max() > (M if layer else M_BOTTOM))
            bad += bool((real & (table == np.arange(n)[:, None])).any()) + bool((self.levels[np.where(real & inside, table, 0)][real & inside] < layer).any())
            near = np.sort(table, axis=1)
            bad += bool(((near[:, 1:] == near[:, :-1]) & (near[:, 1:] >= 0)).any())
        return bad

    def distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of each query to each node of its row, as Graph has them."""
        rows = self.rows[nodes]
        if self.metric is Metric.EUCLIDEAN:
            rows = rows - queries[:, None, :]
            return np.sqrt(np.einsum("qmd,qmd->qm", rows, rows)).astype(np.float32)
        products = np.einsum("qmd,qd->qm", rows, queries)
        if self.metric is Metric.DOT_PRODUCT:
            with np.errstate(over="ignore"):
                return -products.astype(np.float32)
        scale = self.norms[nodes] * np.sqrt(np.einsum("qd,qd->q", queries, queries))[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(scale == 0, 1.0, 1.0 - np.clip(products / scale, -1.0, 1.0)).astype(np.float32)

    def walk(self, queries: np.ndarray, entries: np.ndarray, width: int, layer: int) -> np.ndarray:
        """Beams (queries x width) of the nearest nodes that a best-first walk from an entry each finds."""
        table, n = self.links[layer], len(queries)
        beam = np.full((n, width), NOWHERE)
        beam[:, 0] = ordered(self.distances(queries, entries[:, None])[:, 0]) << np.uint64(32) | entries.astype(np.uint64) << np.uint64(1)
        seen = np.zeros((n, len(self.ids)), bool)
        seen[np.arange(n), entries] = True
        live = np.arange(n)
        while len(live):
            own = beam[live]
            open_ = (own & np.uint64(1) == 0) & (own != NOWHERE)
            place = open_.argmax(axis=1)
            go = open_[np.arange(len(live)), place]
            live, own, place = live[go], own[go], place[go]
            if not len(live):
                break
            at = np.arange(len(live))
            node = (own[at, place] >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64)
            own[at, place] |= np.uint64(1)
            near = table[node]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            row, column = np.nonzero(fresh)
            seen[live[row], near[row, column]] = True
            keys = np.full(near.shape, NOWHERE)
            if len(row):
                most = int(fresh.sum(axis=1).max())
                order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
                some = np.take_along_axis(near, order, axis=1)
                ok = np.take_along_axis(fresh, order, axis=1)
                d = self.distances(queries[live], np.where(ok, some, 0))
                keys = np.where(ok, ordered(d) << np.uint64(32) | some.astype(np.uint64) << np.uint64(1), NOWHERE)
                own = np.sort(np.concatenate([own, keys], axis=1), axis=1)[:, :width]
            beam[live] = own
        return beam

    def reached(self) -> np.ndarray:
        """Which nodes the bottom layer's links lead to from the entry."""
        seen = np.zeros(len(self.ids), bool)
        front = np.array([self.entry])
        while len(front):
            seen[front] = True
            front = np.unique(self.links[0][front])
            front = front[(front >= 0) & ~seen[front]]
        return seen

    def search(self, queries: np.ndarray, k: int, ef: int, dead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best k live nodes of each query, best first. dead marks nodes that are routes only; the beam widens by them."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        if not len(self.ids) or k <= 0 or not len(queries):
            return none
        queries = np.asarray(queries, np.float64)
        if max(ef, k) + int(dead.sum()) >= len(self.ids):
            # A beam as wide as the graph leaves out nothing that links lead to, and that is the same for all queries.
            live = np.flatnonzero(self.reached() & ~dead)
            row, place, score = self.metric.nearest(queries, self.rows[live], self.ids[live], k)
            return row, self.ids[live[place]], score
        at = np.full(len(queries), self.entry, np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            at = (self.walk(queries, at, 1, layer)[:, 0] >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        beam = self.walk(queries, at, max(ef, k) + int(dead.sum()), 0)
        node = (beam >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        real = beam != NOWHERE
        ok = real & ~dead[np.where(real, node, 0)]
        ok &= np.cumsum(ok, axis=1) <= k
        row, place = np.nonzero(ok)
        code = (beam[row, place] >> np.uint64(32)).astype(np.uint32)
        d = np.where(code >> 31, code & np.uint32(0x7FFFFFFF), ~code).astype(np.uint32).view(np.float32)
        return row, self.ids[node[row, place]], (-d if self.metric is Metric.DOT_PRODUCT else d).astype(np.float32)


class Graph:
    """Nodes in order of insertion: ids, vectors, levels, and by node and layer the neighbours' positions."""

    def __init__(self, metric: Metric, dim: int) -> None:
        self.metric, self.dim, self.size = metric, dim, 0
        self.ids: list[int] = []
        self.levels: list[int] = []
        self.links: list[list[list[int]]] = []
        self.entry, self.top = -1, 0
        self._unit = metric is Metric.COSINE
        self._rows = np.zeros((16, dim))
        self._norms = np.zeros(16)

    def _push(self, vector) -> int:
        if self.size == len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            self._norms = np.concatenate([self._norms, np.zeros_like(self._norms)])
        self._rows[self.size] = vector
        self._norms[self.size] = np.sqrt(self._rows[self.size] @ self._rows[self.size])
        self.size += 1
        return self.size - 1

    def distances(self, query: np.ndarray, nodes) -> np.ndarray:
        """Less is better, in float32 as scores are; the dot product is negated."""
        rows = self._rows[nodes]
        if self.metric is Metric.EUCLIDEAN:
            return np.sqrt(((rows - query) ** 2).sum(axis=1)).astype(np.float32)
        products = rows @ query
        if self.metric is Metric.DOT_PRODUCT:
            with np.errstate(over="ignore"):
                return -products.astype(np.float32)
        scale = self._norms[nodes] * np.sqrt(query @ query)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(scale == 0, 1.0, 1.0 - np.clip(products / scale, -1.0, 1.0)).astype(np.float32)

    def beam(self, query: np.ndarray, entries: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes that a best-first walk from the entries finds, ascending by (distance, node)."""
        start = self.distances(query, entries)
        seen = np.zeros(self.size, bool)
        seen[entries] = True
        todo = [(float(d), n) for d, n in zip(start, entries, strict=True)]
        heapq.heapify(todo)
        best = [(-d, -n) for d, n in todo]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= width and (d, node) > (-best[0][0], -best[0][1]):
                break
            fresh = [n for n in self.links[node][layer] if not seen[n]]
            if not fresh:
                continue
            seen[fresh] = True
            for e, n in zip(self.distances(query, fresh).tolist(), fresh, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-e, -n))
                elif (e, n) < (-best[0][0], -best[0][1]):
                    heapq.heapreplace(best, (-e, -n))
                else:
                    continue
                heapq.heappush(todo, (e, n))
        return sorted((-d, -n) for d, n in best)

    def mutual(self, nodes: list[int]) -> np.ndarray:
        """Distances of all pairs of nodes, from one matrix product."""
        rows = self._rows[nodes]
        products = rows @ rows.T
        if self.metric is Metric.DOT_PRODUCT:
            with np.errstate(over="ignore"):
                return -products.astype(np.float32)
        norms = self._norms[nodes]
        if self.metric is Metric.EUCLIDEAN:
            # Differences: squares minus products would cancel for near neighbours.
            return np.stack([np.sqrt(((rows - x) ** 2).sum(axis=1)) for x in rows]).astype(np.float32)
        scale = norms[:, None] * norms[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(scale == 0, 1.0, 1.0 - np.clip(products / scale, -1.0, 1.0)).astype(np.float32)

    def diverse(self, ranked: list[tuple[float, int]], limit: int) -> list[int]:
        """Of nodes by distance, those nearer to the point than to any chosen before; passed-over ones fill what is left."""
        nodes = [n for _, n in ranked]
        if len(nodes) <= 1:
            return nodes[:limit]
        table = self.mutual(nodes)
        chosen: list[int] = []
        spare: list[int] = []
        nearest = np.full(len(nodes), np.inf, np.float32)
        for i, (d, n) in enumerate(ranked):
            if len(chosen) == limit:
                break
            if nearest[i] >= d:
                chosen.append(n)
                np.minimum(nearest, table[i], out=nearest)
            else:
                spare.append(n)
        return chosen + spare[: limit - len(chosen)]

    def insert(self, vector_id: int, vector) -> None:
        level, node = level_of(vector_id), self._push(vector)
        query = self._rows[node].copy()
        self.ids.append(vector_id)
        self.levels.append(level)
        self.links.append([[] for _ in range(level + 1)])
        if node == 0:
            self.entry, self.top = 0, level
            return
        at = self.entry
        for layer in range(self.top, level, -1):
            at = self.beam(query, [at], 1, layer)[0][1]
        for layer in range(min(level, self.top), -1, -1):
            limit = M if layer else M_BOTTOM
            found = self.beam(query, [at], EF_BUILD, layer)
            at = found[0][1]
            self.links[node][layer] = self.diverse(found, M if layer else M_BOTTOM)
            for other in self.links[node][layer]:
                own = self.links[other][layer]
                own.append(node)
                if len(own) > limit:
                    near = self.distances(self._rows[other], own).tolist()
                    self.links[other][layer] = self.diverse(sorted(zip(near, own, strict=True)), limit)
        if level > self.top:
            self.entry, self.top = node, level

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all nodes of a to all of b (ascending), or row by row if both are tables."""
        x = self._rows[a]
        # Nodes that follow one another are no copy.
        flat = b.ndim == 1 and len(b) and b[-1] - b[0] + 1 == len(b)
        out = x @ np.swapaxes(x if b is a else self._rows[b[0] : b[-1] + 1] if flat else self._rows[b], -1, -2)
        if self.metric is Metric.DOT_PRODUCT:
            with np.errstate(over="ignore"):
                return np.negative(out, out=out).astype(np.float32)
        m, n = self._norms[a][..., :, None], self._norms[b][..., None, :]
        if self.metric is Metric.EUCLIDEAN:
            both = m * m + n * n
            out *= -2
            out += both
            # Where squares minus products cancel, differences are taken.
            both *= (self.dim + 16) * 2.0**-32
            close = np.nonzero(out <= both)
            left, right = a[close[:-1]], b[(*close[:-2], close[-1])]
            step = max(1, PAIRS // max(1, self.dim))
            for i in range(0, len(left), step):
                d = self._rows[left[i : i + step]] - self._rows[right[i : i + step]]
                out[tuple(c[i : i + step] for c in close)] = np.einsum("ij,ij->i", d, d)
            return np.sqrt(np.maximum(out, 0, out=out), out=out).astype(np.float32)
        # A norm of zero makes products of zero, and so a distance of 1.
        with np.errstate(invalid="ignore", divide="ignore"):
            out *= np.where(m == 0, 0.0, 1.0 / m)
            out *= np.where(n == 0, 0.0, 1.0 / n)
            return np.subtract(1.0, np.clip(out, -1.0, 1.0, out=out), out=out).astype(np.float32)

    def diverse_many(self, nodes: np.ndarray, distances: np.ndarray, limit: int) -> np.ndarray:
        """diverse() of each row of nodes, ascending by distance; -1 stands for no node, behind the others and in the result.

        Nodes are gone through in runs: those of a run meet each other and what is chosen before it, and rows that have chosen enough are done.
        """
        n, width = nodes.shape
        out = np.full((n, limit), -1, np.int64)
        step = max(1, min(256, CACHED // max(1, RUN * max(RUN, limit, self.dim))))
        for s in range(0, n, step):
            some, d = nodes[s : s + step], distances[s : s + step]
            real, chosen, count = some >= 0, np.zeros(some.shape, bool), np.zeros(len(some), np.int64)
            held = np.zeros((len(some), limit), np.int64)
            live = np.arange(len(some))
            for start in range(0, width, RUN):
                live = live[(count[live] < limit) & real[live, start]]
                if not len(live):
                    break
                run = np.maximum(some[live, start : start + RUN], 0)
                nearest, table = np.full(run.shape, np.inf, np.float32), self.between(run, run)
                most = int(count[live].max())
                if most:
                    before = self.between(held[live, :most], run)
                    before[np.arange(most) >= count[live, None]] = np.inf
                    nearest = before.min(axis=1)
                for i in range(run.shape[1]):
                    go = np.flatnonzero(real[live, start + i] & (nearest[:, i] >= d[live, start + i]) & (count[live] < limit))
                    at = live[go]
                    chosen[at, start + i] = True
                    held[at, count[at]] = run[go, i]
                    count[at] += 1
                    nearest[go] = np.minimum(nearest[go], table[go, i])
            order = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :limit]
            out[s : s + step, : order.shape[1]] = np.take_along_axis(some, order, axis=1)
        return out

    def insert_many(self, ids, vectors) -> None:
        """insert() for many rows at once: a row's candidates on a layer are its EF_BUILD nearest of the nodes before it, found by matrix products, and each
        neighbour's list is cut once for all rows of a block. Work grows with the rows times the nodes, so a graph is to be bounded."""
        ids = [int(i) for i in ids]
        levels, done = levels_of(np.array(ids, np.int64)).tolist(), 0
        vectors = list(vectors)
        if len(vectors) != len(ids):
            raise ValueError("as many vectors as ids")
        while done < len(ids):
            size = min(len(ids) - done, BLOCK)
            first = self.size
            for i in range(done, done + size):
                self._push(vectors[i])
            self.ids += ids[done : done + size]
            self.levels += levels[done : done + size]
            self.links += [[[] for _ in range(x + 1)] for x in levels[done : done + size]]
            done += size
            level = np.array(self.levels)
            for layer in range(int(level[first:].max()) + 1):
                self._link(np.flatnonzero(level >= layer), first, layer)
        if self.size:
            self.top = max(self.levels)
            self.entry = self.levels.index(self.top)

    def _nearest_before(self, own: np.ndarray, members: np.ndarray, near: np.ndarray, d: np.ndarray) -> None:
        """Put into each row of near and d the nearest members that come before its node, ascending by (distance, node). Both own and members ascend."""
        before = members[: np.searchsorted(members, own[-1])]
        if not len(before):
            return
        found = self.between(own, before)
        found[before[None, :] >= own[:, None]] = np.inf
        width = min(near.shape[1], len(before))
        row, column = np.nonzero(found <= np.partition(found, width - 1, axis=1)[:, width - 1 :][:, :1])
        real = before[column] < own[row]
        row, column = row[real], column[real]
        keys = ordered(found[row, column]) << np.uint64(32) | before[column].astype(np.uint64)
        order = np.lexsort((keys, row))
        row, column = row[order], column[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, column, place = (x[place < width] for x in (row, column, place))
        near[row, place], d[row, place] = before[column], found[row, column]

    def _link(self, members: np.ndarray, first: int, layer: int) -> None:
        """Link the members of a layer from node ``first`` on."""
        limit, fresh = M if layer else M_BOTTOM, members[members >= first]
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, CACHED // len(members))
        for s in range(0, len(fresh), BLOCK):
            some = fresh[s : s + BLOCK]
            width = min(EF_BUILD, int(np.searchsorted(members, some[-1])))
            if not width:
                continue
            near, d = np.full((len(some), width), -1, np.int64), np.full((len(some), width), np.inf, np.float32)
            for i in range(0, len(some), step):
                self._nearest_before(some[i : i + step], members, near[i : i + step], d[i : i + step])
            own = some
            chosen = self.diverse_many(near, d, limit)
            for node, row in zip(own.tolist(), chosen.tolist(), strict=True):
                self.links[node][layer] = [x for x in row if x >= 0]
            row, column = np.nonzero(chosen >= 0)
            ends.append((chosen[row, column], own[row]))
        if not ends:
            return
        other, node = (np.concatenate(x) for x in zip(*ends, strict=True))
        order = np.argsort(other, kind="stable")
        other, node = other[order], node[order]
        at, starts = np.unique(other, return_index=True)
        full = []
        for x, i, j in zip(at.tolist(), starts.tolist(), [*starts[1:].tolist(), len(other)], strict=True):
            own = self.links[x][layer]
            own += node[i:j].tolist()
            if len(own) > limit:
                full.append((len(own), x))
        full.sort()
        while full:
            # Lists of about one length are cut together.
            width = full[-1][0]
            start = next(i for i in range(max(0, len(full) - max(1, PAIRS // width)), len(full)) if 2 * full[i][0] >= width)
            some, full = np.array([x for _, x in full[start:]]), full[:start]
            lists = np.full((len(some), width), -1, np.int64)
            for i, x in enumerate(some.tolist()):
                lists[i, : len(self.links[x][layer])] = self.links[x][layer]
            rows = max(1, PAIRS // (width * self.dim))
            d = np.concatenate([self.between(some[i : i + rows, None], np.maximum(lists[i : i + rows], 0))[:, 0] for i in range(0, len(some), rows)])
            d[lists < 0] = np.inf
            order = np.lexsort((lists, d, lists < 0), axis=1)
            cut = self.diverse_many(np.take_along_axis(lists, order, axis=1), np.take_along_axis(d, order, axis=1), limit)
            for x, row in zip(some.tolist(), cut.tolist(), strict=True):
                self.links[x][layer] = [y for y in row if y >= 0]

    def connect(self) -> None:
        """Link what the bottom layer's links don't lead to from the entry: cutting lists can take a node's last incoming link. Such a node takes a place in
        the list of the nearest node that has one to give, where no link of the tree by which others are reached is replaced, so degrees stay bounded."""
        if not self.size:
            return
        seen = np.zeros(self.size, bool)
        tree: list[set[int]] = [set() for _ in range(self.size)]

        def spread(start: int) -> None:
            seen[start], todo = True, [start]
            for x in todo:
                for y in self.links[x][0]:
                    if not seen[y]:
                        seen[y] = True
                        tree[x].add(y)
                        todo.append(y)

        spread(self.entry)
        for lost in np.flatnonzero(~seen).tolist():
            if seen[lost]:
                continue
            reached = np.flatnonzero(seen)
            d = self.between(np.array([lost]), reached)[0]
            for x in reached[np.argsort(d, kind="stable")].tolist():
                own = self.links[x][0]
                if len(own) < M_BOTTOM:
                    own.append(lost)
                else:
                    spare = [i for i, y in enumerate(own) if y not in tree[x]]
                    if not spare:
                        continue
                    far = self.distances(self._rows[x], [own[i] for i in spare])
                    own[spare[int(far.argmax())]] = lost
                tree[x].add(lost)
                break
            spread(lost)

    def search(self, query, k: int, ef: int, deleted: set[int] | None = None) -> list[tuple[int, float]]:
        """(id, score), best first. The beam widens by the deleted nodes, which serve as routes only."""
        if not self.size or k <= 0:
            return []
        query, gone, at = np.asarray(query, np.float64), deleted or set(), self.entry
        for layer in range(self.top, 0, -1):
            at = self.beam(query, [at], 1, layer)[0][1]
        hidden = sum(i in gone for i in self.ids) if gone else 0
        found = self.beam(query, [at], min(max(ef, k) + hidden, self.size), 0)
        live = [(self.ids[n], -d if self.metric is Metric.DOT_PRODUCT else d) for d, n in found if self.ids[n] not in gone]
        return live[:k]

    def packed(self) -> dict[str, np.ndarray]:
        """ids, levels, vectors (float32, one behind the other), counts and links; see Frozen."""
        lists = [x for layers in self.links for x in layers]
        counts = np.array([len(x) for x in lists], np.int32)
        links = np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
        return {"ids": np.array(self.ids, np.int64), "levels": np.array(self.levels, np.int32), "vectors": self._rows[: self.size].astype(np.float32).ravel(), "counts": counts, "links": links}

    @classmethod
    def unpacked(cls, metric: Metric, dim: int, ids, levels, vectors, counts, links) -> Graph:
        """The graph again, ready for further nodes."""
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        each = [links[i:j].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)]
        starts = np.concatenate([[0], np.cumsum(levels + 1)]).astype(np.int64)
        return cls.restore(metric, ids.tolist(), vectors.reshape(-1, dim), levels.tolist(), [each[i:j] for i, j in zip(starts[:-1], starts[1:], strict=True)])

    @classmethod
    def restore(cls, metric: Metric, ids, vectors, levels, links) -> Graph:
        """A graph from its stored parts, in order of insertion."""
        graph = cls(metric, len(vectors[0]) if len(vectors) else 1)
        for v in vectors:
            graph._push(v)
        graph.ids, graph.levels, graph.links = list(ids), list(levels), [list(map(list, x)) for x in links]
        if graph.size:
            graph.top = max(graph.levels)
            graph.entry = graph.levels.index(graph.top)
        return graph
