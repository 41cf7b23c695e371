"""A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors at a time in numpy."""

from __future__ import annotations

import numpy as np

LINKS, TOP_LINKS = 32, 16
BUILD_BEAM = 48
BATCH = 256
EXACT_LAYER = 512
STEP = 4  # nodes opened per query and step
CLOSEST = 96  # considered when a full node drops neighbours


class Graph:
    """``layers[l]`` holds the neighbours (-1 pads) of the first ``len(layers[l])`` vectors; layer 0 holds all."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @staticmethod
    def order(count: int, seed: int = 1) -> np.ndarray:
        """A random order; a vector's place decides up to which layer it belongs."""
        return np.random.default_rng(seed).permutation(count)

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """``vectors``: float32 rows of unit length in a random order."""
        sizes = [len(vectors)]
        while sizes[-1] > EXACT_LAYER:
            sizes.append(max(EXACT_LAYER // 4, sizes[-1] // TOP_LINKS))
        graph = cls(vectors, [np.zeros((0, LINKS), np.int32) for _ in sizes])
        for layer in range(len(sizes) - 1, -1, -1):
            graph._fill(layer, sizes[layer], sizes[layer + 1] if layer + 1 < len(sizes) else sizes[layer])
        return graph

    def _fill(self, layer: int, size: int, known: int) -> None:
        """Insert in batches; the first ``known`` vectors, which stand in upper layers too, see all earlier ones."""
        width = LINKS if layer == 0 else TOP_LINKS
        links = np.full((size, 2 * width), -1, np.int32)  # full nodes drop half of their neighbours at a time
        self.layers[layer] = links[:0]
        first = 0
        while first < size:
            last = min(size, first + BATCH)
            batch = np.arange(first, last)
            inner = self.vectors[batch] @ self.vectors[batch].T
            inner[np.triu_indices(len(batch))] = -2  # a vector sees those before it
            if first < known:
                outer = self.vectors[batch] @ self.vectors[:first].T
                ids = np.broadcast_to(np.arange(first, dtype=np.int64), outer.shape)
            else:
                ids, outer = self.search(self.vectors[batch], BUILD_BEAM, layer)
            near = np.concatenate([outer, inner], 1)
            ids = np.concatenate([ids, np.broadcast_to(batch, inner.shape)], 1)
            near = np.where(ids < 0, -2, near)
            if near.shape[1] > BUILD_BEAM:
                top = np.argpartition(-near, BUILD_BEAM - 1, 1)[:, :BUILD_BEAM]
                near, ids = np.take_along_axis(near, top, 1), np.take_along_axis(ids, top, 1)
            links[batch, :width] = self._diverse(near, ids, width)
            self._link_back(links, batch, width)
            self.layers[layer] = links[:last]
            first = last
        self._prune(links, np.flatnonzero(links[:, width] >= 0), width)
        self.layers[layer] = np.ascontiguousarray(links[:, :width])

    def _diverse(self, near: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
        """Per row up to ``width`` ids: first those closer to the row's vector than to any id taken, then the closest."""
        order = np.argsort(-near, 1, kind="stable")
        near, ids = np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)
        there = near > -1.5
        rows, columns = near.shape
        if columns <= width:
            out = np.full((rows, width), -1, np.int32)
            out[:, :columns] = np.where(there, ids, -1)
            return out
        own = self.vectors[np.where(there, ids, 0)]
        between = own @ own.transpose(0, 2, 1)
        taken = np.zeros((rows, columns), bool)
        crowd = np.full((rows, columns), -2.0, np.float32)  # closeness to the nearest taken id
        count = np.zeros(rows, np.int64)
        for c in range(columns):
            take = there[:, c] & (near[:, c] > crowd[:, c]) & (count < width)
            taken[:, c] = take
            count += take
            crowd = np.where(take[:, None], np.maximum(crowd, between[:, :, c]), crowd)
        rank = np.where(taken, 0, np.where(there, 1, 2))
        pick = np.argsort(rank, 1, kind="stable")[:, :width]
        out = np.take_along_axis(ids, pick, 1)
        return np.where(np.take_along_axis(there, pick, 1), out, -1).astype(np.int32)

    def _link_back(self, links: np.ndarray, batch: np.ndarray, width: int) -> None:
        to = links[batch, :width]
        source, target = np.repeat(batch, width)[to.ravel() >= 0], to.ravel()[to.ravel() >= 0].astype(np.int64)
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        inside = (links[target] == source[:, None]).any(1)
        source, target = source[~inside], target[~inside]
        if not len(target):
            return
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        used = (links[nodes] >= 0).sum(1)
        over = used + count > links.shape[1]
        place = used.repeat(count) + np.arange(len(target)) - start.repeat(count)
        simple = ~over.repeat(count)
        links[target[simple], place[simple]] = source[simple]
        full = nodes[over]
        if len(full):
            self._prune(links, full, width, np.split(source[~simple], np.cumsum(count[over])[:-1]))

    def _prune(self, links: np.ndarray, nodes: np.ndarray, width: int, more: list[np.ndarray] | None = None) -> None:
        """Bring nodes down to ``width`` diverse neighbours, out of those they have and ``more``."""
        for lo in range(0, len(nodes), 512):
            some = nodes[lo : lo + 512]
            ids = links[some].astype(np.int64)
            if more:
                extra = more[lo : lo + 512]
                added = np.full((len(some), max(map(len, extra))), -1, np.int64)
                for i, x in enumerate(extra):
                    added[i, : len(x)] = x
                ids = np.concatenate([ids, added], 1)
            near = np.einsum("ij,ikj->ik", self.vectors[some], self.vectors[np.maximum(ids, 0)])
            near = np.where(ids >= 0, near, np.float32(-2))
            if ids.shape[1] > CLOSEST:
                top = np.argpartition(-near, CLOSEST - 1, 1)[:, :CLOSEST]
                near, ids = np.take_along_axis(near, top, 1), np.take_along_axis(ids, top, 1)
            links[some] = -1
            links[some, :width] = self._diverse(near, ids, width)

    def _entry(self, queries: np.ndarray, above: int) -> np.ndarray:
        """The nearest vector found from the top layer down to layer ``above``."""
        top = len(self.layers) - 1
        if top < above or not len(self.layers[top]):
            return np.zeros(len(queries), np.int64)
        best = (queries @ self.vectors[: len(self.layers[top])].T).argmax(1)
        for layer in range(top - 1, above - 1, -1):
            best = self._beam(queries, best, 8, layer)[0][:, 0]
        return best

    def search(self, queries: np.ndarray, beam: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``beam`` nearest found per query, nearest first; -1 and -2 pad."""
        if not len(self.layers[layer]):
            return np.full((len(queries), 1), -1, np.int64), np.full((len(queries), 1), -2.0, np.float32)
        parts = [self._beam(queries[lo : lo + BATCH], self._entry(queries[lo : lo + BATCH], layer + 1), beam, layer) for lo in range(0, len(queries), BATCH)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _beam(self, queries: np.ndarray, entry: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        links = self.layers[layer]
        n, size = len(queries), len(links)
        ids = np.full((n, beam), -1, np.int64)
        near = np.full((n, beam), -2.0, np.float32)
        opened = np.zeros((n, beam), bool)
        seen = np.zeros((n, size), bool)
        ids[:, 0] = np.minimum(entry, size - 1)
        near[:, 0] = np.einsum("ij,ij->i", queries, self.vectors[ids[:, 0]])
        seen[np.arange(n), ids[:, 0]] = True
        active = np.arange(n)
        while len(active):
            waits = (ids[active] >= 0) & ~opened[active]
            busy = waits.any(1)
            active, waits = active[busy], waits[busy]
            if not len(active):
                break
            pick = np.argsort(~waits, 1, kind="stable")[:, :STEP]  # rows are sorted, so the nearest unopened ones
            real = np.take_along_axis(waits, pick, 1)
            opened[active[:, None], pick] |= real
            node = np.where(real, np.take_along_axis(ids[active], pick, 1), 0)
            fresh = np.where(real[:, :, None], links[node], -1).reshape(len(active), -1).astype(np.int64)
            fresh.sort(1)
            new = fresh >= 0
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            new &= ~seen[active[:, None], np.maximum(fresh, 0)]
            row, column = np.nonzero(new)
            if not len(row):
                continue
            node = fresh[row, column]
            seen[active[row], node] = True
            cosines = np.einsum("ij,ij->i", queries[active[row]], self.vectors[node])
            worst = near[active[row], beam - 1]
            good = cosines > worst
            row, node, cosines = row[good], node[good], cosines[good]
            changed = np.unique(row)
            if not len(changed):
                continue
            count = np.bincount(row, minlength=len(active))
            place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            extra = np.full((len(active), int(count.max())), -1, np.int64), np.full((len(active), int(count.max())), -2.0, np.float32)
            extra[0][row, place], extra[1][row, place] = node, cosines
            own = active[changed]
            all_near = np.concatenate([near[own], extra[1][changed]], 1)
            all_ids = np.concatenate([ids[own], extra[0][changed]], 1)
            all_open = np.concatenate([opened[own], np.zeros(extra[0][changed].shape, bool)], 1)
            order = np.argsort(-all_near, 1, kind="stable")[:, :beam]
            near[own] = np.take_along_axis(all_near, order, 1)
            ids[own] = np.take_along_axis(all_ids, order, 1)
            opened[own] = np.take_along_axis(all_open, order, 1)
        return ids, near
