"""Gradient-boosted regression trees on binned columns for a yes/no target: a few thousand rows, fitted on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees as full binary arrays: column and threshold per inner node, a value per leaf."""

    base: float
    depth: int
    columns: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of yes."""
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for columns, limits, values in zip(self.columns, self.limits, self.values, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (rows[every, columns[at]] > limits[at])
            total += values[at - len(columns)]
        return total


def fit(rows: np.ndarray, target: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0) -> Boosted:
    """Logistic loss, second-order gains, equal-frequency bins; ``least`` damps leaves of little weight."""
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, c], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in range(width)]
    coded = np.stack([np.searchsorted(e, rows[:, c], side="left") for c, e in enumerate(edges)], 1)
    mean = min(max(target.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))), depth)
    total = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, weight = target - p, np.maximum(p * (1 - p), 1e-6)
        columns, limits = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            for c, e in enumerate(edges):
                if not len(e):
                    continue
                size = len(e) + 1
                cell = (at - first) * size + coded[:, c]
                g = np.bincount(cell, slope, count * size).reshape(count, size).cumsum(1)
                h = np.bincount(cell, weight, count * size).reshape(count, size).cumsum(1)
                left_g, left_h, all_g, all_h = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = left_g**2 / (left_h + least) + (all_g - left_g) ** 2 / (all_h - left_h + least) - all_g**2 / (all_h + least)
                where = gain.argmax(1)
                top = gain[np.arange(count), where]
                better = top > best
                best[better] = top[better]
                columns[first : first + count][better] = c
                limits[first : first + count][better] = e[where[better]]
            at = 2 * at + 1 + (rows[np.arange(n), columns[at]] > limits[at])
        leaf = at - inner
        g, h = np.bincount(leaf, slope, 2**depth), np.bincount(leaf, weight, 2**depth)
        values = rate * g / (h + least)
        total += values[leaf]
        model.columns.append(columns)
        model.limits.append(limits)
        model.values.append(values)
    return model
