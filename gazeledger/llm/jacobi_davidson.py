"""Largest eigenpairs of a symmetric matrix that is only known by its products (operator 13): block Jacobi-Davidson.

A subspace is projected (Rayleigh-Ritz); Ritz pairs whose residual has reached double precision are locked and kept out of
it; for the others the correction equation

    (I - P P') (A - theta I) (I - P P') t = -r,   P = locked and Ritz vectors

is solved by some steps of MINRES, and the corrections widen the subspace. All pairs advance together, so one pass over
the data serves the products of every vector of a step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]
INNER_STEPS, GUARD, ROUNDS = 8, 4, 60
PRECISION = 64 * np.finfo(float).eps  # of the largest eigenvalue


def _orthonormal(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``vectors`` add to the orthonormal ``against``; twice, as once loses digits."""
    out = np.zeros((len(vectors), 0))
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(2):
            v = v - against @ (against.T @ v)
            v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            out = np.column_stack([out, v])
    return out


def minres(product: Product, shifts: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Columns t of (A - shift) t = right after ``steps`` of MINRES, each column for itself; one product serves all.

    A column whose Krylov space is used up stays as it is.
    """
    shape = right.shape
    x, w, w_old = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    beta = np.linalg.norm(right, axis=0)
    v_old, v = np.zeros(shape), np.divide(right, beta, out=np.zeros(shape), where=beta > 0)
    eta, c, c_old = beta.copy(), np.ones(shape[1]), np.ones(shape[1])
    s, s_old = np.zeros(shape[1]), np.zeros(shape[1])
    tiny, live, carried = 1e-14 * (beta + 1e-300), beta > 0, np.zeros(shape[1])
    scale = np.abs(shifts) + 1e-300
    for _ in range(steps):
        if not live.any():
            break
        y = product(v) - v * shifts
        alpha = (v * y).sum(axis=0)
        y = y - v * alpha - v_old * carried
        beta_new = np.linalg.norm(y, axis=0)
        # two old rotations on the new column of the tridiagonal matrix, then one that clears its last entry
        delta, gamma = c * alpha - c_old * s * carried, np.hypot(c * alpha - c_old * s * carried, beta_new)
        upper, top = s * alpha + c_old * c * carried, s_old * carried
        live = live & (gamma > 1e-14 * scale)
        safe = np.where(live, gamma, 1.0)
        c_new, s_new = delta / safe, beta_new / safe
        w_new = (v - w_old * top - w * upper) / safe
        x = x + np.where(live, c_new * eta, 0.0) * w_new
        eta = -s_new * eta
        live = live & (beta_new > 1e-14 * scale) & (np.abs(eta) > tiny)
        v_old, v = v, np.where(live, np.divide(y, beta_new, out=np.zeros(shape), where=beta_new > 0), 0.0)
        w_old, w, c_old, c, s_old, s, carried = w, w_new, c, c_new, s, s_new, beta_new
    return x


def largest_pairs(product: Product, size: int, wanted: int, seed: int = 13, widest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, with unit eigenvectors as columns, of a symmetric ``size`` x ``size`` matrix.

    Pairs are locked once their residual is below ``PRECISION`` of the largest value. The search ends when the largest
    ones of all locked and Ritz values are locked, so that none that is found late is missed; if rounding in the product
    keeps residuals above that, the smallest reached within ``ROUNDS`` rounds is what counts. Multiple eigenvalues give
    some orthonormal vectors of their space.
    """
    wanted = min(wanted, size)
    widest = min(size, widest or 4 * wanted + GUARD)
    values, locked = np.zeros(0), np.zeros((size, 0))
    base = _orthonormal(np.random.default_rng(seed).standard_normal((size, min(size, wanted + GUARD))), locked)
    images = product(base)
    largest = 0.0
    for _ in range(ROUNDS):
        small = base.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        largest = max(largest, float(theta[0]) if len(theta) else 0.0, float(values.max(initial=0.0)))
        ritz, ritz_images = base @ turn, images @ turn
        residuals = ritz_images - ritz * theta
        residuals -= locked @ (locked.T @ residuals)
        good = np.linalg.norm(residuals, axis=0) <= PRECISION * max(largest, 1e-300)
        # pairs that may still be among the wanted ones
        limit = np.sort(np.concatenate([values, theta]))[::-1][: wanted][-1]
        asked = np.flatnonzero(theta >= limit)[: wanted]
        take = asked[good[asked]]
        values, locked = np.concatenate([values, theta[take]]), np.column_stack([locked, ritz[:, take]])
        left = np.setdiff1d(np.arange(len(theta)), take)
        asked = asked[~good[asked]]
        if not len(asked):
            break
        open_theta, open_ritz, open_residuals = theta[asked], ritz[:, asked], residuals[:, asked]
        keep = left if len(left) + len(asked) <= widest else left[: max(1, min(len(left), wanted + GUARD))]
        base, images = ritz[:, keep], ritz_images[:, keep]
        fixed = _orthonormal(np.column_stack([locked, open_ritz]), np.zeros((size, 0)))

        def projected(v: np.ndarray, fixed: np.ndarray = fixed) -> np.ndarray:
            y = product(v - fixed @ (fixed.T @ v))
            return y - fixed @ (fixed.T @ y)

        steps = min(INNER_STEPS, size - fixed.shape[1])
        right = open_residuals - fixed @ (fixed.T @ open_residuals)
        more = minres(projected, open_theta, -right, steps) if steps > 0 else -right
        more = _orthonormal(more, np.column_stack([locked, base]))
        if not more.shape[1]:  # corrections inside the subspace: widen it anyway, or refresh its images
            more = _orthonormal(np.random.default_rng(seed + base.shape[1]).standard_normal((size, len(asked))), np.column_stack([locked, base]))
        if more.shape[1]:
            base, images = np.column_stack([base, more]), np.column_stack([images, product(more)])
        else:
            base = _orthonormal(base, locked)
            images = product(base)
    rest = _unlocked(values, theta, ritz, wanted, take)
    values, locked = np.concatenate([values, rest[0]]), np.column_stack([locked, rest[1]])
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], locked[:, order]


def _unlocked(values: np.ndarray, theta: np.ndarray, ritz: np.ndarray, wanted: int, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the last Ritz pairs, to fill up to ``wanted``."""
    left = np.setdiff1d(np.arange(len(theta)), taken)[: max(0, wanted - len(values))]
    return theta[left], ritz[:, left]
