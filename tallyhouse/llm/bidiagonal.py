"""Singular values and right singular vectors of a small upper triangle, by bidiagonal qd transforms.

Householder reflections make the triangle bidiagonal. The dqds transform finds its squared singular values, each to high relative
accuracy since nothing is subtracted but the shifts. A twisted factorisation of the tridiagonal matrix less one of these values gives the vector:
it joins the factors from above and from below where their pivots leave least, so that one vector of the solution costs as many steps as the matrix has rows.
Values closer together than ``GAP`` share one factorisation: a few block inverse iterations with it and a small projected problem separate
them as far as the numbers allow. Sizes here are the dimension of the vectors, never their number.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
TINY = 1e-290
GAP = 1e-4
MOST_SWEEPS = 60  # per value; a few are usual


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal, and the reflections from the right: one vector per step, of which the first entries are zero."""
    a = np.array(r, dtype=float)
    n = a.shape[1]
    right = []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if not size:
            return None
        v = x / size
        v[0] += np.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for i in range(n):
        v = reflector(a[i:, i].copy())
        if v is not None:
            a[i:, i:] -= 2 * np.outer(v, v @ a[i:, i:])
        v = reflector(a[i, i + 1:].copy()) if i < n - 2 else None
        full = np.zeros(n)
        if v is not None:
            a[i:, i + 1:] -= 2 * np.outer(a[i:, i + 1:] @ v, v)
            full[i + 1:] = v
        right.append(full)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], float, int]:
    """One transform with shift ``s``: new q and e, the least pivot, and where the first negative pivot is (or -1)."""
    n = len(q)
    d = q[0] - s
    new_q, new_e, least, failed = [0.0] * n, [0.0] * (n - 1), d, -1
    for i in range(n - 1):
        if d < 0 and failed < 0:
            failed = i
            return new_q, new_e, d, failed
        total = d + e[i]
        new_q[i] = total
        if e[i] == 0.0 or total == 0.0:  # decoupled here
            d = q[i + 1] - s
        else:
            ratio = q[i + 1] / total
            new_e[i] = e[i] * ratio
            d = d * ratio - s
        least = min(least, d)
    new_q[n - 1] = d
    return new_q, new_e, least, n - 1 if d < 0 else -1


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """All of them, falling."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not scale:
        return np.zeros(len(diagonal))
    q, e = [float(x) ** 2 for x in diagonal / scale], [float(x) ** 2 for x in above / scale]
    found, shifted, sweeps = [], 0.0, 0
    while q:
        n = len(q)
        if n == 1:
            found.append(q.pop() + shifted)
            break
        if e[-1] <= (EPS / 4) ** 2 * (shifted + q[-1]) or e[-1] <= TINY:
            found.append(q.pop() + shifted)
            e.pop()
            sweeps = 0
            continue
        if 1.5 * q[0] < q[-1]:
            q.reverse()
            e.reverse()
        sweeps += 1
        if sweeps > MOST_SWEEPS * n:
            raise ArithmeticError("qd transforms do not converge")
        # The last two rows bound the least value from above; a late failure then tells a bound from below.
        x, y, z = q[-2] + (e[-2] if n > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
        half = (x - y) / 2
        root = y - z / (abs(half) + (half * half + z) ** 0.5) if half > 0 else (x * y - z) / ((x + y) / 2 + (half * half + z) ** 0.5)
        shift = max(0.0, min(root, q[-1]) * (1 - 1e-10))
        for attempt in range(5):
            new_q, new_e, least, failed = _dqds(q, e, shift)
            if failed < 0:
                break
            shift = max(0.0, (shift + least) * (1 - 4 * EPS)) if failed == n - 1 and shift + least > 0 and attempt < 2 else shift / 8 if attempt < 3 else 0.0
        q, e, shifted = [max(x, 0.0) for x in new_q], new_e, shifted + shift
    return np.sort(np.array(found))[::-1] * scale**2


class Twisted:
    """Twisted factorisation of the tridiagonal matrix B'B less a shift."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, shift: float):
        n = self.n = len(diagonal)
        least = EPS * max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0)) or TINY
        a = np.where(np.abs(diagonal) < TINY, least, diagonal)
        d, m = a * a, above / a[:-1]
        guard = lambda x: x if abs(x) > TINY else TINY
        self.down, self.down_pivot, from_above = np.zeros(n - 1), np.zeros(n), np.zeros(n)
        s = -shift
        for i in range(n - 1):
            from_above[i] = s
            self.down_pivot[i] = guard(s + d[i])
            self.down[i] = d[i] * m[i] / self.down_pivot[i]
            s = self.down[i] * m[i] * s - shift
        from_above[n - 1] = s
        self.down_pivot[n - 1] = guard(s + d[n - 1])
        self.up, self.up_pivot, gamma = np.zeros(n - 1), np.zeros(n), np.zeros(n)
        p = d[n - 1] - shift
        gamma[n - 1] = from_above[n - 1] + d[n - 1]
        for i in range(n - 2, -1, -1):
            self.up_pivot[i + 1] = guard(d[i] * m[i] ** 2 + p)
            ratio = d[i] / self.up_pivot[i + 1]
            self.up[i] = m[i] * ratio
            gamma[i] = from_above[i] + p * ratio
            p = p * ratio - shift
        self.at = int(np.argmin(np.abs(gamma)))
        self.pivots = np.r_[self.down_pivot[:self.at], guard(gamma[self.at]), self.up_pivot[self.at + 1:]]

    def solve(self, v: np.ndarray) -> np.ndarray:
        n, r = self.n, self.at
        y = np.array(v, dtype=float)
        for i in range(1, r + 1):
            y[i] -= self.down[i - 1] * y[i - 1]
        for i in range(n - 2, r - 1, -1):
            y[i] -= self.up[i] * y[i + 1]
        y /= self.pivots
        return self._spread(y)

    def vector(self) -> np.ndarray:
        """The solution for the unit vector at the twist, up to its length."""
        y = np.zeros(self.n)
        y[self.at] = 1.0
        z = self._spread(y)
        return z / np.linalg.norm(z)

    def _spread(self, y: np.ndarray) -> np.ndarray:
        for i in range(self.at - 1, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        for i in range(self.at, self.n - 1):
            y[i + 1] -= self.up[i] * y[i]
        return y


def _times(diagonal: np.ndarray, above: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = diagonal[:, None] * x
    out[:-1] += above[:, None] * x[1:]
    return out


def _times_transposed(diagonal: np.ndarray, above: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = diagonal[:, None] * x
    out[1:] += above[:, None] * x[:-1]
    return out


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values and right singular vectors (columns) of the ``k`` largest, fewer if the rank is less.

    Of each vector the entry largest in size is positive.
    """
    n = r.shape[1]
    diagonal, above, right = bidiagonal(r)
    values = squared_singular_values(diagonal, above)
    # Rounding of the blocks leaves about this much where the rank is less.
    k = min(k, int((values > (8 * n * EPS) ** 2 * values[0]).sum())) if n and values[0] > 0 else 0
    vectors = np.zeros((n, 0))
    first = 0
    while first < k:
        last = first + 1
        while last < n and values[last - 1] - values[last] <= GAP * values[last - 1]:
            last += 1
        if last - first == 1:
            found = Twisted(diagonal, above, values[first]).vector()[:, None]
        else:
            # A shift a little beyond the values, so that it is about as near to each of them and all grow alike.
            width = values[first] - values[last - 1]
            factors = Twisted(diagonal, above, values[first] + max(width / 10, 1e-8 * values[first]))
            found = np.random.default_rng(first).standard_normal((n, last - first))
            for _ in range(40):
                found = np.stack([factors.solve(x) for x in found.T], axis=1)
                found /= np.abs(found).max(axis=0)
                found -= vectors @ (vectors.T @ found)
                found = np.linalg.qr(found)[0]
                product = _times(diagonal, above, found)
                whole = _times_transposed(diagonal, above, product)
                if np.abs(whole - found @ (product.T @ product)).max() <= 8 * n * EPS * values[0]:
                    break
            found = found @ np.linalg.eigh(product.T @ product)[1][:, ::-1]
        vectors = np.c_[vectors, found]
        first = last
    vectors = vectors[:, :k]
    for v in reversed(right):
        vectors = vectors - 2 * np.outer(v, v @ vectors)
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if k else np.zeros(0)
    return values[:k], vectors * sign
