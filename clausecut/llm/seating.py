r"""Chinese-restaurant seating of many (dish, restaurant) pairs at once, by numbers of tables.

How c customers of one dish sit at t tables is summed out: with discount d there are S(c, t) ways, weighed by the
generalized Stirling numbers, S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t). A Gibbs step takes all customers of a pair out
and draws the number of tables they sit at anew: exactly, over all t, for up to TABLE customers; by Metropolis-Hastings
steps of all sizes, from where they sat, for more. There log S comes from a saddle point of its generating function
((1 - (1 - x)^d) / d)^t / t!, set right at c = TABLE; its steps from t to t + 1 are right to 0.01.

Random numbers are hashes of what is drawn (the dish, the restaurant, the sweep), so a result does not depend on how
pairs are dealt to workers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Discounts and strengths of the context restaurants and of the parent; sweeps before the samples, and samples.
D, THETA, D1, THETA1 = 0.75, 1.0, 0.8, 1.0
BURN_IN, SAMPLES = 3, 3
#: Customers of exact draws, steps of the others, and places looked at together.
TABLE, STEPS, CELLS = 512, 12, 1 << 20

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(key: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the turn only."""
    return ((mixed(key + U((turn * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))) >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series from 8 on."""
    x = np.asarray(x, dtype=np.float64)
    small = x < 8.0
    y = np.where(small, x + 8.0, x)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    if small.any():
        low = x[small]
        product = low.copy()
        for k in range(1, 8):
            product *= low + k
        out[small] -= np.log(product)
    return out


@lru_cache(8)
def table(d: float) -> np.ndarray:
    """log S(c, t) for c, t up to TABLE; -inf where t is 0 or over c."""
    out = np.full((TABLE + 1, TABLE + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, TABLE + 1)
    for c in range(1, TABLE):
        with np.errstate(divide="ignore"):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.log(np.maximum(c - t * d, 0.0)) + out[c, 1:])
    return out


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    c, t = np.asarray(c, dtype=np.float64), np.asarray(t, dtype=np.float64)
    z = np.minimum(np.log(t * d / c) / (1 - d), -1e-7)  # log(1 - x); this start is right where x is near 1
    for _ in range(30):
        e, f = np.expm1(z), np.expm1(d * z)
        g = np.log(t * d / c) + np.log(-e) + (d - 1) * z - np.log(-f)
        step = g / ((e + 1) / e + (d - 1) - d * (f + 1) / f)
        z = np.clip(z - step, 2 * z - 1e-3, z / 2)
        if np.max(np.abs(step) / -z, initial=0.0) < 1e-9:
            break
    x, y, f = -np.expm1(z), np.exp(z), -np.expm1(d * z)
    spread = c + t * x * x * d * (1 - d) * y ** (d - 2) / f - c * c / t
    return lgamma(c + 1) - lgamma(t + 1) + t * np.log(f / d) - c * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-12))


@lru_cache(8)
def _right(d: float) -> tuple[np.ndarray, np.ndarray]:
    """What the saddle point lacks at c = TABLE, by log(t / c^d), on which alone it depends for large c."""
    t = np.arange(1, TABLE // 2 + 1)
    return np.log(t / TABLE**d), table(d)[TABLE, t] - _saddle(np.full(len(t), TABLE), t, d)


def _lacks(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    at, lacks = _right(d)
    x = np.log(t) - d * np.log(c)
    return np.interp(x, at, lacks) + np.minimum(x - at[0], 0.0) * (lacks[1] - lacks[0]) / (at[1] - at[0])


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    out = np.empty(len(c))
    low = c <= TABLE
    out[low] = table(d)[c[low], t[low]]
    if not low.all():
        c, t = c[~low], t[~low]
        many = np.where(t < c, _saddle(c, np.minimum(t, c - 1), d) + _lacks(c, t, d), 0.0)
        out[~low] = many
    return out


class Weights:
    """The log weight of t tables beside the ways to sit: the product over i = 1 .. t - 1 of (a + d i) (q + i) / (z + i), or of (a + d i) q where z is None."""

    def __init__(self, d: float, a: np.ndarray, q: np.ndarray, z: np.ndarray | None):
        self.d, self.a, self.q, self.z = d, a, q, z

    def of(self, some: np.ndarray) -> Weights:
        return Weights(self.d, self.a[some], self.q[some], None if self.z is None else self.z[some])

    def at(self, t: np.ndarray) -> np.ndarray:
        out = (t - 1) * np.log(self.d) + lgamma(self.a / self.d + t) - lgamma(self.a / self.d + 1)
        if self.z is None:
            return out + (t - 1) * np.log(self.q)
        return out + lgamma(self.q + t) - lgamma(self.q + 1) - lgamma(self.z + t) + lgamma(self.z + 1)


def _drawn(c: np.ndarray, w: Weights, u: np.ndarray) -> np.ndarray:
    """Exact draws: all t of all pairs in one long row."""
    end = np.cumsum(c)
    start = end - c
    of = np.repeat(np.arange(len(c)), c)
    i = np.arange(len(of)) - start[of]
    more = np.maximum(i, 1)
    p = np.log((w.a[of] + w.d * more) * (w.q[of] if w.z is None else (w.q[of] + more) / (w.z[of] + more)))
    p[start] = 0.0
    p = np.cumsum(p)
    p += table(w.d)[c[of], i + 1] - p[start][of]
    p = np.exp(p - np.maximum.reduceat(p, start)[of])
    upto = np.cumsum(p)
    low = upto[start] - p[start]
    return np.clip(np.searchsorted(upto, low + u * (upto[end - 1] - low), side="right"), start, end - 1) - start + 1


def _likeliest(c: np.ndarray, w: Weights) -> np.ndarray:
    """The t of the greatest weight; weights rise up to it and then fall."""
    low, high = np.ones(len(c), dtype=np.int64), c.copy()
    while (low < high).any():
        t = (low + high) // 2
        rises = log_stirling(c, np.minimum(t + 1, c), w.d) + w.at(np.minimum(t + 1, c)) > log_stirling(c, t, w.d) + w.at(t)
        low, high = np.where((low < high) & rises, t + 1, low), np.where(rises, high, t)
    return low


def seated(c: np.ndarray, t: np.ndarray, w: Weights, key: np.ndarray, turn: int) -> np.ndarray:
    """New numbers of tables for pairs of c customers that sat at t. In turn 0, pairs too large for an exact draw start from their likeliest t."""
    out, d = np.minimum(np.maximum(t, 1), c), w.d
    few = np.flatnonzero((c > 1) & (c <= TABLE))
    for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(c[few]) // CELLS)) + 1):
        if len(some):
            out[some] = _drawn(c[some], w.of(some), uniform(key[some], turn))
    many = np.flatnonzero(c > TABLE)
    if len(many):
        own, n, k = w.of(many), c[many], key[many]
        now = out[many] if turn else _likeliest(n, own)
        weight = log_stirling(n, now, d) + own.at(now)
        for step in range(STEPS):
            wide = np.maximum(1.0, n**d / 2.0 ** (step + 1))
            move = np.ceil(uniform(k, turn * 64 + 3 * step + 1) * wide).astype(np.int64)
            to = now + np.where(uniform(k, turn * 64 + 3 * step + 2) < 0.5, -move, move)
            can = (to >= 1) & (to <= n)
            to = np.where(can, to, now)
            there = log_stirling(n, to, d) + own.at(to)
            go = can & (np.log(uniform(k, turn * 64 + 3 * step + 3)) < there - weight)
            now, weight = np.where(go, to, now), np.where(go, there, weight)
        out[many] = now
    return out
