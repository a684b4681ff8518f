"""Numbers of tables in Chinese restaurants, for many dishes at once, in numpy.

Of a dish with n customers only the number of its tables matters to others, so
that is what a Gibbs step draws, from its exact law given all else: what moves of
all n customers, one after another, come to.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def log_rising(start: float, step: float, n: np.ndarray) -> np.ndarray:
    """The logarithm of the product of start + step * i for i from 1 below n."""
    first = math.lgamma(start / step + 1)
    return np.array([(k - 1) * math.log(step) + math.lgamma(start / step + k) - first for k in n.tolist()])


#: up to so many customers the law of their tables is one table of numbers
_FEW = 512


def few(discount: float, most: int) -> np.ndarray:
    """Row n, place t - 1: the logarithm of the weight of all seatings of n
    customers at t tables, n < most."""
    t = np.arange(1, most)
    out = np.full((most, most - 1), -np.inf)
    out[1, 0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(1, most - 1):
            stay = out[n] + np.log(np.maximum(n - discount * t, 0.0))
            out[n + 1] = np.logaddexp(np.where(t <= n, stay, -np.inf), np.append(-np.inf, out[n, :-1]))
    return out


def _more(logs: np.ndarray, n: int, stop: int, discount: float, reach: float = 0.8) -> np.ndarray:
    """The weights for `stop` customers from those for n.

    Over (n - 1)! / (discount^(t - 1) (t - 1)!) one customer multiplies them by
    1 + A / n, with A the same for all n, so g customers multiply them by a
    polynomial in A; g is such that four powers are enough where weights are, and
    at all numbers of tables with a small `reach`."""
    t = np.arange(1, len(logs) + 1)
    while n < stop:
        ref = np.maximum.accumulate(np.where(np.isfinite(logs), np.arange(len(logs)), 0))
        ref = logs[ref]
        now = np.exp(logs - ref)
        inflow = np.append(0.0, (t[1:] - 1) * discount * np.exp(ref[:-1] - ref[1:]))
        g = max(1, min(stop - n, int(reach * n / (inflow + discount * t).max())))
        i = 1.0 / np.arange(n, n + g)
        p = [float((i**k).sum()) for k in range(1, 5)]
        e = [1.0]
        for k in range(1, min(4, g) + 1):
            e.append(sum((-1) ** j * e[k - 1 - j] * p[j] for j in range(k)) / k)
        term, total = now, now
        for share in e[1:]:
            term = np.append(0.0, inflow[1:] * term[:-1]) - discount * t * term
            total = total + share * term
        with np.errstate(divide="ignore"):
            logs = ref + np.log(np.maximum(total, 0.0))
        n += g
    return logs


def _far(discount: float, n: int, width: int) -> np.ndarray | None:
    """The logarithms of the weights of n customers at 1 to `width` tables, over
    (n - 1)!, by the alternating sum of generalised factorial coefficients; None
    where it would cancel.  Terms fall as powers of tables / n^discount."""
    if width * n**-discount > 5 or width > 1_000:
        return None
    t = np.arange(1, width + 1, dtype=float)
    total, ways, whole = np.zeros(width), np.ones(width), math.lgamma(n)
    for k in range(1, width + 1):
        ways = ways * (t - k + 1) / k
        x = k * discount
        if x >= n:
            return None
        # 1 / gamma(-x) by reflection
        term = ways * ((-1) ** (k + 1) * math.sin(math.pi * x) / math.pi * math.exp(math.lgamma(1 + x) + math.lgamma(n - x) - whole))
        total += term
        if k > 8 and np.abs(term).max() < 1e-18 * np.abs(total).min():
            break
    if not (total > 0).all():
        return None
    return np.log(total) - np.cumsum(np.log(discount * t))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers from some 60 on."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _around(discount: float, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """What `_far` sums, as a logarithm, from its generating function by an integral
    around the origin, x = exp(-v) on a parabola of v through the saddle; nan where
    that closes before the integrand has vanished, as with tables for nearly all."""
    m, most = n.astype(float), t.astype(float)

    def fall(v):
        return most * np.log1p(-((-np.expm1(-v)) ** discount)) + m * v

    low, high = np.full(len(n), math.log(1e-18)), np.full(len(n), math.log(30.0))
    for _ in range(60):
        v = np.exp((low + high) / 2)
        y = -np.expm1(-v)
        rising = most * discount * y ** (discount - 1) * np.exp(-v) > m * (1 - y**discount)
        low, high = np.where(rising, (low + high) / 2, low), np.where(rising, high, (low + high) / 2)
    v = np.exp((low + high) / 2)
    top, end = fall(v), np.minimum(math.pi / (2 * v), np.minimum(np.sqrt(30 / v), 1e4))
    path = lambda u: fall(v * (1 + 1j * u) ** 2) - top
    closed = path(end).real < -36
    low, high = np.log(end) - 40, np.log(end)
    for _ in range(24):
        below = path(np.exp((low + high) / 2)).real < -40
        low, high = np.where(below, low, (low + high) / 2), np.where(below, (low + high) / 2, high)
    step, nodes = np.exp(high) / 160, 161
    total = sum((np.exp(path(k * step)) * (1 + 1j * k * step)).real * (0.5 if k == 0 else 1.0) for k in range(nodes))
    return np.where(closed & (total > 0), np.log(np.where(total > 0, total, 1.0) * step * 2 * v / math.pi) + top + np.log(m), np.nan)


def _each(discount: float, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The logarithm of the weight of all seatings of n customers, over _FEW, at t
    tables, of each place: by the sum of `_far`, or where it would cancel by an
    integral; nan where neither is exact."""
    if len(n) > 1 << 14:
        return np.concatenate([_each(discount, n[k : k + (1 << 14)], t[k : k + (1 << 14)]) for k in range(0, len(n), 1 << 14)])
    m, total, top, ways = n.astype(float), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    fits = t * m**-discount <= 5
    for k in range(1, int(t[fits].max(initial=0)) + 1):
        x = k * discount
        more = fits & (t >= k)
        ways = np.where(more, ways + np.log(np.maximum(t - k + 1, 1) / (k * m**discount)), -np.inf)
        fits &= ~more | (m - x > 64)
        rest = np.maximum(m - x, 64.0)
        # n^x gamma(n - x) / gamma(n), without the difference of two large numbers
        ratio = (rest - 0.5) * np.log(rest / m) + x + 1 / (12 * rest) - 1 / (360 * rest**3) - 1 / (12 * m) + 1 / (360 * m**3)
        size = np.exp(np.minimum(ways + math.lgamma(1 + x) + ratio, 40.0)) / math.pi
        total += (-1) ** (k + 1) * math.sin(math.pi * x) * size
        top = np.maximum(top, size)
        # where it cancels it will not be used
        fits &= top < 1e9
        if k > 8 and (size <= 1e-18 * np.maximum(np.abs(total), 1e-4 * top))[fits].all():
            break
    summed = fits & (total > 1e-4 * top)
    logs = np.full(len(n), np.nan)
    logs[summed] = np.log(total[summed])
    left = ~summed & (t < n)
    if left.any():
        logs[left] = _around(discount, n[left], t[left])
    return np.where(t == n, 0.0, logs - t * math.log(discount) - _log_gamma(np.maximum(t, 64) + 1.0) + _under(t) + _log_gamma(m))


def _under(t: np.ndarray) -> np.ndarray:
    """What `_log_gamma` lacks of small factorials."""
    small = np.array([math.lgamma(65.0) - math.lgamma(k + 1.0) for k in range(65)])
    return small[np.minimum(t, 64)]


def seated(discount: float, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The logarithm of the weight of all seatings of n customers at t tables, of
    each place, however many they are."""
    out = np.full(len(n), np.nan)
    small = n <= _FEW
    if small.any():
        out[small] = few(discount, int(n[small].max()) + 1)[n[small], t[small] - 1]
    if not small.all():
        out[~small] = _each(discount, n[~small], t[~small])
    left = np.flatnonzero(np.isnan(out))
    if len(left):
        laws = Laws(discount, few(discount, _FEW + 1), int(t[left].max()), 0.2)
        left = left[np.argsort(n[left], kind="stable")]
        sizes, first = np.unique(n[left], return_index=True)
        for size, i in zip(sizes.tolist(), np.split(left, first[1:]), strict=True):
            out[i] = laws.grown(size, int(t[i].max()))[t[i] - 1] + math.lgamma(size) - math.lgamma(_FEW)
    return out


class Laws:
    """Weights, each up to a factor of its number of customers, for numbers of
    customers that ascend."""

    def __init__(self, discount: float, small: np.ndarray, width: int, reach: float = 0.8):
        self.discount, self.small, self.width, self.reach = discount, small, width, reach
        self.logs = None

    def grown(self, n: int, width: int) -> np.ndarray:
        """Of n customers, over _FEW, at 1 to `width` tables, from those of fewer."""
        if self.logs is None or len(self.logs) < width:
            self.width = max(self.width, width)
            # logarithms of discount^(t - 1) (t - 1)!, up to a constant
            self.scale = np.cumsum(np.append(0.0, np.log(self.discount * np.arange(1, self.width))))
            self.logs, self.at = np.full(self.width, -np.inf), _FEW
            self.logs[:_FEW] = self.small[_FEW, : self.width]
            self.logs += self.scale
        self.logs, self.at = _more(self.logs, self.at, n, self.discount, self.reach), n
        return (self.logs - self.scale)[:width]

    def of(self, n: int, width: int) -> np.ndarray:
        """Of n customers at 1 to `width` tables."""
        if n <= _FEW:
            return self.small[n, :width]
        own = _far(self.discount, n, width)
        if own is None and self.discount * width * math.log(n / (self.at if self.logs is not None and len(self.logs) >= width else _FEW)) > 200:
            # too many steps from the last one
            own = _each(self.discount, np.full(width, n), np.arange(1, width + 1)) - math.lgamma(n)
        return self.grown(n, width) if own is None or np.isnan(own).any() else own


def _pick(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A place of each row, by the weights whose logarithms these are."""
    total = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    x = rng.random(len(total)) * total[:, -1]
    return (total <= x[:, None]).sum(axis=1)


def _wide(n: int, first: np.ndarray, discount: float) -> int:
    """Where weights don't exceed `first`, a number that tables don't exceed but with
    a chance of some 1e-20: never more than Poisson(first / discount) others, nor
    than seating in turn gives."""
    mean = float(np.minimum(first / discount, first / (1 - discount) * np.log1p(n * (1 - discount) / first)).max())
    return min(n, int(mean + 10 * math.sqrt(mean)) + 40)


#: a number of tables whose weight is so much below the largest, as a logarithm, is never drawn
_NEVER = 46.0


def draw(n: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: float, rng: np.random.Generator) -> np.ndarray:
    """A number of tables of each dish.  weight(i, j) is what dishes i open a table
    with that have j tables; t tables have the product of these for j from 1 below
    t, times the weight of all seatings of n at t tables."""
    n, out = n.astype(np.int64), np.ones(len(n), np.int64)
    if not len(n):
        return out
    order = np.argsort(n, kind="stable")
    sizes, first = np.unique(n[order], return_index=True)
    cuts = np.append(first, len(n))
    small = few(discount, min(int(n.max()), _FEW) + 1)
    some = np.flatnonzero(n > 64)
    bound = np.zeros(len(n))
    bound[some] = np.maximum(weight(some, np.int64(1)), weight(some, np.int64(64)))
    large = n > _FEW
    laws = Laws(discount, small, _wide(int(n.max()), bound[large], discount) if large.any() else 1)
    for size, a, b in zip(sizes.tolist(), cuts[:-1], cuts[1:], strict=True):
        if size < 2:
            continue
        width = _wide(size, bound[order[a:b]], discount) if size > 64 else size
        own, k = laws.of(size, width), a
        while k < b:
            i = order[k : min(k + max(1, (1 << 20) // len(own)), b)]
            tables, law = np.arange(1, len(own)), np.empty((len(i), len(own)))
            law[:, 0] = 0.0
            np.cumsum(np.log(weight(i[:, None], tables[None])), axis=1, out=law[:, 1:])
            law += own
            # weights that rise with tables may make more of them likely
            if len(own) < size and (law[:, -1] > law.max(axis=1) - _NEVER).any():
                own = laws.of(size, min(size, 2 * len(own)))
                continue
            out[i] = 1 + _pick(law, rng)
            k += len(i)
    return out
