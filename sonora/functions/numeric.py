"""Small numpy helpers that run inside tasks: scans, distributions, resampling."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(np.asarray(x, float) / math.sqrt(2)))


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or tiny)
        c = 1 + n / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (out - 1)


def beta_cdfs(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """beta_cdf of arrays; twelve deviations beyond the mean of a narrow one it is taken as 0 or 1, and the fraction runs until all have settled."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    mean, far = a / (a + b), np.where(a + b > 1000, 12 * np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))), 1.0)
    out = np.where(x >= np.minimum(1, mean + far), 1.0, 0.0)
    inside = np.flatnonzero((x > np.maximum(0, mean - far)) & (x < np.minimum(1, mean + far)))
    if not len(inside):
        return out
    x, a, b = x[inside], a[inside], b[inside]
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d, f = np.ones_like(x), np.zeros_like(x), np.ones_like(x)
    for i in range(100_000):
        m = i // 2
        n = np.ones_like(x) if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + n * d
        d = 1 / np.where(d == 0, 1e-300, d)
        c = 1 + n / c
        c = np.where(c == 0, 1e-300, c)
        f = f * c * d
        if i > 1 and np.abs(c * d - 1).max() < 1e-14:
            break
    value = front * (f - 1)
    out[inside] = np.where(swap, 1 - value, value)
    return out


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def harrell_davis(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """Quantile as a beta-weighted mean of all order statistics; values are distinct and sorted, so equal ones share the weight between their ends."""
    below = np.concatenate([[0], np.cumsum(counts)])
    n = int(below[-1])
    edges = np.array([beta_cdf(x / n, (n + 1) * q, (n + 1) * (1 - q)) for x in below.tolist()])
    return float(np.diff(edges) @ values)


def weighted_median(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Median of sorted distinct values with counts (the last axis), which may be rows of many draws."""
    below = np.cumsum(counts, axis=-1)
    n = below[..., -1:]
    at = lambda rank: values[(below <= rank).sum(axis=-1)]
    return (at((n - 1) // 2) + at(n // 2)) / 2


def resampled(values: np.ndarray, counts: np.ndarray, statistic: str, n: int, rng: np.random.Generator) -> np.ndarray:
    """The statistic of n draws with replacement, as multinomial counts of the distinct values."""
    size, step = int(counts.sum()), max(1, 2_000_000 // len(values))
    f = weighted_median if statistic == "median" else lambda v, c: c @ v / size
    share = counts / size
    return np.concatenate([f(values, rng.multinomial(size, share, min(step, n - at))) for at in range(0, n, step)])


def interval(values: np.ndarray, counts: np.ndarray, draws: np.ndarray, statistic: str, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the median, or the bias-corrected accelerated interval of the mean. Equal values give themselves."""
    if len(values) == 1:
        return float(values[0]), float(values[0])
    tail = (1 - level) / 2
    if statistic == "median":
        return tuple(float(x) for x in np.quantile(draws, [tail, 1 - tail]))
    mean = float(counts @ values / counts.sum())
    centre = (draws < mean).mean() + (draws == mean).mean() / 2
    z0 = normal_quantile(min(max(centre, 1e-9), 1 - 1e-9))
    dev = values - mean  # a jackknife mean is off by a constant share of this
    a = float(counts @ dev**3 / (6 * (counts @ dev**2) ** 1.5))
    at = [float(normal_cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (normal_quantile(tail), normal_quantile(1 - tail))]
    return tuple(float(x) for x in np.quantile(draws, at))


def permutation_p(values: np.ndarray, counts: np.ndarray, n: int, seed: int) -> float:
    """Two-sided share of sign flips whose mean is at least as far from 0; of equal differences the number flipped is drawn."""
    rng, size = np.random.default_rng(seed), int(counts.sum())
    own, step, hits = abs(float(counts @ values)) / size, max(1, 2_000_000 // len(values)), 0
    for at in range(0, n, step):
        kept = rng.binomial(counts, 0.5, (min(step, n - at), len(values)))
        hits += int((np.abs((2 * kept - counts) @ values / size) >= own - 1e-12).sum())
    return (hits + 1) / (n + 1)


def uneven_average(t: np.ndarray, x: np.ndarray, tau: float, y: float, last: float) -> np.ndarray:
    """Exponential average of x at rising times t, going on from y at the time last (NaN: from the first value)."""
    out, at = np.empty(len(x)), 0
    if math.isnan(y) and len(x):
        out[0], y, last, at = x[0], float(x[0]), float(t[0]), 1
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(t, last + 500 * tau)))
        part, grow = x[at:end], np.exp((t[at:end] - max(last, t[at] - 500 * tau)) / tau)
        gaps = np.diff(t[at:end], prepend=last)
        out[at:end] = (y * (last >= t[at] - 500 * tau) + np.cumsum(-np.expm1(-gaps / tau) * part * grow)) / grow
        y, last, at = float(out[end - 1]), float(t[end - 1]), end
    return out


#: Samples of a filter's block.
BLOCK = 64


@lru_cache(maxsize=64)
def _filter_blocks(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """For a block of BLOCK samples: outputs of its own samples and of the state, the state after it from both, and the steady state of ones."""
    top, low = np.array(b) / a[0], np.array(a) / a[0]
    order = len(low) - 1
    matrix = np.zeros((order, order))
    matrix[:, 0] = -low[1:]
    matrix[:-1, 1:] += np.eye(order - 1)
    drive = top[1:] - low[1:] * top[0]
    steady = np.linalg.lstsq(np.eye(order) - matrix, drive, rcond=None)[0]
    powers = [np.eye(order)]
    for _ in range(BLOCK):
        powers.append(matrix @ powers[-1])
    of_state = np.stack([m[0] for m in powers[:BLOCK]])
    response = np.concatenate([[top[0]], of_state[: BLOCK - 1] @ drive])
    own = np.array([[response[i - j] if i >= j else 0.0 for j in range(BLOCK)] for i in range(BLOCK)])
    into_state = np.stack([powers[BLOCK - 1 - j] @ drive for j in range(BLOCK)], axis=1)
    return own, of_state, into_state, powers[BLOCK], steady


def recursive_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, steady: bool = True) -> np.ndarray:
    """y = b/a x, started at rest or in the steady state of the first sample, in blocks of samples: only the state goes from block to block."""
    own, of_state, into_state, across, ones = _filter_blocks(tuple(map(float, b)), tuple(map(float, a)))
    state = ones * x[0] if steady else np.zeros(len(ones))
    blocks = np.zeros((-(-len(x) // BLOCK), BLOCK))
    blocks.ravel()[: len(x)] = x
    given, states = blocks @ into_state.T, np.empty((len(blocks), len(ones)))
    for i in range(len(blocks)):
        states[i] = state
        state = across @ state + given[i]
    return (blocks @ own.T + states @ of_state.T).ravel()[: len(x)]


def a_weight_coefficients(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear A-weighting filter: four zeros at 0 Hz, and double, single, single and double poles at pre-warped corner frequencies.

    Corner frequencies beyond the half rate are held just below it, so low rates work without resampling (the filter is then only nominal).
    """
    root, c, d = math.sqrt(0.5), 1e3 * 10**7.8, 1 / (1 - math.sqrt(0.5))
    middle = d * (1e6 + c / 1e6 - root * (1e3 + 10**7.8))
    spread = math.sqrt(middle**2 - 4 * c)
    corners = [math.sqrt((-middle - spread) / 2), math.sqrt((-middle + spread) / 2)] if middle < 0 else [20.598997, 12194.217]
    low, high = min(corners), max(corners)
    inner = [10**2.45 * (3 - math.sqrt(5)) / 2, 10**2.45 * (3 + math.sqrt(5)) / 2]
    w1, w4, w2, w3 = (2 * rate * math.tan(math.pi * min(f, 0.49 * rate) / rate) for f in (low, high, *inner))
    k, poles = 2 * rate, np.array([w4, w4, w1, w1, w3, w2])
    gain = 10 ** (2 / 20) * w4**2 * k**4 / np.prod(k + poles)
    return gain * np.real(np.poly([1.0] * 4 + [-1.0] * 2)), np.real(np.poly((k - poles) / (k + poles)))


def third_order_lowpass(rate: float, tau: float = 6 / (7 * 32)) -> tuple[np.ndarray, np.ndarray]:
    """Smoothing filter of order 3 with one time constant: poles d = exp(-1/(rate tau)), inputs weighed 0, d and d**2, unit gain at 0 Hz."""
    d = math.exp(-1 / (rate * tau))
    return (1 - d) ** 3 / (d + d * d) * np.array([0, d, d * d, 0]), np.poly([d] * 3)


def asymmetric_lowpass(x: np.ndarray, rate: float, rise: float, fall: float) -> np.ndarray:
    """First-order smoothing of columns: one time constant when the input is not below the last output, else the other."""
    up, down = math.exp(-1 / (rate * rise)), math.exp(-1 / (rate * fall))
    out = x.astype(float).copy()
    for i in range(1, len(x)):
        k = np.where(x[i] >= out[i - 1], up, down)
        out[i] = x[i] * (1 - k) + out[i - 1] * k
    return out


def autospectra(frames: np.ndarray, rate: float, window: Callable[[int], np.ndarray] = np.ones) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power (mean square) of each frame, all bins but the first doubled."""
    n = frames.shape[1]
    w = window(n)
    x = np.fft.rfft(frames * w, axis=1) / w.sum()
    power = np.abs(x) ** 2
    power[:, 1:] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power
