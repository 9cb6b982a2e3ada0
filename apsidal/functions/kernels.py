"""Numerical kernels over columns of numbers, for use inside Arrow batches."""

from __future__ import annotations

from math import lgamma

import numpy as np
from pyspark.sql import DataFrame


def disk_probability(bx: np.ndarray, by: np.ndarray, cxx: np.ndarray, cxy: np.ndarray, cyy: np.ndarray, radius: np.ndarray, n_t: int = 48) -> np.ndarray:
    """Integral of a Gaussian with mean (bx, by) and a full covariance over a centred disk.

    In the principal axes of the covariance the integral along one axis is a difference of error
    functions; only the other axis is summed, at Chebyshev nodes of the second kind, so a row needs
    ``n_t`` nodes. The minor axis is the closed one.
    """
    half, gap = (cxx + cyy) / 2, np.hypot((cxx - cyy) / 2, cxy)
    sx, sy = np.sqrt(half + gap), np.sqrt(np.maximum(half - gap, 0))
    turn = 0.5 * np.arctan2(2 * cxy, cxx - cyy)
    mx, my = bx * np.cos(turn) + by * np.sin(turn), by * np.cos(turn) - bx * np.sin(turn)
    k = np.arange(1, n_t + 1) * np.pi / (n_t + 1)
    x = radius[:, None] * np.cos(k)
    y = radius[:, None] * np.sin(k)
    with np.errstate(divide="ignore", invalid="ignore"):
        across = gauss_between((-y - my[:, None]) / sy[:, None], (y - my[:, None]) / sy[:, None])
        density = np.exp(-0.5 * ((x - mx[:, None]) / sx[:, None]) ** 2) / (np.sqrt(2 * np.pi) * sx[:, None])
        out = (density * across * np.sin(k)).sum(1) * radius * np.pi / (n_t + 1)
    return np.clip(np.where((cxx * cyy > cxy * cxy) & (radius > 0), out, 0.0), 0, 1)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(12)


def gauss_between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Standard normal mass between two bounds; relative accuracy holds in the tails and for narrow gaps."""
    mid, half = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(mid)
    narrow = half <= 0.5
    for x, w in zip(_NODES, _WEIGHTS, strict=True):
        out += w * np.exp(-0.5 * (mid + x * half) ** 2)
    out *= half / np.sqrt(2 * np.pi)
    if not narrow.all():  # nine deviations from the bound nearest the middle hold all that counts, in panels of a quarter
        a, b = low[~narrow], high[~narrow]
        a, b = np.maximum(a, np.where(b < 0, b - 9, -9)), np.minimum(b, np.where(a > 0, a + 9, 9))
        total, width = np.zeros_like(a), (b - a) / 72
        for k in range(72):
            for x, w in zip(_NODES, _WEIGHTS, strict=True):
                total += w * np.exp(-0.5 * (a + width * (k + (x + 1) / 2)) ** 2)
        out[~narrow] = total * width / 2 / np.sqrt(2 * np.pi)
    return out


def with_disk_probability(alerts: DataFrame) -> DataFrame:
    """alert_id, pc, pc_quad: the integral over the hard-body disk of (b_t, b_n, c_tt, c_tn, c_nn, hbr_km)."""

    def run(batches):
        for b in batches:
            v = [b[c].to_numpy(float) for c in ("b_t", "b_n", "c_tt", "c_tn", "c_nn", "hbr_km")]
            out = [disk_probability(*(x[i : i + 4096] for x in v)) for i in range(0, len(b), 4096)]
            yield b[["alert_id", "pc"]].assign(pc_quad=np.concatenate(out) if out else [])

    return alerts.select("alert_id", "pc", "b_t", "b_n", "c_tt", "c_tn", "c_nn", "hbr_km").mapInPandas(run, "alert_id long, pc double, pc_quad double")


def chan_probability(bx: np.ndarray, by: np.ndarray, cxx: np.ndarray, cxy: np.ndarray, cyy: np.ndarray, radius: np.ndarray, most: int = 50_000) -> np.ndarray:
    """Equivalent-area series: Poisson weights of half the squared Mahalanobis miss times gamma tails, in logarithms."""
    det = cxx * cyy - cxy * cxy
    ok = (det > 0) & (radius > 0)
    det = np.where(ok, det, 1.0)
    lam = np.where(ok, (cyy * bx * bx - 2 * cxy * bx * by + cxx * by * by) / det / 2, 0.0)
    x = np.where(ok, radius * radius / np.sqrt(det) / 2, 1.0)
    total, peak = np.zeros_like(lam), np.full_like(lam, -np.inf)
    log_lam = np.log(np.maximum(lam, 1e-300))
    need = int(min(most, (lam + 12 * np.sqrt(lam + 1) + 60).max(initial=0)))
    for m in range(need + 1):
        tail, term = np.ones_like(x), np.ones_like(x)
        for j in range(1, 4000):
            term = term * x / (m + 1 + j)
            tail = tail + term
            if (term < 1e-17 * tail).all():
                break
        log_term = -lam + (m * log_lam if m else 0) - lgamma(m + 1) + (m + 1) * np.log(x) - x - lgamma(m + 2) + np.log(tail)
        higher = np.maximum(peak, log_term)
        total = total * np.exp(np.where(np.isfinite(peak), peak - higher, -np.inf)) + np.exp(log_term - higher)
        peak = higher
        if m > 4 and ((log_term < peak - 45) & (m > np.sqrt(lam * x))).all():  # terms peak near that m
            break
    return np.clip(np.where(ok, np.exp(np.minimum(peak, 0)) * total, 0.0), 0, 1)


def with_probability_checks(alerts: DataFrame, largest: bool = True) -> DataFrame:
    """Add foster, chan and, unless not wanted, alfano (largest probability over scales of the covariance) to B-plane rows."""
    names = ["b_t", "b_n", "c_tt", "c_tn", "c_nn", "hbr_km"]

    def run(batches):
        for b in batches:
            cols = [[], [], []]
            for i in range(0, len(b), 4096):
                v = [b[c].to_numpy(float)[i : i + 4096] for c in names]
                foster = disk_probability(*v)
                cols[0].append(foster)
                cols[1].append(chan_probability(*v))
                cols[2].append(np.maximum(foster, largest_probability(*v)) if largest else np.full(len(foster), np.nan))
            yield b.assign(**{n: np.concatenate(c) if c else [] for n, c in zip(("foster", "chan", "alfano"), cols, strict=True)})

    return alerts.select("alert_id", *names).mapInPandas(run, "alert_id long, " + ", ".join(f"{n} double" for n in [*names, "foster", "chan", "alfano"]))


def largest_probability(bx, by, cxx, cxy, cyy, radius, rounds: int = 24) -> np.ndarray:
    """Maximum over a common scale of the covariance: golden sections of its logarithm about the closed-form optimum."""
    det = np.maximum(cxx * cyy - cxy * cxy, 1e-300)
    best = np.maximum((cyy * bx * bx - 2 * cxy * bx * by + cxx * by * by) / det / 2, 1e-12)
    at = lambda u: disk_probability(bx, by, cxx * 10**u, cxy * 10**u, cyy * 10**u, radius)
    low, high = np.log10(best) - 1.5, np.log10(best) + 1.5
    g = (5**0.5 - 1) / 2
    for _ in range(rounds):
        c, d = high - g * (high - low), low + g * (high - low)
        left = at(c) > at(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return np.where(np.hypot(bx, by) <= radius, 1.0, at((low + high) / 2))
