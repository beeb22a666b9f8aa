"""Anchoring and refining of signal maps, classifier inputs, and scoring of reference sequences: per-read numpy kernels."""

from __future__ import annotations

import numpy as np

from strandline.operators.kernels import banded_path, dwell_path, half_band

#: Quantiles that a rough rescale matches.
ROUGH_QUANTILES = np.linspace(0.05, 0.95, 19)
LEAST_SLOPE = 0.01


def signal_window(x, anchor: int, left: int, right: int, mask_before: int | None = None) -> list[float] | None:
    """Samples [anchor - left, anchor + right), with NaN past the ends and before ``mask_before``; null if no sample is left."""
    x = np.asarray(x, float)
    out = np.full(left + right, np.nan)
    a, b = anchor - left, anchor + right
    lo, hi = max(a, 0, mask_before or 0), min(b, len(x))
    if hi <= lo:
        return None
    out[lo - a : hi - a] = x[lo:hi]
    return out.tolist()


def line_through(x, y) -> tuple[float, float]:
    """Least-squares slope and intercept; a slope under 0.01 or a non-finite fit gives (1, 0), that is no change."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    spread = np.square(x - x.mean()).sum() if len(x) else 0.0
    if not spread:
        return 1.0, 0.0
    slope = float(((x - x.mean()) * (y - y.mean())).sum() / spread)
    intercept = float(y.mean() - slope * x.mean())
    return (slope, intercept) if np.isfinite(slope + intercept) and slope >= LEAST_SLOPE else (1.0, 0.0)


def rough_rescale(x, levels) -> dict:
    """Shift and scale that bring the signal's quantiles to those of the expected levels."""
    slope, intercept = line_through(np.quantile(np.asarray(x, float), ROUGH_QUANTILES), np.quantile(np.asarray(levels, float), ROUGH_QUANTILES))
    return {"scale": slope, "shift": intercept}


def rescale(x, boundaries, levels, low: float = 0.1, high: float = 0.9, least_distance: float = 0.2) -> dict | None:
    """Scale, shift and drift by least squares over bases with a dwell strictly inside two quantiles and a level that far from the mean level."""
    x, b, levels = np.asarray(x, float), np.asarray(boundaries), np.asarray(levels, float)
    dwell = np.diff(b)
    a, c = np.quantile(dwell, [low, high])
    keep = (dwell > a) & (dwell < c) & (np.abs(levels - levels.mean()) > least_distance)
    if keep.sum() < 3:
        return None
    means = np.array([x[i:j].mean() for i, j in zip(b[:-1][keep], b[1:][keep])])
    middle = (b[:-1][keep] + b[1:][keep]) / 2 / len(x)
    solved, *_ = np.linalg.lstsq(np.column_stack([means, np.ones(len(means)), middle]), levels[keep], rcond=None)
    return {"scale": float(solved[0]), "shift": float(solved[1]), "drift": float(solved[2])} if solved[0] >= LEAST_SLOPE else None


def refine_map(x, boundaries, levels, rounds: int = 2, half: int = 5, dwell: tuple[float, float] | None = None) -> list[int]:
    """Boundaries after rough rescaling and rounds of banded alignment and rescaling; a rescale that fails is left out. ``dwell`` is a target and a weight of dwell costs."""
    x, levels = np.asarray(x, float), np.asarray(levels, float)
    rough = rough_rescale(x, levels)
    now, at = x * rough["scale"] + rough["shift"], list(boundaries)
    for _ in range(rounds):
        band = half_band(at, half, len(x))
        found = dwell_path(now, levels, *band, *dwell) if dwell else banded_path(now, levels, *band)
        if not found:
            break
        at = found
        fit = rescale(now, at, levels)
        if fit:
            now = now * fit["scale"] + fit["shift"] + fit["drift"] * np.arange(len(x)) / len(x)
    return [int(v) for v in at]


def fold_features(values, n_channels: int) -> dict:
    """Offset-major features as channels: z-scored per channel, non-finite ones exactly 0, with a mask."""
    grid = np.asarray(values, float).reshape(-1, n_channels).T
    ok = np.isfinite(grid)
    n = np.maximum(ok.sum(1, keepdims=True), 1)
    filled = np.where(ok, grid, 0.0)
    m = filled.sum(1, keepdims=True) / n
    sd = np.sqrt(np.where(ok, np.square(filled - m), 0.0).sum(1, keepdims=True) / n)
    return {"x": np.where(ok, (filled - m) / np.where(sd > 0, sd, 1.0), 0.0).ravel().tolist(), "mask": ok.astype(float).ravel().tolist()}


def call_from_probabilities(p, thresholds) -> int:
    """The last class of the largest probability, or -1 if its lead over the next is under its threshold."""
    p = np.asarray(p, float)
    if not len(p):
        return -1
    best = len(p) - 1 - int(p[::-1].argmax())
    lead = p[best] - np.delete(p, best).max() if len(p) > 1 else 1.0
    return best if lead >= thresholds[best] else -1
