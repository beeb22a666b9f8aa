"""Sequential signal kernels on numpy, and the Arrow-batched columns that apply them.

Only what has no set-based form is here: greedy change points, dynamic time warping, banded
alignment, tree ensembles, kernel classifiers, lattice decoding and the signal codec. Every kernel
takes one row's arrays; the wrappers run them over Arrow batches, and models travel in the closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def column(kernel: Callable, kind: str) -> Callable[..., Column]:
    """A column function that applies ``kernel`` to each row's values; a null argument gives null. ``kind`` may be a struct of plain fields."""
    fields = re.findall(r"(\w+):", kind) if kind.startswith("struct<") else None

    def run(*columns: pd.Series) -> pd.Series | pd.DataFrame:
        found = [None if any(v is None for v in row) else kernel(*row) for row in zip(*columns)]
        return pd.DataFrame([r or {} for r in found], columns=fields) if fields else pd.Series(found, dtype=object)

    arity = kernel.__code__.co_argcount - len(kernel.__defaults__ or ())
    shapes = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}
    wrapped = shapes[arity]
    wrapped.__annotations__ = {n: pd.Series for n in "abc"[:arity]} | {"return": pd.DataFrame if fields else pd.Series}
    return F.pandas_udf(wrapped, kind)


def batched(kernel: Callable[[list], list], kind: str) -> Callable[[Column], Column]:
    """A column function that applies ``kernel`` to a whole Arrow batch of arrays at once; a null array gives null."""
    fields = re.findall(r"(\w+):", kind) if kind.startswith("struct<") else None

    def run(column: pd.Series) -> pd.Series | pd.DataFrame:
        there = [k for k, v in enumerate(column) if v is not None]
        found: list = [None] * len(column)
        for k, value in zip(there, kernel([np.asarray(column.iloc[k], float) for k in there]) if there else []):
            found[k] = value
        return pd.DataFrame([r or {} for r in found], columns=fields) if fields else pd.Series(found, dtype=object)

    run.__annotations__ = {"column": pd.Series, "return": pd.DataFrame if fields else pd.Series}
    return F.pandas_udf(run, kind)


def by_length(rows: list[np.ndarray], kernel: Callable[[np.ndarray], list]) -> list:
    """``kernel`` on a matrix of the rows of each length; results in the order of the rows."""
    out: list = [None] * len(rows)
    lengths = np.array([len(r) for r in rows])
    for n in np.unique(lengths):
        where = np.flatnonzero(lengths == n)
        for k, value in zip(where, kernel(np.stack([rows[k] for k in where]).reshape(len(where), n))):
            out[k] = value
    return out


# --- change points -------------------------------------------------------------------------------


def ttest_scores(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - 2 * width
    if n <= 0:
        return np.zeros(0)
    s = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
    q = np.concatenate([[0.0], np.cumsum(np.square(x, dtype=float))])
    i = np.arange(n)
    m1, m2 = ((s[i + a + width] - s[i + a]) / width for a in (0, width))
    spread = q[i + 2 * width] - q[i] - width * (m1 * m1 + m2 * m2)
    return np.where(spread > 0, np.abs(m1 - m2) / np.sqrt(np.where(spread > 0, spread, 1.0)), 0.0)


def strict_maxima(x: np.ndarray) -> np.ndarray:
    """Left midpoints of plateaus that both neighbours lie under; the ends never count."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    last = np.concatenate([first[1:], [len(x)]]) - 1
    v = x[first]
    peak = np.zeros(len(v), bool)
    peak[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    return ((first + last) // 2)[peak]


def change_points(x, width: int, count: int, separation: int) -> list[int]:
    """Up to ``count`` best maxima of the t-test scores, none nearer than ``separation`` to a better one."""
    scores = ttest_scores(np.asarray(x, float), width)
    peaks = strict_maxima(scores)
    blocked, chosen = np.zeros(len(scores) + 1, bool), []
    for p in peaks[np.lexsort((peaks, -scores[peaks]))]:
        if len(chosen) == count:
            break
        if not blocked[p]:
            chosen.append(int(p))
            blocked[max(0, p - separation + 1) : p + separation] = True
    return sorted(p + width for p in chosen)


def segments(x, cuts) -> list[dict]:
    x = np.asarray(x, float)
    edges = [0, *cuts, len(x)]
    return [{"start": a, "end": b, "mean": float(x[a:b].mean())} for a, b in zip(edges, edges[1:]) if b > a]


def fingerprint(x, n_segments: int, width: int, separation: int | None = None, keep: int | None = None) -> list[float] | None:
    """Means of the segments of the MAD-normalised signal, the last ``keep``; null if there are fewer."""
    x = np.asarray(x, float)
    if not len(x):
        return None
    middle = np.median(x)
    spread = np.median(np.abs(x - middle))
    x = (x - middle) / (spread or 1.0)
    means = [s["mean"] for s in segments(x, change_points(x, width, n_segments - 1, width if separation is None else separation))]
    return None if len(means) < (keep or n_segments) else means[-(keep or n_segments) :]


# --- log-likelihood splits -----------------------------------------------------------------------


def likelihood_split(x: np.ndarray, start: int, end: int, least: int, trim: int) -> tuple[int, float] | None:
    """Index and gain of the best split of x[start:end], the first of equals; none without a positive gain."""
    part = x[start:end]
    i = np.arange(least, len(part) - trim)
    i = i[i > 0]
    if not len(i):
        return None
    s, q, n = np.concatenate([[0.0], np.cumsum(part)]), np.concatenate([[0.0], np.cumsum(part * part)]), len(part)
    var = lambda a, b: (q[b] - q[a]) / (b - a) - ((s[b] - s[a]) / (b - a)) ** 2
    whole, head, tail = var(0, n), var(0, i), var(i, n)
    ok = (head > 0) & (tail > 0)
    if whole <= 0 or not ok.any():
        return None
    gain = np.where(ok, n * np.log(whole) - i * np.log(np.where(ok, head, 1)) - (n - i) * np.log(np.where(ok, tail, 1)), -np.inf)
    best = int(gain.argmax())
    return (start + int(i[best]), float(gain[best])) if gain[best] > 0 else None


#: The best split of a signal, those before and behind it, their gains, and the medians of the four parts.
PARTS = "struct<main:bigint,first:bigint,first_gain:double,last:bigint,last_gain:double,before:double,head:double,tail:double,after:double>"


def _best_splits(x: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, trim: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a matrix the best split of x[start:end] and its gain; -1 and 0 where none gains."""
    n_rows, n = x.shape
    s, q = (np.concatenate([np.zeros((n_rows, 1)), np.cumsum(v, 1)], 1) for v in (x, x * x))
    at = lambda c, i: np.take_along_axis(c, i, 1)
    a, b = start[:, None], end[:, None]
    i = np.broadcast_to(np.arange(n + 1), (n_rows, n + 1))
    size = np.maximum(b - a, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = lambda t, u, m: u / m - (t / m) ** 2
        whole = variance(at(s, b) - at(s, a), at(q, b) - at(q, a), size)
        head, tail = variance(s - at(s, a), q - at(q, a), i - a), variance(at(s, b) - s, at(q, b) - q, b - i)
        gain = size * np.log(whole) - (i - a) * np.log(head) - (b - i) * np.log(tail)
        ok = (i - a >= max(least, 1)) & (i < b - trim) & (i < b) & (whole > 0) & (head > 0) & (tail > 0)
    gain = np.where(ok, gain, -np.inf)
    best = gain.argmax(1)
    value = gain[np.arange(n_rows), best]
    return np.where(value > 0, best, -1), np.where(value > 0, value, 0.0)


def adapter_parts(rows: list[np.ndarray], least: int, trim: int) -> list[dict | None]:
    """``PARTS`` of each signal; ``main`` is null where no split gains. Without a split before or behind, that part has one sample."""

    def equal(x: np.ndarray) -> list[dict | None]:
        n_rows, n = x.shape
        none, all_ = np.zeros(n_rows, np.int64), np.full(n_rows, n)
        main, _ = _best_splits(x, none, all_, least + trim, trim)
        cut = np.maximum(main, 0)
        first, first_gain = _best_splits(x, none, cut, trim, least)
        last, last_gain = _best_splits(x, cut, all_, least, trim)
        first, last = np.where(first < 0, 1, first), np.where(last < 0, cut + 1, last)
        middle = lambda k, a, b: float(np.median(x[k, a:b])) if b > a else 0.0
        out: list[dict | None] = []
        for k in range(n_rows):
            c, f, e = int(main[k]), int(first[k]), int(last[k])
            if c < 0:
                out.append(None)
                continue
            out.append({"main": c, "first": f, "first_gain": float(first_gain[k]), "last": e, "last_gain": float(last_gain[k]), "before": middle(k, 0, f), "head": middle(k, f, c), "tail": middle(k, c, e), "after": middle(k, e, n)})
        return out

    return by_length(rows, equal)


# --- warping and classifiers ---------------------------------------------------------------------


def dtw(a, b, window: int | None = None, penalty: float = 0.0) -> float:
    """Root of the least summed squared differences; steps off the diagonal cost penalty squared; infinite if empty or out of the window."""
    return float(dtw_many(a, np.asarray(b, float)[None, :], window, penalty)[0])


def dtw_many(a, bank: np.ndarray, window: int | None = None, penalty: float = 0.0) -> np.ndarray:
    """Distances of one query to each row of a bank, all rows at once along anti-diagonal-free row sweeps."""
    a = np.asarray(a, float)
    n, m = len(a), bank.shape[1]
    if not n or not m or (window is not None and abs(n - m) > window):
        return np.full(len(bank), np.inf)
    extra, before = penalty * penalty, np.full((len(bank), m + 1), np.inf)
    before[:, 0] = 0.0
    for i in range(1, n + 1):
        lo, hi = (1, m) if window is None else (max(1, i - window), min(m, i + window))
        now = np.full_like(before, np.inf)
        cost = np.square(bank[:, lo - 1 : hi] - a[i - 1])
        free = np.minimum(before[:, lo - 1 : hi], before[:, lo : hi + 1] + extra)
        left = np.full(len(bank), np.inf)
        for k in range(hi - lo + 1):
            left = cost[:, k] + np.minimum(free[:, k], left + extra)
            now[:, lo + k] = left
        before = now
    return np.sqrt(before[:, m])


def nearest(distances: np.ndarray, labels: list, ratio: float = 0.8) -> dict:
    """Best label, the first of equals, with the two least distances and their ratio (0 where the second is 0)."""
    order = np.argsort(distances, kind="stable")[:2]
    best, second = float(distances[order[0]]), float(distances[order[1]]) if len(order) > 1 else np.inf
    r = best / second if second else 0.0
    return {"label": labels[order[0]], "distance": best, "second": second, "ratio": r, "confident": bool(r <= ratio)}


#: A call of the nearest reference.
CALL = "struct<label:string,distance:double,second:double,ratio:double,confident:boolean>"


def dtw_rows(rows: list[np.ndarray], bank: np.ndarray, window: int | None = None, penalty: float = 0.0, lanes: int = 1 << 15) -> list[np.ndarray]:
    """Distances of each row to each reference of the bank, all rows of a length swept together, in bounded groups."""

    def equal(x: np.ndarray) -> list[np.ndarray]:
        step = max(1, lanes // max(1, len(bank)))
        out = []
        for at in range(0, len(x), step):
            part = x[at : at + step]
            pairs = np.repeat(part, len(bank), 0)  # lane by lane: a row, a reference
            out += list(_dtw_lanes(pairs, np.tile(bank, (len(part), 1)), window, penalty).reshape(len(part), len(bank)))
        return out

    return by_length(rows, equal)


def _dtw_lanes(a: np.ndarray, b: np.ndarray, window: int | None, penalty: float) -> np.ndarray:
    """Distances of a[k] to b[k], by rows of the cost matrix."""
    n, m = a.shape[1], b.shape[1]
    if not n or not m or (window is not None and abs(n - m) > window):
        return np.full(len(a), np.inf)
    extra = penalty * penalty
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)  # lanes are contiguous
    before = np.full((m + 1, a.shape[1]), np.inf)
    before[0] = 0.0
    for i in range(1, n + 1):
        lo, hi = (1, m) if window is None else (max(1, i - window), min(m, i + window))
        now = np.full_like(before, np.inf)
        for j in range(lo, hi + 1):
            now[j] = np.square(b[j - 1] - a[i - 1]) + np.minimum(before[j - 1], np.minimum(before[j], now[j - 1]) + extra)
        before = now
    return np.sqrt(before[m])


def nearest_of(rows: list[np.ndarray], bank: np.ndarray, labels: list, window: int | None = None, penalty: float = 0.0, ratio: float = 0.8) -> list[dict]:
    """``nearest`` for each row."""
    return [nearest(d, labels, ratio) for d in dtw_rows(rows, bank, window, penalty)]


def class_means_of_kernel(distances: np.ndarray, labels: np.ndarray, gamma: float, n_classes: int) -> np.ndarray:
    kernel = np.exp(-gamma * np.square(distances))
    return np.array([kernel[labels == c].mean() if (labels == c).any() else 0.0 for c in range(n_classes)])


def couple(pairwise: np.ndarray) -> np.ndarray:
    """Class probabilities from pairwise ones (Wu, Lin and Weng 2004, second method)."""
    k = len(pairwise)
    q = -pairwise * pairwise.T
    np.fill_diagonal(q, 0.0)
    q[np.diag_indices(k)] = np.square(pairwise.T).sum(1) - np.square(np.diag(pairwise))
    p = np.full(k, 1.0 / k)
    for _ in range(max(100, k)):
        step = q @ p
        value = p @ step
        if np.abs(step - value).max() < 0.005 / k:
            break
        for t in range(k):
            change = (value - step[t]) / q[t, t]
            p[t] += change
            value = (value + change * (change * q[t, t] + 2 * step[t])) / (1 + change) ** 2
            step = (step + change * q[t]) / (1 + change)
            p /= 1 + change
    return p


def tree_ensemble(x, trees: list[dict], baseline: np.ndarray) -> np.ndarray:
    """Probabilities of a boosted ensemble: sums of leaves by class, then softmax, or a sigmoid for one output.

    A tree has arrays feature (-1 at leaves), threshold, left, right, value, missing_left, and a class.
    """
    x, raw = np.asarray(x, float), np.array(baseline, float)
    for t in trees:
        at = 0
        while t["feature"][at] >= 0:
            v = x[t["feature"][at]]
            at = t["left"][at] if (t["missing_left"][at] if np.isnan(v) else v <= t["threshold"][at]) else t["right"][at]
        raw[t["class"]] += t["value"][at]
    if len(raw) == 1:
        p = 1 / (1 + np.exp(-raw[0]))
        return np.array([1 - p, p])
    e = np.exp(raw - raw.max())
    return e / e.sum()


def theil_sen(x, y) -> dict:
    """Median of pairwise slopes and of the residual intercepts."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    i, j = np.triu_indices(len(x), 1)
    dx = x[j] - x[i]
    slope = float(np.median((y[j] - y[i])[dx != 0] / dx[dx != 0])) if (dx != 0).any() else 1.0
    return {"slope": slope, "intercept": float(np.median(y - slope * x)) if len(x) else 0.0}


# --- banded alignment ----------------------------------------------------------------------------


def half_band(boundaries, half: int, n_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """For each base the first and past-last sample its band allows: ``half`` bases either side, kept monotone."""
    b = np.asarray(boundaries, np.int64)
    k = np.arange(len(b) - 1)
    lo = np.maximum.accumulate(b[np.maximum(k - half, 0)])
    hi = np.minimum.accumulate(b[np.minimum(k + half + 1, len(b) - 1)][::-1])[::-1]
    lo = np.maximum(lo, k)
    hi = np.minimum(hi, n_samples - (len(k) - 1 - k))
    return lo, np.maximum(hi, lo + 1)


def banded_path(x, levels, low, high, stay_wins: bool = False) -> list[int]:
    """Boundaries of the least-squares assignment of samples to levels in order, each level at least one sample, within a band.

    On equal costs moving on is preferred, or staying with ``stay_wins``.
    """
    x, levels = np.asarray(x, float), np.asarray(levels, float)
    n, m = len(x), len(levels)
    if not m or n < m:
        return []
    cost, moved = np.full(n, np.inf), np.zeros((m, n), bool)
    for j in range(m):
        a, b = int(low[j]), int(min(high[j], n))
        now = np.full(n, np.inf)
        for t in range(a, b):
            enter = (0.0 if t == 0 else np.inf) if j == 0 else (cost[t - 1] if t else np.inf)
            stay = now[t - 1] if t > a else np.inf
            move = enter < stay or (enter == stay and not stay_wins)
            moved[j, t] = move
            now[t] = (enter if move else stay) + (x[t] - levels[j]) ** 2
        cost = now
    if not np.isfinite(cost[n - 1]):
        return []
    out, j = [n], m - 1
    for t in range(n - 1, -1, -1):
        if moved[j, t]:
            out.append(t)
            j -= 1
            if j < 0:
                break
    return out[::-1]


def dwell_cost(dwell: float, target: float, weight: float, limit: float) -> float:
    """Quadratic below the target, logarithmic above; ``limit`` bounds it."""
    return float(min(limit, weight * ((dwell - target) / target) ** 2 if dwell < target else weight * np.log(dwell / target)))


def stay_costs(past, target: float, weight: float) -> np.ndarray:
    """Cost of a base by the samples it has past its first: quadratic in what lacks to the target, logarithmic from there on."""
    past = np.asarray(past, float)
    return weight * np.where(past < target, np.square(target - past), np.log1p(past / target))


def dwell_path(x, levels, low, high, target: float, weight: float) -> list[int]:
    """``banded_path`` with ``stay_costs`` added for each base, the shortest dwell of equals.

    Dwells over twice the target (8 at least, 256 at most) cost nothing: they are left to the signal.
    With a weight of 0 the costs are those of ``banded_path``.
    """
    x, levels = np.asarray(x, float), np.asarray(levels, float)
    n, m = len(x), len(levels)
    if not m or n < m:
        return []
    costs = stay_costs(np.arange(min(256, max(8, int(np.ceil(2 * target))))), target, weight)
    enter, began = np.full(n + 1, np.inf), np.zeros((m, n), np.int64)  # enter: the least cost of all before sample t
    enter[0] = 0.0
    for j in range(m):
        a, b = int(low[j]), int(min(high[j], n))
        fit = np.concatenate([[0.0], np.cumsum(np.square(x[a:b] - levels[j]))])
        from_ = enter[a:b] - fit[:-1]
        here = np.arange(b - a)
        best, start = np.full(b - a, np.inf), here.copy()
        for past, cost in enumerate(costs[: b - a]):
            value = from_[: b - a - past] + cost
            better = value < best[past:]
            best[past:] = np.where(better, value, best[past:])
            start[past:] = np.where(better, here[: b - a - past], start[past:])
        if b - a > len(costs):
            least = np.minimum.accumulate(from_)[: -len(costs)]
            latest = np.maximum.accumulate(np.where(from_[: -len(costs)] <= least, here[: -len(costs)], 0))
            better = least < best[len(costs) :]
            best[len(costs) :] = np.where(better, least, best[len(costs) :])
            start[len(costs) :] = np.where(better, latest, start[len(costs) :])
        enter = np.full(n + 1, np.inf)
        enter[a + 1 : b + 1] = best + fit[1:]
        began[j, a:b] = a + start
    if not np.isfinite(enter[n]):
        return []
    out = [n]
    for j in range(m - 1, -1, -1):
        out.append(int(began[j, out[-1] - 1]))
    return out[::-1]


# --- lattice decoding ----------------------------------------------------------------------------


def lattice_decode(scores, n_base: int, state_len: int, alphabet: str = "NACGT") -> str:
    """Best sequence of a conditional random field over k-mer states.

    ``scores`` is [time][state][1 + n_base]: staying, then entering from each of the states whose
    k-mer ends where this one begins. A first pass gives log posteriors of the edges, a second takes the best path over them.
    """
    s = np.asarray(scores, float).reshape(len(scores), -1, n_base + 1)
    steps, states, _ = s.shape
    k = np.arange(states)
    source = np.stack([k, *[(b * states + k) // n_base for b in range(n_base)]], 1)  # entering drops the oldest base
    forward = np.zeros((steps + 1, states))
    for t in range(steps):
        forward[t + 1] = np.logaddexp.reduce(forward[t][source] + s[t], axis=1)
    backward = np.zeros((steps + 1, states))
    for t in range(steps - 1, -1, -1):
        into = np.full(states, -np.inf)
        np.logaddexp.at(into, source, s[t] + backward[t + 1][:, None])
        backward[t] = into
    edge = forward[:-1][:, source] + s + backward[1:, :, None]
    edge = np.log(np.exp(edge - np.logaddexp.reduce(edge.reshape(steps, -1), axis=1)[:, None, None]) + 1e-8)
    best, back = np.zeros(states), np.zeros((steps, states), np.int64)
    for t in range(steps):
        total = best[source] + edge[t]
        back[t] = total.argmax(1)
        best = total[k, back[t]]
    state, out = int(best.argmax()), []
    for t in range(steps - 1, -1, -1):
        if back[t, state]:
            out.append(alphabet[1 + state % n_base])
        state = int(source[state, back[t, state]])
    return "".join(out[::-1])


# --- signal codec --------------------------------------------------------------------------------


def compress_signal(x) -> bytes:
    """Deltas, zigzag, one key bit and one or two bytes a value, then zstandard."""
    x = np.asarray(x, np.int16)
    delta = np.diff(x, prepend=np.int16(0)).astype(np.int16)
    z = ((delta.astype(np.int32) << 1) ^ (delta.astype(np.int32) >> 15)).astype(np.uint16)
    wide = z > 255
    keys = np.packbits(wide, bitorder="little").tobytes()
    both = z.astype("<u2").view(np.uint8).reshape(-1, 2)
    keep = np.stack([np.ones(len(z), bool), wide], 1)
    return pa.Codec("zstd", compression_level=1).compress(keys + both[keep].tobytes(), asbytes=True)


def decompress_signal(data: bytes, n: int) -> np.ndarray:
    """The reverse; a wrong length is an error."""
    if not n:
        return np.zeros(0, np.int16)
    raw = np.frombuffer(pa.CompressedInputStream(pa.BufferReader(data), "zstd").read(), np.uint8)
    n_keys = (n + 7) // 8
    wide = np.unpackbits(raw[:n_keys], bitorder="little")[:n].astype(bool)
    if len(raw) != n_keys + n + wide.sum():
        raise ValueError("signal data has a wrong length")
    at = n_keys + np.arange(n) + np.concatenate([[0], np.cumsum(wide)[:-1]])
    z = raw[at].astype(np.uint16)
    z[wide] |= raw[at[wide] + 1].astype(np.uint16) << 8
    delta = (z >> 1).astype(np.int16) ^ -(z & 1).astype(np.int16)
    return np.cumsum(delta, dtype=np.int16)
