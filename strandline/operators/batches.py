"""Alignment and panel scoring of whole Arrow batches: reads of one shape are one matrix, and a step is one array operation for all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- a band that moves with the best ----------------------------------------------------------------


def moving_band_paths(x: np.ndarray, levels: np.ndarray, maps: np.ndarray, width: int, x_drop: float | None = None) -> np.ndarray:
    """Boundaries (reads x bases + 1) of the least-squares assignment of samples to levels in order, in a band of ``width`` samples.

    x: reads x samples, levels: reads x bases, maps: reads x (bases + 1), a first guess. The first band starts
    at sample 0; each further one is centred half an average base behind the place where the last base ends
    best (least cost a sample, the latest of equals), never before the last band and never apart from it. The last band
    runs to the end. A read whose costs grow by more than ``x_drop`` over its best band, or that the
    bands do not lead to the end, keeps its guess, as does one with fewer samples than bases.
    """
    reads, n = x.shape
    m = levels.shape[1]
    out = np.array(maps, np.int64).reshape(reads, m + 1)
    if not m or n < m or not reads:
        return out
    width = max(width, 2)
    enter = np.full((reads, n + 1), np.inf)  # least cost of the bases so far, ending before each sample
    enter[:, 0] = 0.0
    start, last_end = np.zeros(reads, np.int64), np.zeros(reads, np.int64)
    fine, least_seen = np.ones(reads, bool), np.full(reads, np.inf)
    starts, began = [], []
    row = np.arange(reads)[:, None]
    for j in range(m):
        end = np.minimum(start + width, n - (m - 1 - j)) if j < m - 1 else np.full(reads, n)
        end = np.maximum(end, start + 1)
        span = int((end - start).max())
        at = start[:, None] + np.arange(span)
        inside = at < np.minimum(end, n)[:, None]
        clipped = np.minimum(at, n - 1)
        fit = np.cumsum(np.square(x[row, clipped] - levels[:, j : j + 1]), 1)
        past = np.concatenate([np.zeros((reads, 1)), fit[:, :-1]], 1)
        reach = np.where(inside, enter[row, clipped] - past, np.inf)
        least = np.minimum.accumulate(reach, 1)
        places = np.where(reach <= least, np.arange(span), 0)
        began.append(np.maximum.accumulate(places, 1))
        score = np.where(inside, least + fit, np.inf)
        starts.append(start.copy())
        enter = np.full((reads, n + 1), np.inf)
        np.put_along_axis(enter, np.where(inside, at + 1, 0), np.where(inside, score, np.inf), 1)
        enter[:, 0] = np.inf
        now = score.min(1)
        least_seen = np.minimum(least_seen, now)
        fine &= np.isfinite(now) & ((now <= least_seen + x_drop) if x_drop is not None else True)
        mean = score / (at + 1)
        best = at[:, ::-1][np.arange(reads), mean[:, ::-1].argmin(1)] + 1
        last_end = np.minimum(end, n)
        start = np.clip(best + n // m // 2 - width // 2, start, last_end - 0)
        start = np.minimum(np.maximum(start, j + 1), n - (m - 1 - j) if j < m - 1 else n)
    fine &= np.isfinite(enter[:, n])
    path = np.zeros((reads, m + 1), np.int64)
    path[:, m] = n
    for j in range(m - 1, -1, -1):
        k = np.clip(path[:, j + 1] - 1 - starts[j], 0, began[j].shape[1] - 1)
        path[:, j] = starts[j] + began[j][np.arange(reads), k]
    out[fine] = path[fine]
    return out


def align_moving_band(reads: DataFrame, width: int, x_drop: float | None = None) -> DataFrame:
    """(id, boundaries) of reads (id, x, levels, boundaries: the guess), by ``moving_band_paths``. A null array gives null."""

    def run(batches):
        for t in batches:
            found: list = [None] * len(t)
            shapes: dict = {}
            for k, (x, levels, guess) in enumerate(zip(t.x, t.levels, t.boundaries)):
                if x is not None and levels is not None and guess is not None:
                    shapes.setdefault((len(x), len(levels)), []).append(k)
            for rows in shapes.values():
                stack = lambda c, kind: np.stack([np.asarray(t[c].iloc[k], kind) for k in rows])  # noqa: B023, E731
                for k, path in zip(rows, moving_band_paths(stack("x", float), stack("levels", float), stack("boundaries", np.int64), width, x_drop)):
                    found[k] = path.tolist()
            yield pd.DataFrame({"id": t.id, "boundaries": pd.Series(found, dtype=object, index=t.index)})

    typed = reads.select("id", F.col("x").cast("array<double>").alias("x"), F.col("levels").cast("array<double>").alias("levels"), F.col("boundaries").cast("array<bigint>").alias("boundaries"))
    return typed.mapInPandas(run, f"id {dict(reads.dtypes)['id']}, boundaries array<bigint>")


# --- panels of references under a lattice --------------------------------------------------------------


class PrefixCells:
    """Cells of a panel of references under a lattice of k-mer states, shared by references with a common prefix.

    A cell is a prefix of a reference with a state: until a whole k-mer has been emitted the state's older
    bases are open, so a prefix of j bases has n_base^(state_len - j) cells, and one from state_len bases on. A
    cell stays, or is entered from the cells of the prefix one base shorter.
    """

    def __init__(self, references: list[str], n_base: int, state_len: int, alphabet: str = "NACGT"):
        if not references:
            raise ValueError("no references")
        if len(alphabet) != n_base + 1:
            raise ValueError(f"an alphabet of {len(alphabet)} symbols for {n_base} bases")
        states = n_base**state_len
        digit = {c: i for i, b in enumerate(alphabet[1:]) for c in (b, b.lower())}
        first: dict[str, int] = {"": 0}
        state, sources, edges = list(range(states)), [[]] * states, [[]] * states
        self.finals, self.unshared = [], 0
        for ref in references:
            if len(ref) < state_len or any(c not in digit for c in ref):
                raise ValueError(f"{ref!r} is no reference for states of {state_len} bases")
            bases = [digit[c] for c in ref]
            self.unshared += sum(n_base ** max(state_len - j, 0) for j in range(len(ref) + 1))
            name = "".join(alphabet[1 + b] for b in bases)
            code = 0
            for j in range(1, len(bases) + 1):
                code = (code * n_base + bases[j - 1]) % states
                if name[:j] in first:
                    continue
                before, open_ = first[name[: j - 1]], n_base ** max(state_len - j, 0)
                first[name[:j]] = len(state)
                for u in range(open_):
                    state.append(u * n_base ** min(j, state_len) + code)
                    dropped = range(n_base) if j <= state_len else [bases[j - 1 - state_len]]
                    sources.append([before + (d * open_ + u if j <= state_len else 0) for d in dropped])
                    edges.append([1 + d for d in dropped])
            self.finals.append(first[name])
        self.state, self.states, self.n_base = np.array(state), states, n_base
        fan = max(map(len, sources))
        pad = lambda rows, fill: np.array([r + [fill] * (fan - len(r)) for r in rows])
        self.source, self.edge = pad(sources, len(state)), pad(edges, 0)  # one more cell, never reached

    def scores(self, lattice: np.ndarray) -> np.ndarray:
        """log P(reference | signal), reads x references, of lattices reads x steps x states x (1 + n_base): staying, then entering by the dropped base."""
        reads, steps = lattice.shape[:2]
        k = np.arange(self.states)
        whole_source = np.stack([k, *[(b * self.states + k) // self.n_base for b in range(self.n_base)]], 1)
        whole = np.zeros((reads, self.states))
        alpha = np.full((reads, len(self.state) + 1), -np.inf)
        alpha[:, : self.states] = 0.0
        with np.errstate(invalid="ignore"):
            for t in range(steps):
                s = lattice[:, t]
                whole = np.logaddexp.reduce(whole[:, whole_source] + s, axis=2)
                stay = alpha[:, :-1] + s[:, self.state, 0]
                moved = np.logaddexp.reduce(alpha[:, self.source] + s[:, self.state[:, None], self.edge], axis=2)
                alpha[:, :-1] = np.logaddexp(stay, moved)
        return alpha[:, self.finals] - np.logaddexp.reduce(whole, axis=1)[:, None]


def score_panel(reads: DataFrame, references: list[str], n_base: int, state_len: int, alphabet: str = "NACGT", most_cells: int = 1_000_000) -> DataFrame:
    """(id, log_p: one for each reference, in order) of reads (id, scores: the lattice, flat). A null lattice gives null.

    The panel travels to the tasks, so its cells are bounded (``most_cells``); a longer one is refused.
    """
    cells = PrefixCells(references, n_base, state_len, alphabet)
    if len(cells.state) > most_cells:
        raise ValueError(f"{len(cells.state)} cells; at most {most_cells} can be used")
    step = cells.states * (n_base + 1)
    at_once = max(1, 4_000_000 // (len(cells.state) * (n_base + 1)))

    def run(batches):
        for t in batches:
            found: list = [None] * len(t)
            shapes: dict = {}
            for k, s in enumerate(t.scores):
                if s is not None:
                    shapes.setdefault(len(s) // step, []).append(k)
            for steps, rows in shapes.items():
                for a in range(0, len(rows), at_once):
                    part = rows[a : a + at_once]
                    lattice = np.stack([np.asarray(t.scores.iloc[k], float)[: steps * step] for k in part]).reshape(len(part), steps, cells.states, n_base + 1)
                    for k, p in zip(part, cells.scores(lattice)):
                        found[k] = p.tolist()
            yield pd.DataFrame({"id": t.id, "log_p": pd.Series(found, dtype=object, index=t.index)})

    return reads.select("id", F.col("scores").cast("array<double>").alias("scores")).mapInPandas(run, f"id {dict(reads.dtypes)['id']}, log_p array<double>")
