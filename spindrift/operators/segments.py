"""Sequences cut into states: change points, compression, alignment to states, segmentation.

``Segmented`` and the functions over arrays treat one sequence; the operators run them over
tables of sequences, one row a sequence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least variance of a state.
FLOOR = 0.1


@dataclass
class Segmented:
    state: np.ndarray  # (T,)
    mean: np.ndarray  # (K, d)
    var: np.ndarray
    x: np.ndarray  # (T, d)

    @property
    def squared_error(self) -> float:
        return float(((self.x - self.mean[self.state]) ** 2).sum())


def change_points(x: np.ndarray, k: int) -> list[int]:
    """Both ends and the ``k`` highest strict local maxima of the adjacent-distance profile, in order.

    The profile has a value fewer than the sequence, so its last end is the last frame but
    one. An end may stand twice.
    """
    profile = np.sqrt((np.diff(x, axis=0) ** 2).sum(1))
    inner = np.flatnonzero((profile[1:-1] > profile[:-2]) & (profile[1:-1] > profile[2:])) + 1
    highest = inner[np.argsort(-profile[inner], kind="stable")][: max(0, k)]
    return sorted([0, *highest.tolist(), len(profile) - 1])


def compress(x: np.ndarray, points: list[int], rounds: int = 10) -> Segmented:
    """States around change points. Frames begin with the nearer of the two points around
    them; in each round every state takes the moments of its frames, and every frame goes to
    the nearest of the states whose neighbouring points enclose it, the lowest among equals.

    Moments are those before the last round's moves. A state without frames keeps what it
    had: at first its point's frame, and variance 1.
    """
    at, n = np.asarray(points), len(x)
    k = len(at)
    state = np.full(n, k - 1)
    for s in range(k - 1):
        middle = at[s] + (at[s + 1] - at[s]) // 2
        state[at[s] : middle], state[middle : at[s + 1]] = s, s + 1
    mean, var = x[np.minimum(at, n - 1)].astype(float), np.ones((k, x.shape[1]))
    frames = np.arange(n)
    # A state reaches from the point before it to the one after it, the last one to the end.
    begin, end = at[np.maximum(np.arange(k) - 1, 0)], np.append(at[1:], n)
    allowed = (frames[:, None] >= begin) & (frames[:, None] < end)
    for _ in range(rounds):
        for s in range(k):
            own = x[state == s]
            if len(own):
                mean[s], var[s] = own.mean(0), np.maximum(own.var(0), FLOOR)
        apart = np.where(allowed, ((x[:, None] - mean[None]) ** 2).sum(-1), math.inf)
        reached = allowed.any(1)
        state = np.where(reached, apart.argmin(1), state)
    return Segmented(state, mean, var, x)


def gaussian_nats(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(frames, states) log densities of diagonal Gaussians."""
    return -0.5 * (((x[:, None] - mean[None]) ** 2 / var[None]).sum(-1) + np.log(2 * math.pi * var).sum(-1))


def forced_alignment(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray | None:
    """Likeliest way through all states from left to right; None with fewer frames than states.

    A frame moves on only where that is strictly likelier than to stay.
    """
    fit = gaussian_nats(x, mean, var)
    t_max, k = fit.shape
    if t_max < k:
        return None
    score = np.full(k, -math.inf)
    score[0] = fit[0, 0]
    moved = np.zeros((t_max, k), bool)
    for t in range(1, t_max):
        before = np.append(-math.inf, score[:-1])
        moved[t] = before > score
        score = np.maximum(score, before) + fit[t]
    state = np.empty(t_max, np.int64)
    state[-1] = k - 1
    for t in range(t_max - 1, 0, -1):
        state[t - 1] = state[t] - moved[t, state[t]]
    return state


def moments(x: np.ndarray, state: np.ndarray, k: int) -> Segmented:
    """States' own moments; every state has a frame."""
    parts = [x[state == s] for s in range(k)]
    return Segmented(state, np.stack([p.mean(0) for p in parts]), np.stack([np.maximum(p.var(0), FLOOR) for p in parts]), x)


def even(n: int, k: int) -> np.ndarray:
    """``n`` frames in ``k`` states of about equal length."""
    edges = np.round(np.linspace(0, n, k + 1)).astype(int)
    return np.repeat(np.arange(k), np.diff(edges))


def resegmented(x: np.ndarray, state: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Moments and alignment in turn, until the alignment stays."""
    for _ in range(rounds):
        s = moments(x, state, k)
        new = forced_alignment(x, s.mean, s.var)
        if new is None or (new == state).all():
            break
        state = new
    return state


def least_squares(x: np.ndarray, k: int) -> np.ndarray:
    """States of the ``k`` segments with least squared error about their means."""
    n = len(x)
    s1 = np.vstack([np.zeros(x.shape[1]), x.cumsum(0)])
    s2 = np.append(0.0, (x**2).sum(1).cumsum())
    best, cuts = np.full(n + 1, math.inf), np.zeros((k, n + 1), int)
    best[0] = 0.0
    for j in range(k):
        new = np.full(n + 1, math.inf)
        for stop in range(j + 1, n + 1):
            a = np.arange(j, stop)
            error = s2[stop] - s2[a] - ((s1[stop] - s1[a]) ** 2).sum(1) / (stop - a)
            total = best[a] + error
            cuts[j, stop] = a[total.argmin()]
            new[stop] = total.min()
        best = new
    edges = [n]
    for j in range(k - 1, -1, -1):
        edges.append(int(cuts[j, edges[-1]]))
    return np.repeat(np.arange(k), np.diff(edges[::-1]))


#: Ways to cut a sequence into as many states as it has change points (or into at most ``limit``).
STRATEGIES = ("changepoint", "changepoint+kmeans", "flat", "flat+kmeans", "optimal", "flat-max")


def segment(x: np.ndarray, max_points: int, strategy: str = "changepoint", limit: int = 12) -> Segmented:
    points = change_points(x, max_points)
    k, found = len(points), None
    if strategy in ("changepoint", "changepoint+kmeans"):
        found = compress(x, points)
    if strategy == "changepoint":
        return found
    if strategy == "changepoint+kmeans":
        aligned = forced_alignment(x, found.mean, found.var)
        return found if aligned is None else moments(x, resegmented(x, aligned, k), k)
    if strategy == "flat-max":
        k = limit
    k = min(k, len(x))
    state = least_squares(x, k) if strategy == "optimal" else even(len(x), k)
    if strategy == "flat+kmeans":
        state = resegmented(x, state, k)
    elif strategy not in STRATEGIES:
        raise ValueError(f"one of {STRATEGIES}, not {strategy}")
    return moments(x, state, k)


def weave(states: list[int], labels: list[str]) -> list[int]:
    """States along frames: the cursor advances on frames with signal only; NOISE gets -1."""
    at = iter(states)
    return [int(next(at)) if x != "NOISE" else -1 for x in labels]


SEGMENT_DDL = "id bigint, state int, n bigint, mean array<double>, var array<double>"


def rows_of(batch: pa.RecordBatch, name: str = "x") -> list[np.ndarray]:
    return [np.array(v, float).reshape(len(v), -1) for v in batch.column(name).to_pylist()]


def compressed(seqs: DataFrame, max_points: int, strategy: str = "changepoint") -> DataFrame:
    """Frames and moments of each state of each sequence (id, x: array of numbers or arrays).

    Sequences of fewer than two frames have no profile and give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x in zip(batch.column("id").to_pylist(), rows_of(batch)):
                if len(x) > 1:
                    found = segment(x, max_points, strategy)
                    n = np.bincount(found.state, minlength=len(found.mean))
                    rows += [(i, s, int(n[s]), found.mean[s].tolist(), found.var[s].tolist()) for s in range(len(found.mean))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "state", "n", "mean", "var"])

    return seqs.select("id", "x").mapInArrow(run, SEGMENT_DDL)


def aligned(seqs: DataFrame, mean: np.ndarray, var: np.ndarray) -> DataFrame:
    """id, frame, state: each sequence aligned to given states; shorter ones than these are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, x in zip(batch.column("id").to_pylist(), rows_of(batch)):
                state = forced_alignment(x, mean, var) if len(x) else None
                if state is not None:
                    ids.append(i)
                    found.append(state)
            n = [len(s) for s in found]
            frames = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0, int)
            states = np.concatenate(found) if n else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n), pa.int64()), pa.array(frames, pa.int64()), pa.array(states, pa.int32())], names=["id", "frame", "state"])

    return seqs.select("id", "x").mapInArrow(run, "id bigint, frame bigint, state int")


STATS_DDL = "id bigint, k int, monotone boolean, empty int, sse_per_frame double, shortest bigint"


def segmentation_stats(seqs: DataFrame, max_points: int, strategy: str) -> DataFrame:
    """Per sequence: states, whether they only go on, empty ones, squared error a frame, shortest state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x in zip(batch.column("id").to_pylist(), rows_of(batch)):
                if len(x) > 1:
                    s = segment(x, max_points, strategy)
                    n = np.bincount(s.state, minlength=len(s.mean))
                    rows.append((i, len(n), bool((np.diff(s.state) >= 0).all()), int((n == 0).sum()), s.squared_error / len(x), int(n[n > 0].min())))
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.float64(), pa.int64()]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "k", "monotone", "empty", "sse_per_frame", "shortest"])

    return seqs.select("id", "x").mapInArrow(run, STATS_DDL)


def strategy_summary(seqs: DataFrame, max_points: int, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """One row a strategy over all sequences."""
    out = None
    for name in strategies:
        s = segmentation_stats(seqs, max_points, name)
        row = s.agg(F.avg("k").alias("mean_k"), F.avg(F.col("monotone").cast("double")).alias("monotone"), F.avg((F.col("empty") > 0).cast("double")).alias("with_empty"), F.avg("sse_per_frame").alias("sse_per_frame"), F.percentile(F.col("shortest").cast("double"), 0.5).alias("median_shortest"))
        row = row.select(F.lit(name).alias("strategy"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def least_errors(seqs: DataFrame, k: int) -> DataFrame:
    """``seqs`` with sse: the least squared error of ``k`` segments; null for fewer frames than these."""

    @F.pandas_udf("double")
    def error(xs):
        import pandas as pd

        rows = [np.array(x.tolist() if hasattr(x, "tolist") else x, float).reshape(len(x), -1) for x in xs]
        return pd.Series([moments(x, least_squares(x, k), k).squared_error if len(x) >= k else None for x in rows], dtype="float64")

    return seqs.withColumn("sse", error("x"))
