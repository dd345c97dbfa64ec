"""Profile models fitted to candidates: transitions, assembly, pooled emissions, sweeps,
background mixtures, and training by decoded paths.

What a model is made of (its exemplars, its members, its moments) is small by its number of
states and passes through the driver; pools and recordings stay distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.scalars import beta_smoothed, centred_smoothed, dwell_probability, parameter_count
from spindrift.operators import profile_hmm as ph
from spindrift.operators.segments import FLOOR, Segmented, change_points, compress, forced_alignment, weave

# The loop state's moves, and the weights of the priors.
LOOP_STAY, LOOP_LEAVE = 0.01, 0.99
SELF_ALPHA, ENTRY_ALPHA, FORK_ALPHA, FLANK_ALPHA = 1.0, 0.2, 1.0, 500.0
#: Members pooled for each sub-model, the nearest first.
MEMBERS = {"cluster": 5, "shared": 50}
#: Pools and exemplars that one task or the driver may hold.
MAX_POOL = 7500


def alignment_counts(df: DataFrame, states: int, fold_gaps: bool = True) -> tuple[DataFrame, DataFrame]:
    """Counts behind the transitions: flanks (one row, over all sequences), and self moves,
    visits and entries of every state of every group.

    ``df`` has seq, grp, frame, state, where state -1 is no call. The first run of no calls is
    the flank before; the last one, if it is another, the flank after, whose end is not seen.
    No calls between have the state before them. A sequence without any state enters at 0.
    """
    w = Window.partitionBy("seq").orderBy("frame")
    all_of = Window.partitionBy("seq")
    called = F.col("state") >= 0
    d = df.withColumn("first", F.min(F.when(called, F.col("frame"))).over(all_of)).withColumn("last", F.max(F.when(called, F.col("frame"))).over(all_of))
    d = d.withColumn("held", F.last(F.when(called, F.col("state")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before, after = F.col("first").isNull() | (F.col("frame") < F.col("first")), F.col("frame") > F.col("last")
    per = d.groupBy("seq", "grp").agg(F.count_if(before).alias("before"), F.count_if(F.coalesce(after, F.lit(False))).alias("after"), F.coalesce(F.min_by("state", F.when(called, F.col("frame"))), F.lit(0)).alias("entry"))
    flanks = per.agg(F.count(F.lit(1)).alias("n_seq"), F.sum(F.greatest(F.col("before") - 1, F.lit(0))).alias("n_self"), F.sum(F.greatest(F.col("after") - 1, F.lit(0))).alias("c_self"))
    inner = d.filter((F.col("frame") >= F.col("first")) & (F.col("frame") <= F.col("last")))
    if not fold_gaps:
        inner = inner.filter(called)
    dwell = inner.groupBy("seq", "grp", F.col("held").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    by_state = dwell.groupBy("grp", "k").agg(F.sum(F.col("n") - 1).alias("self_moves"), F.count(F.lit(1)).alias("visits"))
    entries = per.groupBy("grp", F.col("entry").alias("k")).agg(F.count(F.lit(1)).alias("entries"))
    grid = df.select("grp").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(states - 1))))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    each = grid.join(by_state, ["grp", "k"], "left").join(entries, ["grp", "k"], "left").select("grp", F.col("k").cast("int").alias("k"), zero("self_moves"), zero("visits"), zero("entries"))
    return flanks, each


def smoothed_column(own: Column, leave: Column, alpha: float) -> Column:
    return (own + alpha) / (own + leave + 2 * alpha)


def estimate_transitions(df: DataFrame, states: int, flank_dwell: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Flank moves (one row), and stay and entry of every state (grp, k), from alignments."""
    flanks, each = alignment_counts(df, states)
    if flank_dwell is None:
        stay = lambda own, leave: smoothed_column(F.col(own), leave, SELF_ALPHA)
    else:
        prior = dwell_probability(flank_dwell)
        stay = lambda own, leave: (F.col(own) + FLANK_ALPHA * prior) / (F.col(own) + leave + FLANK_ALPHA)
    flanks = flanks.select(stay("n_self", F.col("n_seq")).alias("nn"), stay("c_self", F.lit(0)).alias("cc"), smoothed_column(F.col("n_seq"), F.lit(0), FORK_ALPHA).alias("ec"), F.lit(LOOP_STAY).alias("jj"), F.lit(LOOP_LEAVE).alias("jb"))
    flanks = flanks.withColumn("nb", 1 - F.col("nn")).withColumn("ej", 1 - F.col("ec"))
    mm = F.when(F.col("visits") == 0, 0.5).otherwise(smoothed_column(F.col("self_moves"), F.col("visits"), SELF_ALPHA))
    total = F.sum(F.col("entries") + ENTRY_ALPHA).over(Window.partitionBy("grp"))
    return flanks, each.select("grp", "k", mm.alias("stay"), ((F.col("entries") + ENTRY_ALPHA) / total).alias("entry"))


def transitions_of(alignments: list[list[int]], groups: list[int], states: int, flank_dwell: float | None = None) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """The same over a few alignments on the driver: flanks, stay and entry rows."""
    n_groups = max(groups) + 1
    own, visits, entries = (np.zeros((n_groups, states)) for _ in range(3))
    before = after = 0
    for path, g in zip(alignments, groups):
        path = np.asarray(path)
        called = np.flatnonzero(path >= 0)
        first, last = (called[0], called[-1]) if len(called) else (len(path), len(path))
        before, after = before + max(0, first - 1), after + max(0, len(path) - last - 2)
        inner = path[first : last + 1]
        if len(inner):
            filled = inner[np.maximum.accumulate(np.where(inner >= 0, np.arange(len(inner)), 0))]
            n = np.bincount(filled, minlength=states)
            own[g] += np.maximum(n - 1, 0)
            visits[g] += n > 0
        entries[g, inner[0] if len(inner) else 0] += 1
    if flank_dwell is None:
        nn, cc = beta_smoothed(before, len(alignments), SELF_ALPHA), beta_smoothed(after, 0, SELF_ALPHA)
    else:
        prior = dwell_probability(flank_dwell)
        nn, cc = centred_smoothed(before, len(alignments), FLANK_ALPHA, prior), centred_smoothed(after, 0, FLANK_ALPHA, prior)
    ec = beta_smoothed(len(alignments), 0, FORK_ALPHA)
    stay = np.where(visits == 0, 0.5, (own + SELF_ALPHA) / (own + visits + 2 * SELF_ALPHA))
    entry = (entries + ENTRY_ALPHA) / (entries + ENTRY_ALPHA).sum(1, keepdims=True)
    return {"nn": nn, "nb": 1 - nn, "ec": ec, "ej": 1 - ec, "jj": LOOP_STAY, "jb": LOOP_LEAVE, "cc": cc}, stay, entry


@dataclass(frozen=True)
class Candidate:
    """A region: its number, its frames (T, d) and their labels."""

    id: int
    x: np.ndarray
    labels: list[str]


@dataclass(frozen=True)
class FitConfig:
    variance: str = "medoid"
    max_members: int | None = None
    shrinkage: float = 10.0
    flank_dwell: float | None = None
    full_match: bool = False


def pooled(cuts: list[Segmented], members: list[list[Candidate]], config: FitConfig) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[list[list[int]]]]:
    """Emissions from exemplars and their members aligned to them, and the members' alignments.

    ``shared``: one variance for all states, of deviations from the exemplars' means.
    ``cluster``: each state's own moments, drawn to the exemplar's mean and the shared
    variance by ``shrinkage`` frames.
    """
    most = config.max_members or MEMBERS[config.variance]
    frames, paths = [], []
    for cut, cluster in zip(cuts, members):
        of_state = [[cut.x[cut.state == s]] for s in range(len(cut.mean))]
        found = []
        for c in cluster[:most]:
            state = forced_alignment(c.x, cut.mean, cut.var)
            if state is not None:
                for s in range(len(cut.mean)):
                    of_state[s].append(c.x[state == s])
                found.append([-1 if label == "NOISE" else int(s) + 1 for s, label in zip(state, c.labels)])
        frames.append([np.concatenate(p) for p in of_state])
        paths.append(found)
    squares = sum(((x - m) ** 2).sum(0) for cut, parts in zip(cuts, frames) for m, x in zip(cut.mean, parts))
    shared = np.maximum(squares / max(1, sum(len(x) for parts in frames for x in parts)), FLOOR)
    out = []
    for cut, parts in zip(cuts, frames):
        if config.variance == "shared":
            out.append((cut.mean, np.tile(shared, (len(cut.mean), 1))))
            continue
        means, variances = [], []
        for m, x in zip(cut.mean, parts):
            mean = (x.sum(0) + config.shrinkage * m) / (len(x) + config.shrinkage)
            own = ((x - mean) ** 2).sum(0) if len(x) else np.zeros_like(mean)
            means.append(mean)
            variances.append(np.maximum((own + config.shrinkage * shared) / (len(x) + config.shrinkage), FLOOR))
        out.append((np.stack(means), np.stack(variances)))
    return out, paths


def make_profile(exemplars: list[Candidate], max_points: int, config: FitConfig = FitConfig(), members: list[list[Candidate]] | None = None) -> ph.Profile:
    """One sub-model an exemplar, padded to the longest; state 0 is the sentinel."""
    if config.variance != "medoid" and members is None:
        raise ValueError(f"variance {config.variance} needs the exemplars' members")
    cuts = [compress(c.x, change_points(c.x, max_points)) for c in exemplars]
    emissions, extra = [(c.mean, c.var) for c in cuts], [[] for _ in cuts]
    if config.variance != "medoid":
        emissions, extra = pooled(cuts, members, config)
    states, d = max(len(m) for m, _ in emissions) + 1, emissions[0][0].shape[1]
    mean, var = np.zeros((len(emissions), states, d)), np.full((len(emissions), states, d), 1e6)
    var[:, 0] = 1.0
    for n, (m, v) in enumerate(emissions):
        mean[n, 1 : len(m) + 1], var[n, 1 : len(m) + 1] = m, v
    alignments, groups = [], []
    for n, (c, cut) in enumerate(zip(exemplars, cuts)):
        own = [s + 1 if s >= 0 else -1 for s in weave(cut.state.tolist(), c.labels)]
        alignments += [own, *extra[n]]
        groups += [n] * (1 + len(extra[n]))
    flanks, stay, entry = transitions_of(alignments, groups, states, config.flank_dwell)
    return ph.Profile.of(mean, var, entry, stay, flanks, [len(m) for m, _ in emissions])


def profile_rows(spark: SparkSession, hmm: ph.Profile) -> DataFrame:
    """A model as a table: submodel, k, mean, var, stay, entry (chances), is_last."""
    rows = [(n, k, hmm.mean[n, k].tolist(), hmm.var[n, k].tolist(), float(2 ** hmm.stay[n, k]), float(2 ** hmm.entry[n, k]), k == hmm.last[n]) for n in range(hmm.mean.shape[0]) for k in range(hmm.mean.shape[1])]
    return spark.createDataFrame(rows, "submodel int, k int, mean array<double>, var array<double>, stay double, entry double, is_last boolean")


def write_profile(spark: SparkSession, hmm: ph.Profile, path: str, **metadata) -> None:
    """States and flanks as Parquet under ``path``, and the metadata beside them as JSON."""
    profile_rows(spark, hmm).coalesce(1).write.mode("overwrite").parquet(f"{path}/states")
    spark.createDataFrame(list(hmm.flanks.items()), "move string, log2 double").coalesce(1).write.mode("overwrite").parquet(f"{path}/flanks")
    if metadata:
        spark.createDataFrame([{k: str(v) for k, v in metadata.items()}]).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_profile(spark: SparkSession, path: str) -> ph.Profile:
    rows = sorted(spark.read.parquet(f"{path}/states").collect(), key=lambda r: (r.submodel, r.k))  # a model's states
    n, k = rows[-1].submodel + 1, rows[-1].k + 1
    grid = lambda c: np.array([r[c] for r in rows]).reshape(n, k, -1)
    flanks = {r.move: r.log2 for r in spark.read.parquet(f"{path}/flanks").collect()}
    last = [next(r.k for r in rows[i * k : (i + 1) * k] if r.is_last) for i in range(n)]
    return ph.Profile(grid("mean"), grid("var"), np.log2(grid("entry")[:, :, 0]), np.log2(grid("stay")[:, :, 0]), last, flanks)


def collect_candidates(df: DataFrame) -> list[Candidate]:
    """Candidates (id, x, labels) of a filtered pool, at most ``MAX_POOL``, in the order of ids."""
    rows = df.limit(MAX_POOL + 1).collect()
    if len(rows) > MAX_POOL:
        raise ValueError(f"more than {MAX_POOL} candidates: sample or filter the pool first")
    return [Candidate(r.id, np.array(r.x, float).reshape(len(r.x), -1), list(r.labels)) for r in sorted(rows, key=lambda r: r.id)]


def score_pool(pool: list[Candidate], hmm: ph.Profile, full_match: bool) -> tuple[np.ndarray, np.ndarray]:
    """(scores a frame, scores) of all candidates."""
    raw = np.array([p.score for p in ph.decode([c.x for c in pool], hmm, None, full_match)])
    return raw / np.array([len(c.x) for c in pool]), raw


def bic_of(raw_bits: float, models: int, states: int, d: int, frames: int, variance: str) -> float:
    return parameter_count(models, states, d, variance) * math.log(frames) - 2 * raw_bits * math.log(2)


def best_exemplars(pool: list[Candidate], states: int, most: int, config: FitConfig, members: list[list[Candidate]] | None) -> Iterator[tuple[list[int], float]]:
    """Exemplars added one by one, each the one with the best total score a frame; with the BIC of each step."""
    chosen: list[int] = []
    frames = sum(len(c.x) for c in pool)
    while len(chosen) < min(most, len(pool)):
        best = None
        for k in range(len(pool)):
            if k not in chosen:
                some = [*chosen, k]
                hmm = make_profile([pool[i] for i in some], states, config, members and [members[i] for i in some])
                norm, raw = score_pool(pool, hmm, config.full_match)
                if best is None or norm.sum() > best[0]:
                    best = (norm.sum(), k, raw.sum())
        chosen.append(best[1])
        yield list(chosen), bic_of(best[2], len(chosen), states, pool[0].x.shape[1], frames, config.variance)


def sweep(spark: SparkSession, pool: list[Candidate], low: int = 3, high: int = 32, most: int | None = None, config: FitConfig = FitConfig(), members: list[list[Candidate]] | None = None) -> DataFrame:
    """states, models, bic, exemplars: one task for each number of states in [low, high).

    With ``most`` exemplars are chosen greedily, up to that many; else all are sub-models.
    """
    shared = spark.sparkContext.broadcast((pool, members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, members = shared.value
        frames = sum(len(c.x) for c in pool)
        for batch in batches:
            for states in batch.column(0).to_pylist():
                if most is None:
                    _, raw = score_pool(pool, make_profile(pool, states, config, members), config.full_match)
                    found = [(list(range(len(pool))), bic_of(raw.sum(), len(pool), states, pool[0].x.shape[1], frames, config.variance))]
                else:
                    found = list(best_exemplars(pool, states, most, config, members))
                yield pa.RecordBatch.from_arrays([pa.array([states] * len(found), pa.int64()), pa.array([len(c) for c, _ in found], pa.int64()), pa.array([float(b) for _, b in found], pa.float64()), pa.array([[pool[i].id for i in c] for c, _ in found], pa.list_(pa.int64()))], names=["states", "models", "bic", "exemplars"])

    return spark.range(low, high, 1, high - low).mapInArrow(run, "states bigint, models bigint, bic double, exemplars array<bigint>")


def best_of(results: DataFrame) -> DataFrame:
    """The row of least BIC; the fewer states, then models, among equals."""
    return results.select(F.min_by(F.struct(*results.columns), F.struct("bic", "states", "models")).alias("r")).select("r.*")


# Background


def k_means_pp(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Centres drawn in proportion to the squared distance from those before."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        share = near / near.sum() if near.sum() > 0 else np.full(len(x), 1 / len(x))
        centres.append(x[rng.choice(len(x), p=share)])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    return np.stack(centres)


def digamma(x: np.ndarray) -> np.ndarray:
    """By its recurrence up to 6, and its asymptotic series from there."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (x < 6).any():
        small = x < 6
        out = np.where(small, out - 1 / np.where(small, x, 1), out)
        x = np.where(small, x + 1, x)
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240)))


def mixture_sums(df: DataFrame, log_density: Callable[[np.ndarray], np.ndarray], k: int, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Responsibilities' sums over all vectors: weights (k), vectors and squares (k, d), log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, ll = np.zeros(k), 0.0, 0.0, 0.0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1)
            if len(x):
                each = log_density(x)
                top = each.max(1, keepdims=True)
                share = np.exp(each - top)
                ll += float((top[:, 0] + np.log(share.sum(1))).sum())
                share /= share.sum(1, keepdims=True)
                n, s, q = n + share.sum(0), s + share.T @ x, q + share.T @ (x * x)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array(n), pa.array(s.tolist()), pa.array(q.tolist()), pa.array([ll / k] * k)], names=["c", "n", "s", "q", "ll"])

    part = df.select(column).mapInArrow(run, "c bigint, n double, s array<double>, q array<double>, ll double")
    rows = part.toPandas()  # k rows a partition
    add = lambda c: np.stack([np.stack(g[c].to_list()).sum(0) for _, g in rows.groupby("c")])
    return rows.groupby("c")["n"].sum().to_numpy(), add("s"), add("q"), float(rows["ll"].sum())


def fit_noise(df: DataFrame, components: int | None = None, bayesian: bool = False, column: str = "embedding", scale: float = 1.0, rounds: int = 100, tolerance: float = 1e-3, seed: int = 0, sample: int = 10_000) -> tuple[ph.Noise, list[float]]:
    """Background from vectors: one Gaussian, a mixture of ``components``, or a Bayesian one of at
    most so many, by a Dirichlet process. Also the mean log likelihood (bound) after each round.

    Each round is one pass with sums per component. Centres start from ``sample`` vectors
    (those of the smallest hashes). Components of at most a thousandth of the weight go.
    """
    dims = df.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")).orderBy("dim").collect()
    n, mean, var = dims[0]["n"], np.array([r["mean"] for r in dims]), np.array([r["var"] for r in dims])
    if components is None:
        return ph.Noise.single(mean, np.maximum(var, FLOOR) * scale), []
    few = df.select(F.col(column).alias("x")).orderBy(F.xxhash64(column, F.lit(seed)), "x").limit(sample).collect()
    first, k, d = np.array([r["x"] for r in few], float), components, len(mean)
    centres = k_means_pp(first, k, seed)
    for _ in range(10):
        owner = ((first[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.stack([first[owner == c].mean(0) if (owner == c).any() else centres[c] for c in range(k)])
    spread = np.stack([first[owner == c].var(0) if (owner == c).any() else var for c in range(k)]) + 1e-6
    weight, trace = np.bincount(owner, minlength=k) / len(first), []
    nk, sums, squares = weight * n, weight[:, None] * n * centres, weight[:, None] * n * (spread + centres**2)
    prior = var + 1e-6
    for _ in range(rounds):
        safe = np.maximum(nk, 1e-10)[:, None]
        xk = sums / safe
        sk = np.maximum(squares / safe - xk**2, 0) + 1e-6
        if not bayesian:
            weight, centres, spread = nk / nk.sum(), xk, sk
            log_weight = np.log(np.maximum(weight, 1e-300))
            density = lambda x, m=centres, v=spread, w=log_weight: ph.emission_bits(x, m, v) * math.log(2) + w
        else:
            # Normal-gamma posteriors of each dimension, and stick-breaking weights.
            strength, freedom = 1.0 + nk, d + nk
            centres = (mean + nk[:, None] * xk) / strength[:, None]
            spread = (prior + nk[:, None] * (sk + ((xk - mean) ** 2) / strength[:, None])) / freedom[:, None]
            a, b = 1 + nk, 1 / k + np.append(np.cumsum(nk[::-1])[::-1][1:], 0)
            both = digamma(a + b)
            log_weight = digamma(a) - both + np.append(0, np.cumsum(digamma(b) - both)[:-1])
            precision = 0.5 * (d * math.log(2) + digamma(0.5 * (freedom[:, None] - np.arange(d))).sum(1) - d * np.log(freedom) - d / strength)
            density = lambda x, m=centres, v=spread, w=log_weight + precision: ph.emission_bits(x, m, v) * math.log(2) + w
            stick = a / (a + b)
            weight = stick * np.append(1, np.cumprod(1 - stick)[:-1])
            weight = weight / weight.sum()
        nk, sums, squares, ll = mixture_sums(df, density, k, column)
        trace.append(ll / n)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tolerance:
            break
    active = weight > 1e-3
    return ph.Noise(centres[active], np.maximum(spread[active], FLOOR) * scale, np.log(weight[active])), trace


# Training by decoded paths


@dataclass(frozen=True)
class TrainConfig:
    tau: float = 10.0
    self_alpha: float = 10.0
    entry_alpha: float = 10.0
    rate: float = 1.0
    update_noise: bool = True
    repeat: float = 0.999
    gap_dwell: float = 100.0


def path_statistics(frames: DataFrame, hmm: ph.Profile, noise: ph.Noise | None, value: str = "value") -> DataFrame:
    """kind, key, dim, n, mean, m2 over all recordings, merged: moments of the frames of each match
    state ("match") and, as background frames belong to their likeliest component, of these
    ("noise"); moves ("self", "leave", "entry") and totals ("score", "frames", "matched") in n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [ph.as_matrix(v) for v in batch.column("x").to_pylist()]
            paths = ph.decode(xs, hmm, noise)
            rows: list[tuple] = []
            counts: dict[tuple[str, int], float] = {}

            def add(kind: str, keys: np.ndarray) -> None:
                for key, n in zip(*np.unique(keys, return_counts=True)):
                    counts[kind, int(key)] = counts.get((kind, int(key)), 0) + float(n)

            def moments(kind: str, keys: np.ndarray, x: np.ndarray) -> None:
                for key in np.unique(keys):
                    own = x[keys == key]
                    for dim, (m, v) in enumerate(zip(own.mean(0), own.var(0))):
                        rows.append((kind, int(key), dim, float(len(own)), float(m), float(v * len(own))))

            full = [k for k, x in enumerate(xs) if len(x)]
            if full:
                state, x = np.concatenate([paths[k].state for k in full]), np.concatenate([xs[k] for k in full])
                hit = np.concatenate([paths[k].hit for k in full])
                begins, first = np.concatenate([paths[k].begins for k in full]), np.zeros(len(state), bool)
                first[np.cumsum([0] + [len(xs[k]) for k in full[:-1]])] = True
                match = state >= 0
                moments("match", state[match], x[match])
                # A hit's frame moves to the next frame of the same hit, or leaves at the hit's end.
                same = np.append((state[1:] == state[:-1]) & (hit[1:] == hit[:-1]) & ~first[1:] & ~begins[1:], False)
                add("self", state[match & same])
                add("leave", state[match & ~same])
                add("entry", state[begins])
                if noise is not None:
                    back = ~match & (state != ph.BEGIN) & ~first
                    if back.any():
                        moments("noise", noise.nats(x[back]).argmax(1), x[back])
                counts["frames", 0] = counts.get(("frames", 0), 0) + len(state)
                counts["matched", 0] = counts.get(("matched", 0), 0) + int(match.sum())
                counts["score", 0] = counts.get(("score", 0), 0) + sum(paths[k].score for k in full)
            rows += [(kind, key, -1, float(n), 0.0, 0.0) for (kind, key), n in counts.items()]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "key", "dim", "n", "mean", "m2"])

    part = ph.sequence_rows(frames.withColumn("x", F.col(value)), "x").mapInArrow(run, "kind string, key bigint, dim int, n double, mean double, m2 double")
    return merged_moments(part, "kind", "key", "dim")


def merged_moments(parts: DataFrame, *by: str) -> DataFrame:
    """Counts, means and sums of squared deviations of the union of parts that have these."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    total = parts.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), F.sum("m2").alias("_inner"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_squares"))
    return total.select(*by, "n", "mean", F.greatest(F.col("_inner") + F.col("_squares") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0)).alias("m2"))


def merge(a: tuple, b: tuple) -> tuple:
    """Two (weight, mean, sum of squares) as one."""
    n = a[0] + b[0]
    return n, a[1] + (b[1] - a[1]) * (b[0] / n), a[2] + b[2] + (b[1] - a[1]) ** 2 * (a[0] * b[0] / n)


def moved_gaussian(mean: np.ndarray, var: np.ndarray, seen: tuple, tau: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian after frames (n, mean, m2): pooled with ``tau`` frames of its own, and moved by ``rate``."""
    n, new, squares = merge((tau, mean, tau * var), seen)
    new_var = np.maximum(squares / n, FLOOR)
    if rate < 1:
        _, new, new_var = merge((1 - rate, mean, (1 - rate) * var), (rate, new, rate * new_var))
    return new, np.maximum(new_var, FLOOR)


def trained(hmm: ph.Profile, noise: ph.Noise | None, stats: DataFrame, config: TrainConfig = TrainConfig()) -> tuple[ph.Profile, ph.Noise | None, dict[str, float]]:
    """Model and background after one step, and the score a frame and matched share before it.

    States without frames, the sentinel and padding stay as they are, as do the flanks.
    """
    if not 0 < config.rate <= 1:
        raise ValueError("rate is in (0, 1]")
    table = stats.toPandas()  # states times dimensions
    moments = {(kind, key): (g["n"].iloc[0], g.sort_values("dim")["mean"].to_numpy(), g.sort_values("dim")["m2"].to_numpy()) for (kind, key), g in table[table["dim"] >= 0].groupby(["kind", "key"])}
    count = {(r.kind, r.key): r.n for r in table[table["dim"] < 0].itertuples()}
    n, k = hmm.mean.shape[:2]
    mean, var = hmm.mean.copy(), hmm.var.copy()
    for (kind, key), seen in moments.items():
        s, q = divmod(key, k)
        if kind == "match" and 1 <= q <= hmm.last[s]:
            mean[s, q], var[s, q] = moved_gaussian(mean[s, q], var[s, q], seen, config.tau, config.rate)
    grid = lambda kind: np.array([count.get((kind, x), 0.0) for x in range(n * k)]).reshape(n, k)
    stay, entry = np.exp2(hmm.stay), np.exp2(hmm.entry)
    entry = entry / entry.sum(1, keepdims=True)
    new_stay = (grid("self") + config.self_alpha * stay) / (grid("self") + grid("leave") + config.self_alpha)
    new_entry = (grid("entry") + config.entry_alpha * entry) / (grid("entry").sum(1, keepdims=True) + config.entry_alpha)
    blend = lambda old, new: np.log2((1 - config.rate) * old + config.rate * new)
    model = replace(hmm, mean=mean, var=var, stay=blend(stay, new_stay), entry=blend(entry, new_entry))
    if noise is not None and config.update_noise:
        m, v, own = noise.mean.copy(), noise.var.copy(), np.zeros(len(noise.mean))
        for c in range(len(m)):
            if ("noise", c) in moments:
                own[c] = moments["noise", c][0]
                m[c], v[c] = moved_gaussian(m[c], v[c], moments["noise", c], config.tau, config.rate)
        weight = np.exp(noise.log_weight)
        total, weight = weight.sum(), weight / weight.sum()
        new = (own + config.entry_alpha * weight) / (own.sum() + config.entry_alpha)
        noise = ph.Noise(m, v, np.log(total * ((1 - config.rate) * weight + config.rate * new)))
    frames = count.get(("frames", 0), 0.0)
    share = lambda x: count.get((x, 0), 0.0) / frames if frames else math.nan
    return model, noise, {"score_per_frame": share("score"), "match_fraction": share("matched")}


def viterbi_training(frames: DataFrame, hmm: ph.Profile, noise: ph.Noise | None, rounds: int = 5, config: TrainConfig = TrainConfig(), value: str = "value", after: Callable | None = None) -> tuple[ph.Profile, ph.Noise | None, list[dict[str, float]]]:
    """Decoding and re-estimation in turn; each round is one distributed pass."""
    history = []
    for k in range(rounds):
        stats = path_statistics(frames, hmm.for_search(config.repeat, config.gap_dwell), noise, value)
        hmm, noise, row = trained(hmm, noise, stats, config)
        history.append({"iteration": k, **row})
        if after:
            after(k, hmm, noise)
    return hmm, noise, history
