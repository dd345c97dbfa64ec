"""Profile hidden Markov models: decoding of whole recordings, hits, assignments.

All recordings of a block advance together; emissions are worked out once, as products of
matrices, and go along with the decoded states.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.scalars import log2_f32
from spindrift.operators.frames import majority
from spindrift.operators.smoothing import sequence_rows

# What a frame is in where it is in no match state.
FLANK, LOOP, TAIL, BEGIN = -1, -2, -3, -4
#: Emissions (frames times states) held at a time, but for one longer recording.
CELLS = 4_000_000


@dataclass(frozen=True)
class Profile:
    """Sub-models of states k = 0 .. K-1; state 0 is a sentinel that is never entered.

    Flank moves are base-2 logarithms in single precision; entry and self rows in double.
    """

    mean: np.ndarray  # (n, K, d)
    var: np.ndarray
    entry: np.ndarray  # (n, K) log2
    stay: np.ndarray  # (n, K) log2
    last: list[int]
    flanks: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def of(mean, var, entry, stay, flanks: dict[str, float], last=None) -> Profile:
        a = lambda x: np.asarray(x, float)
        return Profile(a(mean), a(var), np.log2(a(entry)), np.log2(a(stay)), list(last or [a(mean).shape[1] - 1] * len(mean)), {k: log2_f32(v) for k, v in flanks.items()})

    def for_search(self, repeat: float = 0.999, gap_dwell: float = 100) -> Profile:
        """A model that looks for many occurrences: it loops after a hit, and dwells between hits
        for ``gap_dwell`` frames on average. This one stays as it is."""
        if not (0 < repeat < 1 and gap_dwell > 1):
            raise ValueError("repeat is a probability, and a gap lasts more than a frame")
        p = 1 - 1 / gap_dwell
        moves = {"jj": p, "jb": 1 - p, "ej": repeat, "ec": 1 - repeat}
        return replace(self, flanks=self.flanks | {k: log2_f32(v) for k, v in moves.items()})

    def state_name(self, state: int) -> str:
        """Name of a state by its flat number: five flanks, then the match states of each sub-model."""
        if state < 5:
            return ["N", "B", "E", "C", "J"][state]
        n, k = divmod(state - 5, self.mean.shape[1])
        return f"M{n}_{k}"

    def emissions(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(means, variances) of each sub-model's own states, without sentinel and padding."""
        return [(m[1 : k + 1], v[1 : k + 1]) for m, v, k in zip(self.mean, self.var, self.last)]


@dataclass(frozen=True)
class Noise:
    """Diagonal mixture for background: (means, variances, natural-log weights)."""

    mean: np.ndarray  # (c, d)
    var: np.ndarray
    log_weight: np.ndarray

    @staticmethod
    def single(mean, var) -> Noise:
        return Noise(np.atleast_2d(np.asarray(mean, float)), np.atleast_2d(np.asarray(var, float)), np.zeros(1))

    def nats(self, x: np.ndarray) -> np.ndarray:
        """(frames, components) log densities with weights."""
        return emission_bits(x, self.mean, self.var) * math.log(2) + self.log_weight

    def bits(self, x: np.ndarray) -> np.ndarray:
        each = self.nats(x)
        top = each.max(1, keepdims=True)
        return (top[:, 0] + np.log(np.exp(each - top).sum(1))) / math.log(2)


def emission_bits(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(frames, states) log2 densities, as two products instead of a loop over states."""
    m, v = mean.reshape(-1, mean.shape[-1]), var.reshape(-1, var.shape[-1])
    const = -0.5 * (np.log(2 * math.pi * v).sum(1) + (m * m / v).sum(1))
    return ((x * x) @ (-0.5 / v).T + x @ (m / v).T + const) / math.log(2)


@dataclass
class Path:
    """Decoded frames: a match state's flat number (sub-model times K plus state) or a flank;
    where hits begin; and the log2 densities of the match states and of background."""

    score: float
    state: np.ndarray
    begins: np.ndarray
    fit: np.ndarray
    quiet: np.ndarray

    @property
    def hit(self) -> np.ndarray:
        return np.where(self.state >= 0, np.cumsum(self.begins) - 1, -1)


def decode_block(xs: list[np.ndarray], hmm: Profile, noise: Noise | None, full_match: bool) -> list[Path]:
    """Best paths of sequences (T, d), the longest first. Frame 0 emits nothing; a path
    begins before all matches and ends after them; without such a path all is tail."""
    sizes = np.array([len(x) for x in xs])
    every, begin = np.concatenate(xs), np.cumsum(sizes) - sizes
    (n, k), f, r, inf = hmm.mean.shape[:2], hmm.flanks, len(xs), -math.inf
    emit = emission_bits(every, hmm.mean, hmm.var)
    quiet = np.zeros(len(every)) if noise is None else noise.bits(every)
    entry, exits = hmm.entry.copy(), np.zeros((n, k), bool)
    exits[:, 1:] = True
    if full_match:
        entry[:, 2:] = inf
        exits[:] = False
        exits[np.arange(n), hmm.last] = True
    entry[:, 0] = inf
    live, t_max = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left"), int(sizes[0])
    came = np.zeros((t_max, r, n, k), np.int8)  # from the column before, from itself, from the begin state
    left = np.zeros((t_max, r), np.int32)  # the match state that a hit would end in
    to_tail, to_loop, from_loop = (np.zeros((t_max, r), bool) for _ in range(3))
    m = np.full((r, n, k), inf)
    s_n, s_b, s_e, s_j, s_c = np.zeros(r), np.full(r, f["nb"]), *(np.full(r, inf) for _ in range(3))
    for t in range(1, t_max):
        a = live[t]
        new, code = np.full((a, n, k), inf), came[t, :a]
        new[:, :, 1:] = m[:a, :, :-1]
        for number, way in ((1, m[:a] + hmm.stay), (2, s_b[:a, None, None] + entry)):
            better = way > new
            new[better] = way[better]
            code[better] = number
        new += emit[begin[:a] + t].reshape(a, n, k)
        new[:, :, 0] = inf
        m[:a] = new
        out = np.where(exits, new, inf).reshape(a, -1)
        left[t, :a] = out.argmax(1)
        e_before, s_e[:a] = s_e[:a].copy(), out.max(1)
        back = quiet[begin[:a] + t]
        from_flank = s_n[:a] + f["nb"]  # of the frame before
        s_n[:a] += f["nn"] + back
        stay, come = s_j[:a] + f["jj"], e_before + f["ej"]
        to_loop[t, :a] = come > stay
        s_j[:a] = np.maximum(stay, come) + back
        stay, come = s_c[:a] + f["cc"], s_e[:a] + f["ec"]
        to_tail[t, :a] = come > stay
        s_c[:a] = np.maximum(stay, come) + back
        come = s_j[:a] + f["jb"]
        from_loop[t, :a] = come > from_flank
        s_b[:a] = np.maximum(from_flank, come)
    states, begins = np.full((t_max, r), FLANK), np.zeros((t_max, r), bool)
    now, rows = np.full(r, TAIL), np.arange(r)
    flat = came.reshape(t_max, r, n * k)
    for t in range(t_max - 1, 0, -1):
        a = live[t]
        here, some = now[:a], rows[:a]
        here = np.where((here == TAIL) & to_tail[t, :a], left[t, :a], here)
        states[t, :a] = here
        match = here >= 0
        code = np.where(match, flat[t, some, np.maximum(here, 0)], -1)
        begins[t, :a] = code == 2
        step = np.where(code == 0, here - 1, here)
        step = np.where(code == 2, np.where(from_loop[t - 1, :a], LOOP, BEGIN), step)
        step = np.where((here == LOOP) & to_loop[t, :a], left[t - 1, :a], step)
        now[:a] = np.where(here == BEGIN, FLANK, step)
    states[0] = np.where(now == TAIL, TAIL, FLANK)
    paths = []
    for j, size in enumerate(sizes):
        state, at = states[:size, j], begin[j] + np.arange(size)
        paths.append(Path(float(s_c[j]), state, begins[:size, j], np.where(state >= 0, emit[at, np.maximum(state, 0)], 0.0), quiet[at]))
    return paths


def decode(xs: list[np.ndarray], hmm: Profile, noise: Noise | None = None, full_match: bool = False) -> list[Path]:
    """``decode_block`` over sequences of any order and number; memory is that of one block."""
    out: list = [None] * len(xs)
    states = hmm.mean.shape[0] * hmm.mean.shape[1]
    block: list[int] = []

    def flush() -> None:
        for k, path in zip(block, decode_block([xs[k] for k in block], hmm, noise, full_match) if block else []):
            out[k] = path
        block.clear()

    for k in sorted(range(len(xs)), key=lambda k: -len(xs[k])):
        if not len(xs[k]):
            out[k] = Path(-math.inf, np.zeros(0, int), np.zeros(0, bool), np.zeros(0), np.zeros(0))
            continue
        if block and (len(block) + 1) * len(xs[block[0]]) * states > CELLS:
            flush()
        block.append(k)
    flush()
    return out


PATH_DDL = "recording bigint, score double, n bigint, frame array<bigint>, label array<string>, state array<int>, hit array<int>, fit array<double>, quiet array<double>"


def as_matrix(rows) -> np.ndarray:
    x = np.array(rows, float)
    return x.reshape(len(rows), -1)


def decoded(frames: DataFrame, hmm: Profile, noise: Noise | None = None, full_match: bool = False, value: str = "value") -> DataFrame:
    """One row a recording: its score and, along its frames, state, hit, and log2 densities.

    ``frames`` has recording, frame, label and ``value`` (a number or an array). Whole
    recordings are decoded: cutting them would change paths. To cut very long ones all the
    same, give their pieces numbers of their own (``chunked``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = decode([as_matrix(v) for v in batch.column("x").to_pylist()], hmm, noise, full_match)
            column = lambda get, kind: pa.array([get(p) for p in paths], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("recording"), pa.array([p.score for p in paths]), pa.array([len(p.state) for p in paths], pa.int64()), batch.column("frame"), batch.column("label"),
                 column(lambda p: p.state, pa.int32()), column(lambda p: p.hit, pa.int32()), column(lambda p: p.fit, pa.float64()), column(lambda p: p.quiet, pa.float64())],
                names=[c.split()[0] for c in PATH_DDL.split(", ")],
            )

    return sequence_rows(frames.withColumn("x", F.col(value)), "label", "x").mapInArrow(run, PATH_DDL)


def chunked(frames: DataFrame, size: int) -> DataFrame:
    """``frames`` whose recordings are pieces of at most ``size`` frames, numbered apart;
    pieces of one frame go. Paths restart in each piece, so this changes results."""
    from pyspark.sql import Window

    piece = frames.withColumn("_p", F.floor(F.col("frame") / size))
    n = F.count(F.lit(1)).over(Window.partitionBy("recording", "_p"))
    kept = piece.withColumn("_n", n).filter("_n > 1")
    number = F.xxhash64("recording", "_p")
    return kept.withColumn("source", F.col("recording")).withColumn("recording", number).drop("_p", "_n")


def path_frames(paths: DataFrame, states: int) -> DataFrame:
    """recording, frame, label, state, hit, fit, quiet, submodel, k: a row for each matched frame of the paths."""
    each = paths.select("recording", F.explode(F.arrays_zip("frame", "label", "state", "hit", "fit", "quiet")).alias("f")).select("recording", "f.*").filter("state >= 0")
    return each.withColumn("submodel", F.floor(F.col("state") / states).cast("int")).withColumn("k", (F.col("state") % states).cast("int"))


def hits(paths: DataFrame, states: int, with_noise: bool = True, hop: int = 2560, rate: int = 44100) -> DataFrame:
    """The hit table: one row a hit, numbered along its recording.

    ``stop`` is exclusive, as are samples and times. The class is the most frequent label
    with UP and DOWN as WHISTLE (the first seen among equals), its share the confidence;
    only whistles have a direction. Without a noise model background scores are null.
    """
    each = path_frames(paths, states).withColumn("pooled", F.when(F.col("label").isin("UP", "DOWN"), "WHISTLE").otherwise(F.col("label")))
    quiet = F.avg("quiet") if with_noise else F.lit(None).cast("double")
    spans = each.groupBy("recording", "hit").agg(
        F.first("submodel").alias("submodel"), F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"), F.avg("fit").alias("mean_emission"), quiet.alias("mean_noise"),
        F.count_if(F.col("label") == "UP").alias("up"), F.count_if(F.col("label") == "DOWN").alias("down"),
    )
    classes = majority(each, ["recording", "hit"], F.col("pooled"), F.col("frame"))
    both = spans.join(classes, ["recording", "hit"])
    direction = F.when(F.col("label") == "WHISTLE", F.when(F.col("up") > F.col("down"), "UP").when(F.col("down") > F.col("up"), "DOWN").otherwise("mixed"))
    return both.select(
        "recording", "hit", "submodel", "start", "stop", (F.col("stop") - F.col("start")).alias("n_frames"), (F.col("start") * hop).alias("start_sample"), (F.col("stop") * hop).alias("stop_sample"),
        (F.col("start") * hop / rate).alias("start_time_s"), (F.col("stop") * hop / rate).alias("stop_time_s"), "mean_emission", "mean_noise", (F.col("mean_emission") - F.col("mean_noise")).alias("mean_llr"),
        F.col("label").alias("classification"), F.col("share").alias("confidence"), direction.alias("direction"),
    )


def aligned_slots(paths: DataFrame, submodels: int, states: int, per_column: int = 2, flank: int = 2) -> DataFrame:
    """recording, slot, submodel, k, frame: each recording laid out in the same slots, a frame or silence (null) in each.

    First come ``flank`` slots of what precedes the first hit (its frames from the start, but for
    the one before the hit; frame 0 in any case), then ``per_column`` slots of each state of each
    sub-model (the sentinel's stay silent) with its earliest frames, whatever their hits, then
    ``flank`` slots from the last matched frame on. Without a hit, the last slots hold the first
    frames and all others are silent. Slots are one hop long, so they follow without overlap.
    """
    from pyspark.sql import Window

    columns = submodels * states * per_column
    place = F.row_number().over(Window.partitionBy("recording", "state").orderBy("frame"))
    matched = path_frames(paths, states).select("recording", "state", "frame", place.alias("o")).filter(F.col("o") <= per_column)
    matched = matched.select("recording", (flank + F.col("state") * per_column + F.col("o") - 1).cast("int").alias("slot"), "frame")
    hit = F.transform("state", lambda s: s >= 0)
    ends = paths.select("recording", "frame", F.array_position(hit, True).cast("int").alias("first"), F.array_position(F.reverse(hit), True).cast("int").alias("from_end"))
    # first: 1-based place of the first matched frame, 0 without any; the last matched frame is from_end places from the end.
    front = F.slice("frame", F.lit(1), F.when(F.col("first") > 0, F.least(F.lit(flank), F.greatest(F.col("first") - 2, F.lit(1)))).otherwise(0))
    back = F.slice("frame", F.when(F.col("first") > 0, F.size("frame") - F.col("from_end") + 1).otherwise(1), F.lit(flank))
    lead = ends.select("recording", F.posexplode(front).alias("slot", "frame"))
    tail = ends.select("recording", F.posexplode(back).alias("slot", "frame")).withColumn("slot", F.col("slot") + flank + columns)
    # A recording's filled slots are few, however long it is.
    filled = matched.unionByName(lead).unionByName(tail).groupBy("recording").agg(F.map_from_entries(F.collect_list(F.struct("slot", "frame"))).alias("at"))
    every = filled.select("recording", "at", F.explode(F.sequence(F.lit(0), F.lit(2 * flank + columns - 1))).alias("slot"))
    state = F.when((F.col("slot") >= flank) & (F.col("slot") < flank + columns), F.floor((F.col("slot") - flank) / per_column).cast("int"))
    return every.select("recording", "slot", F.floor(state / states).cast("int").alias("submodel"), (state % states).alias("k"), F.try_element_at("at", F.col("slot")).alias("frame"))


def assign_submodels(paths: DataFrame, states: int) -> DataFrame:
    """Sub-model of most matched frames of each recording; -1 without any; the first seen wins a tie."""
    per = path_frames(paths, states).groupBy("recording", "submodel").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("seen"))
    best = per.groupBy("recording").agg(F.max_by("submodel", F.struct("n", -F.col("seen"))).alias("submodel"))
    return paths.select("recording", "score", "n").join(best, "recording", "left").select("recording", F.coalesce("submodel", F.lit(-1)).alias("submodel"), (F.col("score") / F.col("n")).alias("score_norm"))


def well_fit(assigned: DataFrame, threshold: float = 34.0) -> DataFrame:
    """Rows whose score a frame is below the threshold, which counts as a good fit."""
    return assigned.filter(F.col("score_norm") < threshold)


def path_score(hmm: Profile, x: np.ndarray, path: Path, noise: Noise | None) -> float:
    """Score of a decoded path, worked out move by move (for checks)."""
    f, k = hmm.flanks, hmm.mean.shape[1]
    emit = emission_bits(x, hmm.mean, hmm.var)
    quiet = np.zeros(len(x)) if noise is None else noise.bits(x)
    total, t = 0.0, 0
    for hit in range(int(path.begins.sum())):
        span = np.flatnonzero(path.hit == hit)
        first = int(span[0])
        if hit == 0:
            total += sum(f["nn"] + quiet[u] for u in range(1, first - 1)) + f["nb"]
        else:
            total += f["ej"] + quiet[t + 1] + sum(f["jj"] + quiet[u] for u in range(t + 2, first)) + f["jb"]
        for before, u in zip([None, *span], span):
            s, q = divmod(int(path.state[u]), k)
            total += emit[u, path.state[u]] + (hmm.entry[s, q] if before is None else hmm.stay[s, q] if path.state[before] == path.state[u] else 0)
        t = int(span[-1])
    return total + f["ec"] + quiet[t] + sum(f["cc"] + quiet[u] for u in range(t + 1, len(x)))
