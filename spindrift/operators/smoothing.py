"""Labels smoothed along recordings: the best path through a small chain of labels.

All recordings of an Arrow batch advance together, those of like length in one block, so a
step is a few array operations whatever their number. A recording is one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.frames import runs
from spindrift.sources.tables import LABELS

# The labels' kinds. Labels of one kind follow each other as freely as themselves.
KIND = {"NOISE": "noise", "UP": "whistle", "DOWN": "whistle", "ECHO": "echo", "BURST": "burst"}
#: Cells of a block of recordings: their number times the longest one's frames times states.
CELLS = 4_000_000


@dataclass(frozen=True)
class Chain:
    """States that each show labels, and the chances of moving between them.

    ``merge`` (labels, states): a state's chance of a frame is the sum of its labels'.
    """

    move: np.ndarray
    merge: np.ndarray
    #: What a state shows: a label's number, or -1 for the likelier of UP and DOWN.
    shows: list[int]


def own_label(label: int) -> np.ndarray:
    return np.eye(len(LABELS))[label]


def two_level(stay: float = 300.0) -> Chain:
    """One state a label; moves within a kind weigh ``stay``, all others 1."""
    kinds = np.array([KIND[x] for x in LABELS])
    weight = np.where(kinds[:, None] == kinds[None, :], stay, 1.0)
    return Chain(weight / weight.sum(1, keepdims=True), np.eye(len(LABELS)), list(range(len(LABELS))))


def lasting_noise(frames: int, stay: float = 300.0) -> Chain:
    """``two_level`` where NOISE lasts at least so many frames: one frame in each of a row of states."""
    plain, noise = two_level(stay).move, LABELS.index("NOISE")
    signal = [k for k in range(len(LABELS)) if k != noise]
    shows = [noise] * frames + signal
    move = np.zeros((len(shows), len(shows)))
    move[np.arange(frames - 1), np.arange(1, frames)] = 1
    inner = frames + np.arange(len(signal))
    move[frames - 1, frames - 1] = plain[noise, noise]
    move[frames - 1, inner] = plain[noise, signal]
    move[inner, 0] = plain[signal, noise]
    move[np.ix_(inner, inner)] = plain[np.ix_(signal, signal)]
    return Chain(move, np.stack([own_label(k) for k in shows], axis=1), shows)


def via_noise(leave: float, durations: dict[str, float]) -> Chain:
    """Kinds that are only left for NOISE, each lasting ``durations[kind]`` frames on average."""
    kinds = list(dict.fromkeys(KIND.values()))
    move = np.zeros((len(kinds), len(kinds)))
    for k, kind in enumerate(kinds):
        if kind == "noise":
            move[k] = leave / (len(kinds) - 1)
            move[k, k] = 1 - leave
        else:
            move[k, k], move[k, kinds.index("noise")] = 1 - 1 / durations[kind], 1 / durations[kind]
    merge = np.array([[float(KIND[x] == kind) for kind in kinds] for x in LABELS])
    shows = [-1 if kind == "whistle" else next(k for k, x in enumerate(LABELS) if KIND[x] == kind) for kind in kinds]
    return Chain(move, merge, shows)


def best_paths(emissions: list[np.ndarray], move: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Best path of each of some sequences of log emissions (T, S), and their scores.

    All begin evenly; of equal scores the lowest state wins.
    """
    sizes = np.array([len(e) for e in emissions])
    order = np.argsort(-sizes, kind="stable")
    sizes, s = sizes[order], len(move)
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    flat, begin = np.concatenate([emissions[k] for k in order]), np.cumsum(sizes) - sizes
    score = flat[begin] - math.log(s)
    came = np.zeros((sizes[0], len(sizes), s), np.int8)
    for t in range(1, sizes[0]):
        m = live[t]
        ways = score[:m, :, None] + move
        came[t, :m] = ways.argmax(1)
        score[:m] = ways.max(1) + flat[begin[:m] + t]
    state, found = score.argmax(1), np.zeros((sizes[0], len(sizes)), np.int64)
    for t in range(sizes[0] - 1, -1, -1):
        m = live[t]
        found[t, :m] = state[:m]
        if t:
            state[:m] = came[t, np.arange(m), state[:m]]
    paths, scores = [np.zeros(0, np.int64)] * len(sizes), np.empty(len(sizes))
    for place, k in enumerate(order):
        paths[k], scores[k] = found[: sizes[place], place], score[place].max()
    return paths, scores


def in_blocks(sizes: list[int], states: int) -> Iterator[list[int]]:
    """Sequences, longest first, in blocks of at most ``CELLS`` cells (or of one sequence)."""
    block: list[int] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if block and (len(block) + 1) * sizes[block[0]] * states > CELLS:
            yield block
            block = []
        block.append(k)
    if block:
        yield block


def sequence_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One row a recording: arrays of its frames' numbers and columns, in the order of frames."""
    packed = df.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("frame", *columns))).alias("_s"))
    return packed.select("recording", *[F.col(f"_s.{c}").alias(c) for c in ("frame", *columns)])


def label_probabilities(label: Column, certainty: float = 0.6) -> Column:
    """Probabilities that stand for a bare label: ``certainty`` on it, the rest even."""
    rest = (1 - certainty) / (len(LABELS) - 1)
    return F.array(*[F.when(label == x, certainty).otherwise(rest) for x in LABELS])


def smoothed_rows(df: DataFrame, chain: Chain | None = None) -> DataFrame:
    """recording, frame, raw, label (arrays along the recording) and the path's score.

    ``df`` has recording, frame, label, probs (in the order of the labels).
    """
    chain = chain or two_level()
    up, down = LABELS.index("UP"), LABELS.index("DOWN")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(divide="ignore"):
            move = np.log(chain.move)
        for batch in batches:
            probs = [np.array(p, float).reshape(-1, len(LABELS)) for p in batch.column("probs").to_pylist()]
            labels: list = [None] * len(probs)
            scores = np.zeros(len(probs))
            for block in in_blocks([len(p) for p in probs], len(move)):
                with np.errstate(divide="ignore"):
                    paths, found = best_paths([np.log(probs[k] @ chain.merge) for k in block], move)
                for k, path, score in zip(block, paths, found):
                    shown = np.array(chain.shows)[path]
                    likelier = np.where(probs[k][:, up] >= probs[k][:, down], up, down)
                    labels[k], scores[k] = [LABELS[x] for x in np.where(shown < 0, likelier, shown)], score
            yield pa.RecordBatch.from_arrays([batch.column("recording"), batch.column("frame"), batch.column("raw"), pa.array(labels, pa.list_(pa.string())), pa.array(scores)], names=["recording", "frame", "raw", "label", "score"])

    rows = sequence_rows(df.withColumn("raw", F.col("label")), "raw", "probs")
    return rows.mapInArrow(run, "recording bigint, frame array<bigint>, raw array<string>, label array<string>, score double")


def each_frame(rows: DataFrame, *columns: str) -> DataFrame:
    """recording, frame and the columns, a row for each frame."""
    return rows.select("recording", F.explode(F.arrays_zip("frame", *columns)).alias("_f")).select("recording", "_f.frame", *[f"_f.{c}" for c in columns])


def best_signal(probs: Column) -> Column:
    """The label other than NOISE of most probability, the first among equals."""
    noise = LABELS.index("NOISE")
    signal = F.array(*[probs[k] for k in range(len(LABELS)) if k != noise])
    names = F.array(*[F.lit(x) for x in LABELS if x != "NOISE"])
    return F.element_at(names, F.array_position(signal, F.array_max(signal)).cast("int"))


def smooth(df: DataFrame, chain: Chain | None = None, max_gap: int = 6) -> DataFrame:
    """``df`` with smoothed labels; NOISE gaps of up to ``max_gap`` frames between signal that are
    left get the likeliest signal label."""
    from spindrift.operators.frames import close_gaps

    path = each_frame(smoothed_rows(df, chain), "raw", "label")
    joined = path.join(df.select("recording", "frame", "probs"), ["recording", "frame"])
    return close_gaps(joined, best_signal(F.col("probs")), max_gap)


def signal_runs(df: DataFrame) -> DataFrame:
    """recording, start, stop of the maximal runs of signal, of any length."""
    from spindrift.operators.frames import regions

    return regions(df, 1)


def smoothing_effect(df: DataFrame, min_size: int = 10, short_gap: int = 3) -> DataFrame:
    """One row on what smoothing did to ``df`` (recording, frame, raw, label, probs).

    Shares are of all frames, of signal runs, of gaps between two signal runs, or of raw
    signal (whistle) frames; a share of nothing is null.
    """
    from pyspark.sql import Window

    from spindrift.operators.frames import by_frame, in_regions

    signal, was = F.col("label") != "NOISE", F.col("raw") != "NOISE"
    whistle = lambda c: F.col(c).isin("UP", "DOWN")
    kind = lambda c: F.when(whistle(c), "WHISTLE").otherwise(F.col(c))
    share = lambda c: F.avg(c.cast("double"))
    frames = df.agg(
        share((signal != was) | (signal & was & (kind("raw") != kind("label")))).alias("relabelled"), share(~was & signal).alias("noise_to_signal"),
        share(was & ~signal).alias("signal_to_noise"), share(was & signal & (kind("raw") != kind("label"))).alias("signal_to_class"),
        share(whistle("raw") & whistle("label") & (F.col("raw") != F.col("label"))).alias("up_down"),
        F.avg(F.when(~was & signal, F.col("probs")[LABELS.index("NOISE")])).alias("p_noise"), share(signal).alias("signal_share"),
        F.count_if(was).alias("raw_signal"), F.count_if(whistle("raw")).alias("raw_whistle"),
    )
    r = signal_runs(df).withColumn("n", F.col("stop") - F.col("start"))
    r = r.withColumn("gap", F.col("start") - F.lag("stop").over(Window.partitionBy("recording").orderBy("start")))
    of_runs = r.agg(F.count(F.lit(1)).alias("runs"), share(F.col("n") < min_size).alias("short_runs"), share(F.when(F.col("gap").isNotNull(), F.col("gap") <= short_gap)).alias("short_gaps"), F.count_if(F.col("n") >= min_size).alias("candidates"), F.percentile(F.when(F.col("n") >= min_size, F.col("n").cast("double")), 0.5).alias("median_frames"))
    inside = in_regions(df, r.filter(F.col("n") >= min_size).select("recording", "start", "stop"))
    per = inside.groupBy("recording", "start").agg(F.count_if(was).alias("kept"), F.count_if(whistle("raw")).alias("whistle_kept"), F.count_if(whistle("label")).alias("w"), F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    kept = per.agg(zero("kept").alias("kept"), zero("whistle_kept").alias("whistle_kept"), F.count_if((F.col("w") > 0) & (F.col("w") < F.col("n"))).alias("mixed"), F.count_if(F.col("w") * 2 > F.col("n")).alias("whistle_candidates"))
    out = frames.crossJoin(of_runs).crossJoin(kept)  # one row each
    return out.withColumn("signal_kept", F.try_divide("kept", "raw_signal")).withColumn("whistle_share_kept", F.try_divide("whistle_kept", "raw_whistle")).drop("kept", "whistle_kept", "raw_signal", "raw_whistle")


__all__ = ["Chain", "best_paths", "best_signal", "each_frame", "label_probabilities", "lasting_noise", "runs", "sequence_rows", "smooth", "smoothed_rows", "smoothing_effect", "two_level", "via_noise"]
