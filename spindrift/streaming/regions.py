"""Regions of signal found on a stream of frames.

A stateful form of the batch operator: frames of a recording may come late by as much as
the watermark allows; a region is given out as soon as a frame of NOISE, or the end of the
recording, closes it. On a finite stream the result equals the batch operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "recording bigint, start bigint, stop bigint"
#: Next frame that is expected, start of the open region (-1 for none), and frames that came early.
STATE = "next bigint, open bigint, early_frames array<bigint>, early_signal array<boolean>"


def region_stream(frames: DataFrame, min_size: int = 10, end_label: str = "END") -> DataFrame:
    """recording, start, stop of each region of a stream of recording, frame, label.

    Frames are numbered without gaps; those that come early wait in the state until the ones
    before them are there. A recording ends with a frame whose label is ``end_label``.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, start, early_frames, early_signal = state.get if state.exists else (0, -1, [], [])
        waiting = dict(zip(early_frames, early_signal))
        for batch in batches:
            for frame, label in zip(batch["frame"], batch["label"]):
                if frame >= at:
                    waiting[int(frame)] = None if label == end_label else label != "NOISE"
        found = []
        while at in waiting:
            signal = waiting.pop(at)
            if signal and start < 0:
                start = at
            elif not signal and start >= 0:
                if at - start >= min_size:
                    found.append((key[0], start, at))
                start = -1
            at += 1
        state.update((at, start, list(waiting), list(waiting.values())))
        yield pd.DataFrame(found, columns=["recording", "start", "stop"])

    return frames.groupBy("recording").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
