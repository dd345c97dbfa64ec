"""Scalar expressions: smoothing, information criteria, times, texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_smoothed(own: float, leave: float, alpha: float = 1.0) -> float:
    """Share of ``own`` among both, with ``alpha`` added to each."""
    return (own + alpha) / (own + leave + 2 * alpha)


def dwell_probability(frames: float) -> float:
    """Self-transition whose geometric dwell has this mean."""
    return 1 - 1 / frames


def centred_smoothed(own: float, leave: float, weight: float, centre: float) -> float:
    """Share of ``own`` among both, with ``weight`` frames whose share is ``centre``."""
    return (own + weight * centre) / (own + leave + weight)


def parameter_count(models: int, states: int, dims: int, variance: str = "medoid") -> int:
    """Free parameters: of each sub-model the states' means and variances (one variance for
    all of them if ``shared``), entries that sum to 1, and dwells; and four flank moves."""
    shared = variance == "shared"
    each = states * dims * (1 if shared else 2) + (states - 1) + states
    return 4 + (dims if shared else 0) + models * each


def bic(n_params: Column, n_frames: Column, loglik_nats: Column) -> Column:
    return n_params * F.log(n_frames) - 2 * loglik_nats


def frame_time(frame: Column, hop: int = 2560, rate: int = 44100) -> Column:
    return frame * F.lit(hop) / F.lit(float(rate))


def timecode_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS after dropping a frame suffix and all but digits and colons."""
    clean = F.regexp_replace(F.regexp_replace(F.split(text, "-")[0], "[^0-9:]", ""), ":+$", "")
    part = lambda k: F.try_element_at(F.split(clean, ":"), F.lit(k)).try_cast("bigint")
    return part(1) * 3600 + part(2) * 60 + part(3)


def seconds_timecode(seconds: Column) -> Column:
    """0H:MM:SS of whole seconds."""
    s = F.floor(seconds).cast("int")
    return F.format_string("0%d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"))


#: White space as it is stripped from both ends of texts.
BLANK = r"[\x09-\x0D\x1C-\x20]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clean_line(text: Column) -> Column:
    """Behaviour text, step by step: digits, question and exclamation marks and underscores go;
    each slash and comma becomes AND, without blanks; a final AND goes; then ANDs followed by
    two blanks, and what pairs of blanks are left, are deleted."""
    x = stripped(F.regexp_replace(text, "[0-9?!_]+", ""))
    x = F.regexp_replace(x, "[/,]", "AND")
    x = stripped(F.regexp_replace(x, f"AND{BLANK}*$", ""))
    return F.replace(F.replace(x, F.lit("AND  "), F.lit("")), F.lit("  "), F.lit(""))


def as_integer(text: Column) -> Column:
    """The integer that a whole text spells (blanks around it and a sign may stand), else null."""
    return F.when(stripped(text).rlike("^[+-]?[0-9]+$"), stripped(text).try_cast("bigint"))


def is_valid_string(text: Column) -> Column:
    """Whether a behaviour is a text: no number, not empty, not a bare AND."""
    return F.coalesce(as_integer(text).isNull() & (text != "AND") & (text != ""), F.lit(False))


def encounter_of(folder: Column) -> Column:
    """1234 of "E1234_any"; null if it is not of that form."""
    return F.regexp_extract(folder, r"^[^_]([+-]?[0-9]+)(?:_|$)", 1).try_cast("bigint")


def encounter_year(stem: Column) -> tuple[Column, Column]:
    """(encounter, year) of a stem that begins with a code MMDDYYNN: the code without its first
    digit, and its year; null for other stems."""
    code = F.split(stem, "_")[0]
    good = code.rlike("^[0-9]{8}$")
    return F.when(good, F.substring(code, 2, 7).cast("int")), F.when(good, F.lit(2000) + F.substring(code, 5, 2).cast("int"))


def clamp_threshold(x: Column, least: float = 5, most: float = 10) -> Column:
    return F.when(x < least, 0.0).otherwise(F.least(x, F.lit(float(most))))


def context_region(start: Column, stop: Column, duration: Column, margin: float = 0.5) -> tuple[Column, Column, Column]:
    """(start, stop, offset of the hit in it) of the region around a hit, within the recording."""
    r0 = F.greatest(F.lit(0.0), start - margin)
    return r0, F.least(duration, stop + margin), start - r0


def lift_percent(value: Column, baseline: Column) -> Column:
    """Change against a baseline in per cent; a zero baseline gives 0 for zero and null otherwise."""
    return F.when(baseline != 0, (value - baseline) / F.abs(baseline) * 100).when(value == 0, 0.0)


# Upper limits of a change in per cent, and the words for them.
MAGNITUDES = [(1, "negligible"), (5, "small"), (15, "moderate"), (30, "substantial")]
LARGEST = "significant"


def magnitude(lift: Column) -> Column:
    """Word for the size of a change; null for a null one."""
    word = F.lit(LARGEST)
    for limit, name in reversed(MAGNITUDES):
        word = F.when(F.abs(lift) < limit, name).otherwise(word)
    return F.when(lift.isNotNull(), word)


def log2_f32(p: float) -> float:
    """Base-2 logarithm rounded to single precision, as flank transitions are kept."""
    import numpy as np

    return float(np.float32(math.log2(p)))
