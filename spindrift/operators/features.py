"""Hits beside a log of observations: annotation, cleaning, flags and context features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.scalars import as_integer, clean_line, is_valid_string, seconds_timecode, timecode_seconds
from spindrift.operators.hits import CLASS_LLR

# Terms of behaviour, and of who takes part.
CONTEXTS = (
    "ASCENT;BARRACUDA;BITE;BODY CHARGE;BODY TO BODY;BUBBLE RING;BUBBLE TRAIL;BUZZ;CALF;CHASE;COPULATING;DESCENT;DIG;DISCIPLINE;DISCIPLINES;DIVE;FISH;FLYING;FORAG;HEAD BOBBING;HEAD TO HEAD;JUMPS;"
    "MELON TO MELON RUB;NUZZLING;OPEN MOUTH;PEC RUBBING;PEC SLAP;PEC TO BELLY;PEC TO BODY;PEC TO FLUKE;PEC TO GENITAL;PEC TO MELON;PEC TO PEC;REEF SHARK;ROSTRUM TO BODY;RUBBING;SARGASSUM;SEA STAR;"
    "SEAGRASS;SHARK;SURFACE SPLASH;SWIM;TACTILE;TAIL SLAP;THRASHES;TRAVELING;TUSSLE;VERTICAL HANG;VERTICAL SINK;ZOOM"
).split(";")
ACTORS = (
    "AMANDA;DOLPHIN;EEYORE;GROUP;HADES;JUVENILE;KANSAS;MAMBA;MOTTLED;NAIA;NALA;NAVEL;NERA;ONYX;POINDEXTER;REMI;REMORA;SAGA;SELKIE;SHRIMPY;SPECKELD;SPOOK;TOOTHES;TWIX;U;VENTI;ZEST"
).split(";")


def flag_names(terms: list[str], prefix: str) -> list[str]:
    return [f"{prefix}_{t.lower().replace(' ', '_')}" for t in sorted(terms)]


def flags(df: DataFrame, text: str = "behaviour", contexts: list[str] = CONTEXTS, actors: list[str] = ACTORS) -> DataFrame:
    """``df`` with a flag for each term that the text holds, terms in order; a null text holds none."""
    has = lambda t: F.coalesce(F.contains(F.col(text), F.lit(t)), F.lit(False))
    named = [*zip(flag_names(contexts, "is"), sorted(contexts)), *zip(flag_names(actors, "has"), sorted(actors))]
    return df.select("*", *[has(t).alias(n) for n, t in named])


def annotate(hits: DataFrame, log: DataFrame) -> DataFrame:
    """Union of hits and log rows of the same encounter, in one shape, ordered by timecode within it.

    ``hits`` (encounter, submodel, classification, mean_llr, start_time_s, stop_time_s) take
    date from the first log row (by ``seq``) of their encounter; those of encounters without
    log rows are left out. ``log`` (encounter, seq, date, ac, behaviour, timecode, comment).
    Among equal timecodes hits come first, then by number.
    """
    dates = log.groupBy("encounter").agg(F.min_by("date", "seq").alias("date"))
    a = hits.join(dates, "encounter").select(
        "encounter", "date", F.col("classification").alias("ac"), F.col("submodel").cast("string").alias("behaviour"), seconds_timecode(F.col("start_time_s")).alias("timecode"),
        F.col("mean_llr").cast("string").alias("comment"), (F.col("stop_time_s") - F.col("start_time_s")).alias("duration_s"), F.lit(0).alias("kind"), F.col("hit").cast("bigint").alias("seq"),
    )
    b = log.join(hits.select("encounter").distinct(), "encounter", "left_semi").select(
        "encounter", "date", "ac", "behaviour", F.split("timecode", "-")[0].alias("timecode"), "comment", F.lit(None).cast("double").alias("duration_s"), F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("seq"),
    )
    order = Window.partitionBy("encounter").orderBy("timecode", "kind", "seq")
    return a.unionByName(b).withColumn("place", F.row_number().over(order))


def filter_rows(df: DataFrame, limits: dict[str, float | None] | None = None, drop_noise: bool = True) -> DataFrame:
    """Rows but for hits below their class's limit, and for NOISE.

    Hits are the rows whose behaviour is a number; those of other classes or without a score stay.
    """
    limits = {k: v for k, v in (CLASS_LLR | (limits or {})).items() if v is not None}
    limit = F.lit(None).cast("double")
    for k, v in limits.items():
        limit = F.when(F.col("ac") == k, F.lit(float(v))).otherwise(limit)
    score, is_hit = F.col("comment").try_cast("double"), F.col("behaviour").try_cast("double").isNotNull()
    below = F.coalesce(is_hit & (score < limit), F.lit(False))
    noise = F.coalesce(F.col("ac") == "NOISE", F.lit(False)) if drop_noise else F.lit(False)
    return df.filter(~(below | noise))


def clean(df: DataFrame, limits: dict[str, float | None] | None = None, drop_noise: bool = True) -> DataFrame:
    """Filtered rows whose texts are cleaned; with is_motif (an integer or nothing) and is_text."""
    kept = filter_rows(df, limits, drop_noise)
    number = as_integer(F.col("behaviour"))
    motif = F.col("behaviour").isNull() | number.isNotNull()
    cleaned = kept.withColumn("is_motif", motif).withColumn("behaviour", F.when(motif, F.coalesce(number.cast("string"), F.col("behaviour"))).otherwise(clean_line(F.col("behaviour"))))
    return cleaned.withColumn("is_text", ~F.col("is_motif") & is_valid_string(F.col("behaviour")))


def context_features(df: DataFrame, seconds: int = 10, keep_empty: bool = False, contexts: list[str] = CONTEXTS, actors: list[str] = ACTORS) -> DataFrame:
    """One row an anchor: its encounter and number, the sub-models heard in the ``seconds`` before
    it, and its own flags.

    Anchors are texts with a flag. Context is the rows before the anchor by (time, number)
    in its encounter that are no texts and no older than that; an anchor without any is left
    out unless ``keep_empty``. Rows without a time have the one before them. ``heard`` is
    sorted; it and ``flags`` (positions of the flags set) make up a row of the feature
    matrix, which has a column for each sub-model up to the largest and for each flag.
    """
    flagged = flags(df, "behaviour", contexts, actors)
    names = flag_names(contexts, "is") + flag_names(actors, "has")
    places = F.filter(F.array(*[F.when(F.col(n), k) for k, n in enumerate(names)]), lambda k: k.isNotNull())
    order = Window.partitionBy("encounter").orderBy(F.col("tc0").asc_nulls_last(), "seq")
    tc = timecode_seconds(F.col("timecode"))
    rows = flagged.select("encounter", "seq", "is_text", F.col("behaviour").try_cast("double").cast("int").alias("submodel"), places.alias("flags"), tc.alias("tc0"))
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("tc", F.last("tc0", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The rows within the last seconds in time are a frame of the sorted window; those of the anchor's own time after it are cut off by number.
    near = Window.partitionBy("encounter").orderBy("tc").rangeBetween(-seconds, 0)
    heard = F.collect_list(F.when(~F.col("is_text"), F.struct("rn", "submodel"))).over(near)
    anchors = rows.withColumn("near", heard).filter(F.col("is_text") & (F.size("flags") > 0))
    before = F.filter("near", lambda r: r["rn"] < F.col("rn"))
    out = anchors.select("encounter", "seq", before.alias("before"), "flags")
    if not keep_empty:
        out = out.filter(F.size("before") > 0)
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("before", lambda r: r["submodel"]), lambda x: x.isNotNull())))
    return out.select("encounter", "seq", F.size("before").alias("n_context"), ids.alias("heard"), "flags")


def one_hot(features: DataFrame, n_submodels: int, n_flags: int) -> DataFrame:
    """``features`` with the row of the matrix: a 0/1 array over sub-models, then flags."""
    spots = F.concat("heard", F.transform("flags", lambda f: f + n_submodels))
    return features.withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(n_submodels + n_flags - 1)), lambda k: F.array_contains(spots, k.cast("int")).cast("double")))
