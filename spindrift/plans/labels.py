"""Queries over label sequences: smoothing, transitions, directions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from spindrift.operators import frames as fr, models, segments as sg, smoothing as sm
from spindrift.plans.catalog import POOLED, region_frames
from spindrift.plans.registry import FRAMES, REGIONS, RUNS, query
from spindrift.sources import tables as tb


@query(POOLED + """, c AS (SELECT recording, start, pooled, count(*) AS n, min(frame) AS seen FROM inside GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY recording, start ORDER BY n DESC, seen) AS k FROM c),
s AS (SELECT recording, start, count(*) AS n, count(*) FILTER (label = 'UP') AS n_up, count(*) FILTER (label = 'DOWN') AS n_down, sum(round(value * 1000000)::BIGINT)::BIGINT AS total FROM inside GROUP BY recording, start)
SELECT recording, start, n_up, n_down, CASE WHEN pooled = 'WHISTLE' THEN CASE WHEN n_up > n_down THEN 'UP' WHEN n_up < n_down THEN 'DOWN' ELSE 'mixed' END END AS direction,
((total + 50 * s.n) // (100 * s.n)) / 10000.0::DOUBLE AS mean_score FROM s JOIN o USING (recording, start) WHERE k = 1""")
def region_direction_and_score(spark, d):
    """Sums are of whole millionths and rounded as such, so no order of rows changes them."""
    inside = region_frames(spark, d)
    up, down = F.count_if(F.col("label") == "UP"), F.count_if(F.col("label") == "DOWN")
    g = inside.groupBy("recording", "start").agg(up.alias("n_up"), down.alias("n_down"), F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 1000000).cast("bigint")).alias("total"))
    most = fr.majority(inside, ["recording", "start"], F.col("pooled"), F.col("frame"))
    way = F.when(F.col("label") == "WHISTLE", F.when(F.col("n_up") > F.col("n_down"), "UP").when(F.col("n_up") < F.col("n_down"), "DOWN").otherwise("mixed"))
    return g.join(most, ["recording", "start"]).select("recording", "start", "n_up", "n_down", way.alias("direction"), (F.expr("(total + 50 * n) div (100 * n)") / F.lit(10000.0)).alias("mean_score"))


@query(f"""WITH {FRAMES}, v AS (SELECT recording, frame - 1 AS i, abs(value - lag(value) OVER w) AS p FROM frames WINDOW w AS (PARTITION BY recording ORDER BY frame)),
q AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b, max(i) OVER (PARTITION BY recording) AS last FROM v WHERE i >= 0 WINDOW w AS (PARTITION BY recording ORDER BY i)),
peaks AS (SELECT recording, i, p, row_number() OVER (PARTITION BY recording ORDER BY p DESC, i) AS k FROM q WHERE p > a AND p > b)
SELECT recording, i AS point, round(p, 6) AS height FROM peaks WHERE k <= 3 UNION ALL SELECT recording, i, round(p, 6) FROM q WHERE i = 0 UNION ALL SELECT recording, i, round(p, 6) FROM q WHERE i = last""")
def switchpoints_topk(spark, d):
    return fr.switchpoints(tb.frames(spark, d), 3).withColumn("height", F.round("height", 6))


# Smoothing


def with_probabilities(spark, d):
    return tb.frames(spark, d).withColumn("probs", sm.label_probabilities(F.col("label")))


def smooth_sql() -> str:
    """Scores and back-pointers forth, the path back."""
    move = np.log(sm.two_level().move)
    names = tb.LABELS
    emit = lambda k: f"CASE WHEN f.label = '{names[k]}' THEN {math.log(0.6)!r}::DOUBLE ELSE {math.log(0.1)!r}::DOUBLE END"
    first = ", ".join(f"{-math.log(5)!r}::DOUBLE + {emit(k)} AS s{k}" for k in range(5)) + ", " + ", ".join(f"0 AS b{k}" for k in range(5))
    ways = lambda k: ", ".join(f"p.s{j} + {float(move[j, k])!r}::DOUBLE" for j in range(5))
    step = ", ".join(f"greatest({ways(k)}) + {emit(k)}" for k in range(5)) + ", " + ", ".join(f"list_position([{ways(k)}], greatest({ways(k)})) - 1" for k in range(5))
    best = "list_position([s0, s1, s2, s3, s4], greatest(s0, s1, s2, s3, s4)) - 1"
    return f"""WITH RECURSIVE {FRAMES}, path AS (
SELECT f.recording, f.frame, {first} FROM frames f WHERE f.frame = 0
UNION ALL SELECT f.recording, f.frame, {step} FROM path p JOIN frames f ON f.recording = p.recording AND f.frame = p.frame + 1),
fwd AS MATERIALIZED (SELECT * FROM path), ends AS (SELECT recording, max(frame) AS frame FROM frames GROUP BY recording),
back AS (SELECT recording, frame, {best} AS s FROM fwd JOIN ends USING (recording, frame)
UNION ALL SELECT b.recording, b.frame - 1, CASE b.s WHEN 0 THEN f.b0 WHEN 1 THEN f.b1 WHEN 2 THEN f.b2 WHEN 3 THEN f.b3 ELSE f.b4 END FROM back b JOIN fwd f ON f.recording = b.recording AND f.frame = b.frame WHERE b.frame > 0),
smooth AS (SELECT b.recording, b.frame, f.label AS raw, ({names!r})[b.s + 1] AS label FROM back b JOIN frames f USING (recording, frame))"""


SMOOTH = smooth_sql()
CLOSED = SMOOTH + """,
ss AS (SELECT *, CASE WHEN (label = 'NOISE') IS NOT DISTINCT FROM (lag(label) OVER w = 'NOISE') THEN 0 ELSE 1 END AS new FROM smooth WINDOW w AS (PARTITION BY recording ORDER BY frame)),
sr AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY frame) AS run FROM ss),
sn AS (SELECT *, count(*) OVER (PARTITION BY recording, run) AS n, max(run) OVER (PARTITION BY recording) AS last FROM sr),
closed AS (SELECT recording, frame, raw, CASE WHEN label = 'NOISE' AND run > 1 AND run < last AND n <= 6 THEN CASE WHEN raw = 'NOISE' THEN 'UP' ELSE raw END ELSE label END AS label FROM sn)"""


@query(SMOOTH + ", e AS (SELECT recording, max(frame) AS frame FROM frames GROUP BY recording) SELECT recording, round(greatest(s0, s1, s2, s3, s4), 4) AS score FROM fwd JOIN e USING (recording, frame)")
def viterbi_smooth_score(spark, d):
    return sm.smoothed_rows(with_probabilities(spark, d)).select("recording", F.round("score", 4).alias("score"))


@query(SMOOTH + " SELECT recording, frame, raw, label FROM smooth")
def viterbi_smooth_labels(spark, d):
    return sm.each_frame(sm.smoothed_rows(with_probabilities(spark, d)), "raw", "label")


@query(CLOSED + """, signal AS (SELECT *, frame - row_number() OVER (PARTITION BY recording ORDER BY frame) AS island FROM closed WHERE label <> 'NOISE')
SELECT recording, min(frame) AS start, max(frame) + 1 AS stop FROM signal GROUP BY recording, island HAVING count(*) >= 10""")
def closed_gap_regions(spark, d):
    return fr.regions(sm.smooth(with_probabilities(spark, d)))


@query(CLOSED + """, w AS (SELECT *, raw IN ('UP', 'DOWN') AS rw, label IN ('UP', 'DOWN') AS lw, raw <> 'NOISE' AS rs, label <> 'NOISE' AS ls,
  CASE WHEN raw IN ('UP', 'DOWN') THEN 'WHISTLE' ELSE raw END AS rk, CASE WHEN label IN ('UP', 'DOWN') THEN 'WHISTLE' ELSE label END AS lk FROM closed),
f AS (SELECT avg((rs <> ls OR (rs AND ls AND rk <> lk))::INT) AS relabelled, avg((NOT rs AND ls)::INT) AS noise_to_signal, avg((rs AND NOT ls)::INT) AS signal_to_noise, avg((rs AND ls AND rk <> lk)::INT) AS signal_to_class,
  avg((rw AND lw AND raw <> label)::INT) AS up_down, avg(0.6::DOUBLE) FILTER (NOT rs AND ls) AS p_noise, avg(ls::INT) AS signal_share, count(*) FILTER (rs) AS raw_signal, count(*) FILTER (rw) AS raw_whistle FROM w),
isl AS (SELECT *, frame - row_number() OVER (PARTITION BY recording ORDER BY frame) AS island FROM w WHERE ls),
r AS (SELECT recording, min(frame) AS start, max(frame) + 1 AS stop, count(*) AS n, count(*) FILTER (rs) AS kept, count(*) FILTER (rw) AS whistle_kept, count(*) FILTER (lw) AS lw FROM isl GROUP BY recording, island),
g AS (SELECT *, start - lag(stop) OVER (PARTITION BY recording ORDER BY start) AS gap FROM r),
a AS (SELECT count(*) AS runs, avg((n < 10)::INT) AS short_runs, avg((gap <= 3)::INT) AS short_gaps, count(*) FILTER (n >= 10) AS candidates, quantile_cont(n::DOUBLE, 0.5) FILTER (n >= 10) AS median_frames,
  coalesce(sum(kept) FILTER (n >= 10), 0) AS kept, coalesce(sum(whistle_kept) FILTER (n >= 10), 0) AS whistle_kept, count(*) FILTER (n >= 10 AND lw > 0 AND lw < n) AS mixed, count(*) FILTER (n >= 10 AND lw * 2 > n) AS whistle_candidates FROM g)
SELECT round(relabelled, 6) AS relabelled, round(noise_to_signal, 6) AS noise_to_signal, round(signal_to_noise, 6) AS signal_to_noise, round(signal_to_class, 6) AS signal_to_class, round(up_down, 6) AS up_down, round(p_noise, 6) AS p_noise,
round(signal_share, 6) AS signal_share, runs, round(short_runs, 6) AS short_runs, round(short_gaps, 6) AS short_gaps, candidates, median_frames, mixed, whistle_candidates, round(kept / raw_signal, 6) AS signal_kept, round(whistle_kept / raw_whistle, 6) AS whistle_share_kept FROM f, a""")
def smoothing_effect(spark, d):
    out = sm.smoothing_effect(sm.smooth(with_probabilities(spark, d)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" and c != "median_frames" else F.col(c) for c, t in out.dtypes])


@query()
def smoothing_topologies(spark, d):
    """Shares of relabelled frames under each form of the chain."""
    f = with_probabilities(spark, d)
    forms = {"two_level_10": sm.two_level(10), "two_level_300": sm.two_level(300), "lasting_noise_5": sm.lasting_noise(5), "via_noise": sm.via_noise(0.01, {"whistle": 17.0, "echo": 9.0, "burst": 8.0})}
    out = None
    for name, chain in forms.items():
        s = sm.each_frame(sm.smoothed_rows(f, chain), "raw", "label").agg(F.avg((F.col("raw") != F.col("label")).cast("double")).alias("relabelled"), F.avg((F.col("label") != "NOISE").cast("double")).alias("signal_share"))
        s = s.select(F.lit(name).alias("form"), "relabelled", "signal_share")
        out = s if out is None else out.unionByName(s)
    return out


# Transitions

STATE = "CASE label WHEN 'NOISE' THEN -1 WHEN 'UP' THEN 1 WHEN 'DOWN' THEN 2 WHEN 'ECHO' THEN 3 ELSE 4 END"
COUNTS = f"""WITH {FRAMES}, al AS (SELECT recording AS seq, recording % 3 AS grp, frame, {STATE} AS state FROM frames),
lim AS (SELECT seq, min(grp) AS grp, count(*) AS n, min(frame) FILTER (state >= 0) AS first, max(frame) FILTER (state >= 0) AS last, coalesce(arg_min(state, frame) FILTER (state >= 0), 0) AS entry FROM al GROUP BY seq),
flank AS (SELECT count(*) AS n_seq, sum(greatest(coalesce(first, n) - 1, 0))::BIGINT AS n_self, sum(greatest(coalesce(n - last - 2, 0), 0))::BIGINT AS c_self FROM lim),
held AS (SELECT al.seq, al.grp, last_value(CASE WHEN state >= 0 THEN state END IGNORE NULLS) OVER (PARTITION BY al.seq ORDER BY frame ROWS UNBOUNDED PRECEDING) AS k FROM al JOIN lim ON lim.seq = al.seq AND frame >= first AND frame <= last),
dwell AS (SELECT seq, grp, k, count(*) AS n FROM held GROUP BY ALL), per AS (SELECT grp, k, sum(n - 1)::BIGINT AS self_moves, count(*) AS visits FROM dwell GROUP BY ALL), ent AS (SELECT grp, entry AS k, count(*) AS entries FROM lim GROUP BY ALL),
grid AS (SELECT DISTINCT grp, unnest(range(0, 5))::INT AS k FROM lim),
counts AS (SELECT grp, k, coalesce(self_moves, 0) AS self_moves, coalesce(visits, 0) AS visits, coalesce(entries, 0) AS entries FROM grid LEFT JOIN per USING (grp, k) LEFT JOIN ent USING (grp, k))"""


def alignments(spark, d):
    state = F.lit(4)
    for k, name in enumerate(("ECHO", "DOWN", "UP")):
        state = F.when(F.col("label") == name, 3 - k).otherwise(state)
    state = F.when(F.col("label") == "NOISE", -1).otherwise(state)
    return tb.frames(spark, d).select(F.col("recording").alias("seq"), (F.col("recording") % 3).alias("grp"), "frame", state.alias("state"))


@query(COUNTS + " SELECT grp, k, self_moves, visits, entries FROM counts")
def transition_counts(spark, d):
    return models.alignment_counts(alignments(spark, d), 5)[1]


@query(COUNTS + """ SELECT grp, k, round(CASE WHEN visits = 0 THEN 0.5 ELSE (self_moves + 1.0::DOUBLE) / (self_moves + visits + 2) END, 8) AS stay, round((entries + 0.2::DOUBLE) / sum(entries + 0.2::DOUBLE) OVER (PARTITION BY grp), 8) AS entry FROM counts""")
def estimate_transitions(spark, d):
    each = models.estimate_transitions(alignments(spark, d), 5)[1]
    return each.select("grp", "k", F.round("stay", 8).alias("stay"), F.round("entry", 8).alias("entry"))


@query(COUNTS + """, p AS (SELECT (n_self + 500 * (1 - 1 / 40.0::DOUBLE)) / (n_self + n_seq + 500) AS nn, (c_self + 500 * (1 - 1 / 40.0::DOUBLE)) / (c_self + 500) AS cc, (n_seq + 1) / (n_seq + 2.0::DOUBLE) AS ec FROM flank)
SELECT round(nn, 8) AS nn, round(1 - nn, 8) AS nb, round(cc, 8) AS cc, round(ec, 8) AS ec, round(1 - ec, 8) AS ej, 0.01::DOUBLE AS jj, 0.99::DOUBLE AS jb FROM p""")
def flank_transitions(spark, d):
    f = models.estimate_transitions(alignments(spark, d), 5, flank_dwell=40)[0]
    return f.select(*[F.round(c, 8).alias(c) for c in ("nn", "nb", "cc", "ec", "ej", "jj", "jb")])


# Segments


def region_sequences(spark, d):
    """Candidates: id, x (values) and labels of each region."""
    inside = region_frames(spark, d).select(F.xxhash64("recording", "start").alias("id"), "recording", "start", "frame", "value", "label")
    s = inside.groupBy("id", "recording", "start").agg(F.array_sort(F.collect_list(F.struct("frame", "value", "label"))).alias("s"))
    return s.select("id", "recording", "start", F.col("s.value").alias("x"), F.col("s.label").alias("labels"))


@query()
def compress_states(spark, d):
    seqs = region_sequences(spark, d)
    out = sg.compressed(seqs, 4)
    return out.join(seqs.select("id", "recording", "start"), "id").select("recording", "start", "state", "n", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("var")[0], 6).alias("var"))


MEANS, VARS = [20.0, 60.0, 40.0], [400.0, 900.0, 625.0]


def aligned_sql() -> str:
    fit = lambda k: f"(-0.5 * ((f.value - {MEANS[k]}) * (f.value - {MEANS[k]}) / {VARS[k]} + ln(2 * pi() * {VARS[k]})))"
    neg = "'-infinity'::DOUBLE"
    return f"""WITH RECURSIVE {FRAMES}, path AS (
SELECT recording, frame, {fit(0)} AS s0, {neg} AS s1, {neg} AS s2, 0 AS m1, 0 AS m2 FROM frames f WHERE frame = 0
UNION ALL SELECT f.recording, f.frame, p.s0 + {fit(0)}, greatest(p.s1, p.s0) + {fit(1)}, greatest(p.s2, p.s1) + {fit(2)}, (p.s0 > p.s1)::INT, (p.s1 > p.s2)::INT FROM path p JOIN frames f ON f.recording = p.recording AND f.frame = p.frame + 1),
fwd AS MATERIALIZED (SELECT * FROM path), ends AS (SELECT recording, max(frame) AS frame FROM frames GROUP BY recording HAVING count(*) >= 3),
back AS (SELECT recording, frame, 2 AS state FROM fwd JOIN ends USING (recording, frame)
UNION ALL SELECT b.recording, b.frame - 1, b.state - CASE b.state WHEN 2 THEN f.m2 WHEN 1 THEN f.m1 ELSE 0 END FROM back b JOIN fwd f ON f.recording = b.recording AND f.frame = b.frame WHERE b.frame > 0)
SELECT recording, min(frame) FILTER (state = 1) AS second, min(frame) FILTER (state = 2) AS third, count(*) AS n FROM back GROUP BY recording"""


@query(aligned_sql())
def forced_alignment(spark, d):
    """Where the second and the third of three given states begin in each recording."""
    f = tb.frames(spark, d).groupBy(F.col("recording").alias("id")).agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("s")).select("id", F.col("s.value").alias("x"))
    out = sg.aligned(f, np.array(MEANS)[:, None], np.array(VARS)[:, None])
    at = lambda k: F.min(F.when(F.col("state") == k, F.col("frame")))
    return out.groupBy(F.col("id").alias("recording")).agg(at(1).alias("second"), at(2).alias("third"), F.count(F.lit(1)).alias("n"))


@query()
def segmentation_strategies(spark, d):
    return sg.strategy_summary(region_sequences(spark, d), 4)


@query(f"""WITH {REGIONS}, s AS (SELECT r.recording, r.start, f.frame - r.start AS i, f.value FROM regions r JOIN frames f ON f.recording = r.recording AND f.frame >= r.start AND f.frame < r.stop),
t AS (SELECT *, sum(value) OVER w AS s1, sum(value * value) OVER w AS s2, count(*) OVER (PARTITION BY recording, start) AS n FROM s WINDOW w AS (PARTITION BY recording, start ORDER BY i)),
z AS (SELECT recording, start, i + 1 AS e, s1, s2, n FROM t UNION ALL SELECT DISTINCT recording, start, 0, 0, 0, n FROM t),
seg AS (SELECT a.recording, a.start, a.e AS lo, b.e AS hi, a.n, (b.s2 - a.s2) - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.e - a.e) AS err FROM z a JOIN z b ON a.recording = b.recording AND a.start = b.start AND a.e < b.e)
SELECT x.recording, x.start, round(min(x.err + y.err + w.err), 2) AS sse FROM seg x JOIN seg y ON x.recording = y.recording AND x.start = y.start AND x.hi = y.lo JOIN seg w ON w.recording = y.recording AND w.start = y.start AND y.hi = w.lo
WHERE x.lo = 0 AND w.hi = w.n GROUP BY x.recording, x.start""")
def optimal_segmentation(spark, d):
    """Least squared error of three segments of each region."""
    return sg.least_errors(region_sequences(spark, d), 3).select("recording", "start", F.round("sse", 2).alias("sse"))


@query(f"""WITH {RUNS}, lim AS (SELECT recording, max(run) AS last FROM runs GROUP BY recording), e AS (SELECT r.recording, r.run, r.label, r.n, last, lag(r.label) OVER (PARTITION BY r.recording ORDER BY r.run) AS before FROM runs r JOIN lim USING (recording))
SELECT recording, coalesce(sum(n) FILTER (run = 1 AND label = 'NOISE'), 0)::BIGINT AS leading, coalesce(sum(n) FILTER (run = last AND run > 1 AND label = 'NOISE'), 0)::BIGINT AS trailing, coalesce(sum(n) FILTER (run > 1 AND run < last AND label = 'NOISE'), 0)::BIGINT AS folded FROM e GROUP BY recording""")
def flank_runs(spark, d):
    return fr.flank_runs(tb.frames(spark, d))
