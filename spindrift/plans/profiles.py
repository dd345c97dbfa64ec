"""Queries over profile models: decoding, hits, alignments, fitting, training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spindrift.operators import alignment as al, clusters, evaluation as ev, models, profile_hmm as ph
from spindrift.plans.catalog import dims, sequences
from spindrift.plans.labels import region_sequences
from spindrift.plans.registry import FRAMES, query
from spindrift.sources import tables as tb

SMALL = ph.Profile.of([[[0], [10], [40]], [[0], [60], [20]]], [[[1], [100], [400]], [[1], [900], [225]]], [[0.1, 0.6, 0.3], [0.1, 0.5, 0.4]], [[0.5, 0.4, 0.3], [0.5, 0.2, 0.6]], {"nn": 0.9, "nb": 0.1, "ec": 0.001, "ej": 0.999, "jj": 0.95, "jb": 0.05, "cc": 0.9})
QUIET = ph.Noise.single([50.0], [2500.0])


def paths(spark, d, model=SMALL, noise=QUIET, full_match=False):
    return ph.decoded(tb.frames(spark, d), model, noise, full_match)


def path_sql() -> str:
    """The small model: scores and choices forth, the path back, and its matched frames."""
    bits = lambda m, v: f"(-0.5 * ((f.value - {m}) * (f.value - {m}) / {v}.0 + ln(2 * pi() * {v})) / ln(2))"
    neg, fl = "'-infinity'::DOUBLE", {k: repr(v) for k, v in SMALL.flanks.items()}
    g = {(0, 1): bits(10, 100), (0, 2): bits(40, 400), (1, 1): bits(60, 900), (1, 2): bits(20, 225)}
    before = lambda n, k: f"p.m{n}1" if k == 2 else neg
    stay = lambda n, k: f"p.m{n}{k} + {float(SMALL.stay[n, k])!r}"
    come = lambda n, k: f"p.b + {float(SMALL.entry[n, k])!r}"
    ms = {f"m{n}{k}": f"greatest({before(n, k)}, {stay(n, k)}, {come(n, k)}) + {g[n, k]}" for n, k in g}
    code = {f"x{n}{k}": f"CASE WHEN {come(n, k)} > greatest({before(n, k)}, {stay(n, k)}) THEN 2 WHEN {stay(n, k)} > {before(n, k)} THEN 1 ELSE 0 END" for n, k in g}
    names, xs = list(ms), list(code)
    noise = bits(50, 2500)
    best = "CASE " + " ".join(f"WHEN {m} = e THEN '{m[1:]}'" for m in names) + " END"
    at = lambda prefix: "CASE r " + " ".join(f"WHEN '{n}{k}' THEN f.{prefix}{n}{k}" for n, k in g) + " END"
    return f"""WITH RECURSIVE {FRAMES}, path AS (
SELECT recording, frame, {', '.join(f'{neg} AS {m}' for m in names)}, {', '.join(f'0 AS {x}' for x in xs)}, {neg} AS e, NULL::VARCHAR AS em, 0.0::DOUBLE AS n, {neg} AS j, {neg} AS c, {fl['nb']}::DOUBLE AS b, false AS ce, false AS je, false AS bj FROM frames WHERE frame = 0
UNION ALL
SELECT recording, frame, {', '.join(names)}, {', '.join(xs)}, e, {best}, n, j, greatest(c0, e + {fl['ec']}) + q, greatest(n0 + {fl['nb']}, j + {fl['jb']}), e + {fl['ec']} > c0, je, j + {fl['jb']} > n0 + {fl['nb']} FROM (
  SELECT *, greatest({', '.join(names)}) AS e FROM (
    SELECT f.recording, f.frame, {', '.join(f'{x} AS {m}' for m, x in ms.items())}, {', '.join(f'{x} AS {m}' for m, x in code.items())}, {noise} AS q, p.n AS n0, p.n + {fl['nn']} + {noise} AS n, greatest(p.j + {fl['jj']}, p.e + {fl['ej']}) + {noise} AS j, p.e + {fl['ej']} > p.j + {fl['jj']} AS je, p.c + {fl['cc']} AS c0
    FROM path p JOIN frames f ON f.recording = p.recording AND f.frame = p.frame + 1))),
fwd AS MATERIALIZED (SELECT * FROM path), ends AS (SELECT recording, max(frame) AS frame, count(*) AS n FROM frames GROUP BY recording),
back AS (SELECT recording, frame, CASE WHEN ce THEN em ELSE 'C' END AS r FROM fwd JOIN ends USING (recording, frame)
UNION ALL SELECT recording, frame, CASE WHEN m = 'C' AND ce THEN em ELSE m END FROM (
  SELECT b.recording, b.frame - 1 AS frame, h.ce, h.em, CASE WHEN r = 'C' THEN 'C' WHEN r = 'J' THEN CASE WHEN f.je THEN h.em ELSE 'J' END WHEN r IN ('N', 'B') THEN 'N'
    WHEN {at('x')} = 2 THEN CASE WHEN h.bj THEN 'J' ELSE 'B' END WHEN {at('x')} = 1 THEN r ELSE r[1] || '1' END AS m
  FROM back b JOIN fwd f ON f.recording = b.recording AND f.frame = b.frame JOIN fwd h ON h.recording = b.recording AND h.frame = b.frame - 1 WHERE b.frame > 0)),
matched AS (SELECT b.recording, b.frame, r[1]::INT AS submodel, r[2]::INT AS k, f.label, f.value, CASE r {' '.join(f"WHEN '{n}{k}' THEN {x}" for (n, k), x in g.items())} END AS fit, {noise} AS quiet
  FROM back b JOIN frames f USING (recording, frame) WHERE r NOT IN ('C', 'J', 'N', 'B')),
isle AS (SELECT *, frame - row_number() OVER (PARTITION BY recording ORDER BY frame) AS island FROM matched),
spans AS (SELECT recording, min(submodel) AS submodel, min(frame) AS start, max(frame) + 1 AS stop, avg(fit) AS fit, avg(quiet) AS quiet, count(*) FILTER (label = 'UP') AS up, count(*) FILTER (label = 'DOWN') AS down, island FROM isle GROUP BY recording, island)"""


PATH = path_sql()


@query(PATH + " SELECT recording, round(c, 3) AS score FROM fwd JOIN ends USING (recording, frame)")
def phmm_viterbi_score(spark, d):
    return paths(spark, d).select("recording", F.round("score", 3).alias("score"))


@query(PATH + """, cl AS (SELECT recording, island, CASE WHEN label IN ('UP', 'DOWN') THEN 'WHISTLE' ELSE label END AS pooled, count(*) AS n, min(frame) AS seen FROM isle GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY recording, island ORDER BY n DESC, seen) AS o, sum(n) OVER (PARTITION BY recording, island) AS total FROM cl)
SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY start) - 1 AS hit, submodel, stop - start AS n_frames, start * 2560 AS start_sample, stop * 2560 AS stop_sample, round(start * 2560 / 44100, 6) AS start_time_s, round(stop * 2560 / 44100, 6) AS stop_time_s,
round(fit, 4) AS mean_emission, round(quiet, 4) AS mean_noise, round(fit - quiet, 4) AS mean_llr, pooled AS classification, round(n / total, 6) AS confidence, CASE WHEN pooled = 'WHISTLE' THEN CASE WHEN up > down THEN 'UP' WHEN down > up THEN 'DOWN' ELSE 'mixed' END END AS direction
FROM spans JOIN best USING (recording, island) WHERE o = 1""")
def phmm_hits(spark, d):
    h = ph.hits(paths(spark, d), 3)
    r = lambda c, n: F.round(c, n).alias(c)
    return h.select("recording", F.col("hit").cast("long").alias("hit"), "submodel", "n_frames", "start_sample", "stop_sample", r("start_time_s", 6), r("stop_time_s", 6), r("mean_emission", 4), r("mean_noise", 4), r("mean_llr", 4), "classification", r("confidence", 6), "direction")


@query(PATH + """, m AS (SELECT recording, submodel, count(*) AS n, min(frame) AS seen FROM matched GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY n DESC, seen) AS o FROM m)
SELECT e.recording, coalesce(b.submodel, -1) AS submodel, round(c / e.n, 5) AS score_norm FROM ends e JOIN fwd USING (recording, frame) LEFT JOIN b ON b.recording = e.recording AND o = 1""")
def submodel_assignments(spark, d):
    return ph.assign_submodels(paths(spark, d), 3).withColumn("score_norm", F.round("score_norm", 5))


@query(PATH + ", s AS (SELECT c / e.n AS x FROM ends e JOIN fwd USING (recording, frame)) SELECT count(*) AS n, count(*) FILTER (x < -7.5) AS well_fit FROM s")
def well_fit_count(spark, d):
    """Scores a frame below a threshold count as a good fit."""
    a = ph.assign_submodels(paths(spark, d), 3)
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score_norm") < -7.5).alias("well_fit"))


@query()
def phmm_full_match_hits(spark, d):
    return ph.hits(paths(spark, d, full_match=True), 3).select("recording", "hit", "submodel", "start", "stop", F.round("mean_llr", 4).alias("mean_llr"))


@query(PATH + """, fl AS (SELECT e.recording, e.n, min(m.frame) AS first, max(m.frame) AS last FROM ends e LEFT JOIN matched m ON m.recording = e.recording GROUP BY ALL),
rk AS (SELECT recording, submodel, k, frame, row_number() OVER (PARTITION BY recording, submodel, k ORDER BY frame) AS o FROM matched),
filled AS (SELECT recording, 2 + (submodel * 3 + k) * 2 + o - 1 AS slot, frame FROM rk WHERE o <= 2
UNION ALL SELECT recording, i, i FROM fl, unnest(range(0, 2)) AS u(i) WHERE first IS NOT NULL AND i < greatest(first - 1, 1)
UNION ALL SELECT recording, 14 + i, coalesce(last, 0) + i FROM fl, unnest(range(0, 2)) AS u(i) WHERE coalesce(last, 0) + i < n),
slots AS (SELECT recording, slot FROM ends, unnest(range(0, 16)) AS u(slot))
SELECT s.recording, s.slot::INT AS slot, CASE WHEN s.slot BETWEEN 2 AND 13 THEN (s.slot - 2) // 6 END::INT AS submodel, CASE WHEN s.slot BETWEEN 2 AND 13 THEN ((s.slot - 2) // 2) % 3 END::INT AS k, f.frame
FROM slots s LEFT JOIN filled f ON f.recording = s.recording AND f.slot = s.slot""")
def aligned_slots(spark, d):
    return ph.aligned_slots(clusters.stored(paths(spark, d)), 2, 3)


# Alignment quality


def grid(spark, d):
    p = clusters.stored(paths(spark, d))
    values = tb.frames(spark, d).select("recording", "frame", "value")
    each = ph.path_frames(p, 3).join(values, ["recording", "frame"]).withColumn("x", F.array("value"))
    return clusters.stored(al.cells(each, p, 2, 3))


GRID = PATH + """,
cell AS (SELECT recording AS seq, (submodel * 2 + k - 1)::INT AS col, avg(value) AS mean, count(*) AS n FROM matched GROUP BY ALL), grid AS (SELECT recording AS seq, col::INT AS col FROM ends, unnest(range(0, 4)) AS u(col)),
g AS (SELECT grid.seq, grid.col, coalesce(n, 0) = 0 AS gap, mean FROM grid LEFT JOIN cell USING (seq, col)),
st AS (SELECT *, coalesce(lag(gap) OVER (PARTITION BY seq ORDER BY col), false) AS before FROM g),
gm AS (SELECT count(*) FILTER (gap AND NOT before) AS gap_opens, count(*) FILTER (gap AND before) AS gap_extends, count(*) FILTER (gap) AS total_gaps FROM st),
cv AS (SELECT col, count(mean) AS n_seq, CASE WHEN count(mean) >= 2 THEN var_pop(mean) END AS variance FROM g GROUP BY col),
rn AS (SELECT *, sum(CASE WHEN gap AND before THEN 0 ELSE 1 END) OVER (PARTITION BY seq ORDER BY col) AS run FROM st), rl AS (SELECT seq, run, count(*) FILTER (gap) AS len FROM rn GROUP BY ALL), lg AS (SELECT seq, max(len) AS longest FROM rl GROUP BY seq),
sg AS (SELECT seq, count(*) FILTER (gap) AS n_gaps, count(*) AS n_columns FROM g GROUP BY seq), sq AS (SELECT sg.*, n_gaps * 100.0 / n_columns AS gap_pct, longest FROM sg JOIN lg USING (seq))"""


@query(GRID + " SELECT round(gap_opens / gap_extends, 6) AS gap_ratio, gap_opens, gap_extends, total_gaps FROM gm")
def msa_gap_metrics(spark, d):
    return al.gap_metrics(grid(spark, d)).withColumn("gap_ratio", F.round("gap_ratio", 6))


@query(GRID + " SELECT col, n_seq, round(variance, 4) AS variance FROM cv")
def column_cleanliness(spark, d):
    return al.column_variances(grid(spark, d)).withColumn("variance", F.round("variance", 4))


@query(GRID + " SELECT seq, n_gaps, n_columns, round(gap_pct, 6) AS gap_pct, longest FROM sq")
def seq_gap_stats(spark, d):
    return al.sequence_gaps(grid(spark, d)).withColumn("gap_pct", F.round("gap_pct", 6))


@query(GRID + """, a AS (SELECT avg(variance) AS mean_variance, quantile_cont(variance, 0.5) AS median_variance, count(*) FILTER (variance < 0.1) * 100.0 / count(*) AS percentage_clean, count(*) FILTER (variance > 1.0) * 100.0 / count(*) AS percentage_noise, count(*) AS total_columns FROM cv),
b AS (SELECT count(*) FILTER (gap) * 100.0 / count(*) AS gap_percentage FROM g), c AS (SELECT avg(gap_pct) AS mean_gap_pct, quantile_cont(gap_pct, 0.5) AS median_gap_pct, stddev_pop(gap_pct) AS std_gap_pct, min(gap_pct) AS min_gap_pct, max(gap_pct) AS max_gap_pct, avg(longest) AS mean_max_consecutive, max(longest) AS max_consecutive, sum(n_gaps)::BIGINT AS total_gap_positions, sum(n_columns)::BIGINT AS total_positions FROM sq)
SELECT round(gap_opens / gap_extends, 6) AS gap_ratio, gap_opens, gap_extends, total_gaps, round(mean_variance, 4) AS mean_variance, round(median_variance, 4) AS median_variance, round(gap_percentage, 6) AS gap_percentage, round(percentage_clean, 6) AS percentage_clean, round(percentage_noise, 6) AS percentage_noise, total_columns,
round(mean_gap_pct, 6) AS mean_gap_pct, round(median_gap_pct, 6) AS median_gap_pct, round(std_gap_pct, 6) AS std_gap_pct, round(min_gap_pct, 6) AS min_gap_pct, round(max_gap_pct, 6) AS max_gap_pct, round(mean_max_consecutive, 6) AS mean_max_consecutive, max_consecutive, total_gap_positions, total_positions FROM gm, a, b, c""")
def msa_metrics(spark, d):
    m = al.all_metrics(grid(spark, d))
    return m.select(*[F.round(c, 4 if c in ("mean_variance", "median_variance") else 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


# Decoded hits against labels


def eval_sql() -> str:
    train = lambda name, cond: f""",
{name}_s AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY recording ORDER BY frame) - 1 <= 17 THEN 0 ELSE 1 END AS new FROM ff WHERE {cond}), {name}_t AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY frame) AS train FROM {name}_s),
{name}_p AS (SELECT recording, min(frame) AS start, max(frame) + 1 AS stop FROM {name}_t GROUP BY recording, train HAVING count(*) >= 5),
{name}_h AS (SELECT p.recording, p.start, hit, count(*) AS n FROM {name}_p p JOIN ff ON ff.recording = p.recording AND frame >= start AND frame < stop AND hit >= 0 GROUP BY ALL), {name}_m AS (SELECT recording, start, count(*) AS hits, max(n) AS largest FROM {name}_h GROUP BY ALL),
{name}_c AS (SELECT p.*, hits, coalesce(largest / (stop - start), 0) AS cover FROM {name}_p p LEFT JOIN {name}_m USING (recording, start)),
{name} AS (SELECT count(*) AS trains, coalesce(sum(hits), 0) AS hits, sum(cover) AS cover, count(*) FILTER (cover >= 0.9) AS whole, count(*) FILTER (hits IS NULL) AS missed FROM {name}_c)"""  # noqa: E731
    cols = lambda name: f"""round({name}.hits / ({name}.trains - {name}.missed), 6) AS hits_per_{name}_train, round({name}.cover / {name}.trains, 6) AS {name}_largest_hit_cover, round({name}.whole / {name}.trains, 6) AS {name}_trains_whole, {name}.trains AS {name}_trains"""
    return PATH + """, num AS (SELECT recording, start, stop, row_number() OVER (PARTITION BY recording ORDER BY start) - 1 AS hit FROM spans),
ff AS (SELECT f.recording, f.frame, f.label, coalesce(num.hit, -1) AS hit FROM frames f LEFT JOIN num ON num.recording = f.recording AND f.frame >= start AND f.frame < stop),
near AS (SELECT *, least(frame - max(CASE WHEN label <> 'NOISE' THEN frame END) OVER (PARTITION BY recording ORDER BY frame ROWS UNBOUNDED PRECEDING), min(CASE WHEN label <> 'NOISE' THEN frame END) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - frame) AS dist FROM ff),
far AS (SELECT count(*) AS far, count(*) FILTER (hit >= 0) AS far_matched FROM near WHERE dist IS NULL OR dist > 1),
tot AS (SELECT count(*) AS frames, count(*) FILTER (hit >= 0) AS match, count(*) FILTER (label <> 'NOISE') AS signal, count(*) FILTER (label <> 'NOISE' AND hit >= 0) AS mos FROM ff),
hl AS (SELECT count(*) AS hits, sum(stop - start) AS hit_frames, count(*) FILTER (stop - start < 10) AS short_hits FROM num), sc AS (SELECT sum(c) AS score FROM fwd JOIN ends USING (recording, frame))""" + train("whistle", "label IN ('UP', 'DOWN')") + train("signal", "label <> 'NOISE'") + f"""
SELECT round(score / frames, 5) AS score_per_frame, round(match / frames, 6) AS match_fraction, round(far_matched / far, 6) AS background_matched, round(mos / tot.signal, 6) AS signal_recall, round(hit_frames / hl.hits, 6) AS mean_hit_frames, round(short_hits / hl.hits, 6) AS short_hit_fraction, {cols('whistle')}, {cols('signal')} FROM tot, far, hl, sc, whistle, signal"""


def decoded_frames(paths):
    each = paths.select("recording", F.explode(F.arrays_zip("frame", "label", "hit")).alias("f"))
    return each.select("recording", "f.frame", "f.label", "f.hit")


@query(eval_sql())
def decoded_metrics(spark, d):
    p = clusters.stored(paths(spark, d))
    m = ev.decoded_metrics(decoded_frames(p), p.select("recording", "score"), far=1)
    return m.select(*[F.round(c, 5 if c == "score_per_frame" else 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


# Clusters, fits and sweeps


@query()
def kmedoids_leaves(spark, d):
    """Medoid of each cluster of the recordings, with its size."""
    found = clusters.medoid_filter(sequences(spark, d).withColumnRenamed("values", "x"))
    return found.groupBy("medoid").agg(F.count(F.lit(1)).alias("n"))


@query()
def medoid_filter(spark, d):
    seqs = region_sequences(spark, d)
    found = clusters.medoid_filter(seqs.select("id", "x"))
    names = seqs.select("id", "recording", "start")
    m = names.select(F.col("id").alias("medoid"), F.col("recording").alias("medoid_recording"), F.col("start").alias("medoid_start"))
    return found.join(names, "id").join(m, "medoid").select("recording", "start", "medoid_recording", "medoid_start", F.round("d", 4).alias("d"), "rank")


def pool(spark, d):
    """Medoids of the regions' clusters and their members, the nearest first."""
    seqs = clusters.stored(region_sequences(spark, d).select("id", "x", "labels"))
    found = clusters.stored(clusters.medoid_filter(seqs.select("id", "x")))
    exemplars = models.collect_candidates(seqs.join(found.filter("rank = 0").select("id"), "id", "left_semi"))
    near = found.filter((F.col("rank") > 0) & (F.col("rank") <= max(models.MEMBERS.values()))).select("id", "medoid", "rank")
    own = seqs.join(near, "id").limit(models.MAX_POOL * max(models.MEMBERS.values())).collect()  # so many members a medoid
    of = {c.id: [] for c in exemplars}
    for r in sorted(own, key=lambda r: r["rank"]):
        of[r.medoid].append(models.Candidate(r.id, np.array(r.x, float)[:, None], list(r.labels)))
    return exemplars, [of[c.id] for c in exemplars]


@query()
def fitted_profile(spark, d):
    """A model of the regions' medoids with pooled emissions, state by state."""
    exemplars, members = pool(spark, d)
    hmm = models.make_profile(exemplars, 5, models.FitConfig("cluster", flank_dwell=20), members)
    rows = models.profile_rows(spark, hmm)
    return rows.select("submodel", "k", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("var")[0], 6).alias("var"), F.round("stay", 8).alias("stay"), F.round("entry", 8).alias("entry"), "is_last")


@query()
def bic_select(spark, d):
    """Every number of states with all medoids as sub-models, and which one BIC picks."""
    exemplars, members = pool(spark, d)
    out = models.sweep(spark, exemplars, 3, 12, None, models.FitConfig("shared", flank_dwell=20), members)
    best = models.best_of(out).select(F.col("states").alias("best"))
    return out.crossJoin(best).select("states", "models", F.round("bic", 4).alias("bic"), (F.col("states") == F.col("best")).alias("chosen"))


@query()
def sweep_best(spark, d):
    """Sub-models added greedily, up to three of them, at each of a few numbers of states."""
    exemplars, _ = pool(spark, d)
    out = models.sweep(spark, exemplars, 3, 6, 3, models.FitConfig(flank_dwell=20))
    return out.select("states", "models", F.round("bic", 4).alias("bic"), F.size("exemplars").alias("n_exemplars"))


@query()
def noise_mixture(spark, d):
    """Background of the vectors: a plain mixture and a Bayesian one of at most six components."""
    v = tb.vec_frames(spark, d).select("embedding")
    rows = []
    for name, bayes, k in (("mixture", False, 3), ("bayesian", True, 6)):
        noise, trace = models.fit_noise(v, k, bayes, rounds=10)
        rows += [(name, c, float(np.exp(w)), len(trace)) for c, w in enumerate(noise.log_weight)]
    return spark.createDataFrame(rows, "kind string, component int, weight double, rounds int")


@query()
def viterbi_training(spark, d):
    """Score a frame and matched share before each of three rounds."""
    _, _, history = models.viterbi_training(tb.frames(spark, d), SMALL, QUIET, 3)
    return spark.createDataFrame([(h["iteration"], round(h["score_per_frame"], 6), round(h["match_fraction"], 6)) for h in history], "iteration int, score_per_frame double, match_fraction double")


@query()
def training_sweep(spark, d):
    """Two settings trained on two thirds of the recordings and judged on the rest after each round."""
    f = tb.frames(spark, d)
    train, held = f.filter("recording % 3 <> 0"), f.filter("recording % 3 = 0")
    rows = []

    def judge(config, k, hmm, noise):
        p = clusters.stored(ph.decoded(held, hmm.for_search(), noise))
        m = ev.decoded_metrics(decoded_frames(p), p.select("recording", "score")).first()
        rows.append((config, k, round(m.score_per_frame, 6), round(m.match_fraction, 6), round(m.signal_recall, 6)))

    judge("start", 0, SMALL, QUIET)
    for name, config in (("rate 1.0", models.TrainConfig()), ("rate 0.3, noise fixed", models.TrainConfig(rate=0.3, update_noise=False))):
        models.viterbi_training(train, SMALL, QUIET, 2, config, after=lambda k, hmm, noise, name=name: judge(name, k + 1, hmm, noise))
    return spark.createDataFrame(rows, "config string, iteration int, score_per_frame double, match_fraction double, signal_recall double")


__all__ = ["PATH", "QUIET", "SMALL", "dims"]
