"""The engine's queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import vectors
from spindrift.operators import clusters, frames as fr, hits as ht, sequences as sq
from spindrift.plans.registry import FRAMES, HITS, ORACLES, QUERIES, REGIONS, RUNS, VECS, query
from spindrift.sources import tables as tb

# Regions, runs and gaps


@query(f"WITH {REGIONS} SELECT recording, start, stop FROM regions")
def candidate_regions(spark, d):
    return fr.regions(tb.frames(spark, d))


@query(f"WITH {REGIONS} SELECT count(*) AS n, round(avg(stop - start), 6) AS mean_length, round(quantile_cont((stop - start)::DOUBLE, 0.5), 6) AS median_length, max(stop - start) AS max_length FROM regions")
def region_lengths(spark, d):
    n = (F.col("stop") - F.col("start")).cast("double")
    return fr.regions(tb.frames(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.round(F.expr("percentile(cast(stop - start as double), 0.5)"), 6).alias("median_length"), F.max(F.col("stop") - F.col("start")).alias("max_length"))


@query(f"WITH {RUNS} SELECT recording, label, start, stop, n FROM runs")
def run_length_encode(spark, d):
    return fr.runs(tb.frames(spark, d))


@query(f"""WITH {FRAMES},
s AS (SELECT *, CASE WHEN frame - lag(frame) OVER w - 1 <= 17 THEN 0 ELSE 1 END AS new FROM frames WHERE label <> 'NOISE' WINDOW w AS (PARTITION BY recording ORDER BY frame)),
t AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY frame) AS train FROM s)
SELECT recording, min(frame) AS start, max(frame) + 1 AS stop, count(*) AS labelled FROM t GROUP BY recording, train HAVING count(*) >= 5""")
def signal_trains(spark, d):
    return fr.trains(tb.frames(spark, d))


@query(f"""WITH {FRAMES} SELECT f.recording, f.frame, min(abs(f.frame - s.frame)) AS to_signal
FROM frames f JOIN frames s ON f.recording = s.recording AND s.label <> 'NOISE' GROUP BY f.recording, f.frame HAVING min(abs(f.frame - s.frame)) > 2""")
def far_from_signal(spark, d):
    return fr.far_from_signal(tb.frames(spark, d), 2).select("recording", "frame", "to_signal")


@query(f"""WITH {RUNS} SELECT recording, unnest(range(start + 1, stop - 1)) AS frame FROM runs WHERE label = 'NOISE' AND n >= 4""")
def interior_noise_frames(spark, d):
    return fr.interior_noise(tb.frames(spark, d), 4)


@query(f"""WITH {RUNS}, e AS (SELECT recording, min(start) AS a, max(start) AS b FROM runs GROUP BY recording)
SELECT n AS gap, count(*) AS n_gaps FROM runs JOIN e USING (recording) WHERE label = 'NOISE' AND start > a AND start < b GROUP BY n""")
def inner_gap_census(spark, d):
    return fr.inner_gaps(tb.frames(spark, d))


@query(f"WITH {RUNS} SELECT label, round(avg(n), 6) AS mean_frames, count(*) AS n_runs FROM runs WHERE label <> 'NOISE' GROUP BY label")
def class_durations(spark, d):
    return fr.runs(tb.frames(spark, d)).filter("label <> 'NOISE'").groupBy("label").agg(F.round(F.avg("n"), 6).alias("mean_frames"), F.count(F.lit(1)).alias("n_runs"))


@query(f"""WITH {FRAMES},
c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY recording ORDER BY frame) <> label THEN 1 ELSE 0 END AS changed FROM frames),
w AS (SELECT DISTINCT recording, unnest(range(0, 1000, 10)) AS start FROM frames)
SELECT w.recording, w.start, count(*) AS n, sum(CASE WHEN c.frame > w.start THEN changed ELSE 0 END)::BIGINT AS n_changed
FROM w JOIN c ON w.recording = c.recording AND c.frame >= w.start AND c.frame < w.start + 20 GROUP BY w.recording, w.start""")
def sliding_label_changes(spark, d):
    return fr.sliding_changes(tb.frames(spark, d), 20, 10)


POOLED = f"""WITH {REGIONS}, inside AS (SELECT r.recording, r.start, f.frame, f.value, f.label, CASE WHEN f.label IN ('UP', 'DOWN') THEN 'WHISTLE' ELSE f.label END AS pooled
  FROM regions r JOIN frames f ON f.recording = r.recording AND f.frame >= r.start AND f.frame < r.stop)"""


def region_frames(spark, d):
    f = tb.frames(spark, d)
    return fr.in_regions(f, fr.regions(f)).withColumn("pooled", F.when(F.col("label").isin("UP", "DOWN"), "WHISTLE").otherwise(F.col("label")))


@query(POOLED + """, c AS (SELECT recording, start, pooled, count(*) AS n, min(frame) AS seen FROM inside GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY recording, start ORDER BY n DESC, seen) AS k, sum(n) OVER (PARTITION BY recording, start) AS total FROM c)
SELECT recording, start, pooled AS label, round(n / total, 6) AS share FROM o WHERE k = 1""")
def region_majority_class(spark, d):
    return fr.majority(region_frames(spark, d), ["recording", "start"], F.col("pooled"), F.col("frame")).withColumn("share", F.round("share", 6))


# Vectors


@query(f"WITH {VECS} SELECT recording, frame, round(sqrt(list_sum(list_transform(list_zip(v, p), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 4) AS d FROM (SELECT *, lag(v) OVER (PARTITION BY recording ORDER BY frame) AS p FROM vecs) WHERE p IS NOT NULL")
def distance_profile(spark, d):
    p = tb.vec_frames(spark, d).withColumn("p", F.lag("embedding").over(fr.by_frame())).filter("p IS NOT NULL")
    return p.select(F.col("recording"), "frame", F.round(vectors.distance(F.col("embedding"), F.col("p")), 4).alias("d"))


PEAKS = f"""WITH {FRAMES}, p AS (SELECT recording, frame, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM frames WINDOW w AS (PARTITION BY recording ORDER BY frame))"""


def peaks(spark, d):
    w = fr.by_frame()
    return tb.frames(spark, d).withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w)).filter("value > a AND value > b")


@query(PEAKS + " SELECT recording, frame FROM p WHERE value > a AND value > b")
def local_maxima(spark, d):
    return peaks(spark, d).select("recording", "frame")


DIMS = f"WITH {VECS}, dims AS (SELECT vec_id, recording, unnest(v) AS x, unnest(range(0, len(v))) AS dim FROM vecs)"


def dims(spark, d):
    return tb.vec_frames(spark, d).select("vec_id", "recording", F.posexplode("embedding").alias("dim", "x"))


@query(DIMS + " SELECT dim, round(avg(x), 6) AS mean, round(sqrt(var_pop(x)), 6) AS sd FROM dims GROUP BY dim")
def zscore_dims(spark, d):
    return dims(spark, d).groupBy(F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"))


@query(DIMS + " SELECT recording, dim, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x) * count(*), 6) AS m2 FROM dims GROUP BY recording, dim")
def state_moments(spark, d):
    return dims(spark, d).groupBy("recording", F.col("dim").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_pop("x") * F.count(F.lit(1)), 6).alias("m2"))


@query(DIMS + ", m AS (SELECT dim, avg(x) AS mean, greatest(var_pop(x), 1e-4) AS var FROM dims GROUP BY dim) SELECT vec_id, round(sum(-0.5 * ((x - mean) * (x - mean) / var + ln(2 * pi() * var))), 3) AS loglik FROM dims JOIN m USING (dim) GROUP BY vec_id")
def noise_single_gaussian(spark, d):
    m = dims(spark, d).groupBy("dim").agg(F.avg("x").alias("mean"), F.greatest(F.var_pop("x"), F.lit(1e-4)).alias("var"))
    packed = m.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "var"))).alias("m"))  # one entry per dimension
    v = tb.vec_frames(spark, d).crossJoin(F.broadcast(packed))
    return v.select("vec_id", F.round(vectors.gaussian_loglik(F.col("embedding"), F.col("m.mean"), F.col("m.var")), 3).alias("loglik"))


@query(f"""WITH {FRAMES}, g AS (SELECT recording, frame, -0.5 * ((value - 20) * (value - 20) / 100 + ln(2 * pi() * 100)) + ln(0.3) AS a, -0.5 * ((value - 60) * (value - 60) / 400 + ln(2 * pi() * 400)) + ln(0.7) AS b FROM frames)
SELECT recording, frame, round(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 5) AS loglik FROM g""")
def mixture_loglik(spark, d):
    one = lambda x: F.array(F.lit(float(x)))
    ll = vectors.mixture_loglik(F.array("value"), [(one(20), one(100), math.log(0.3)), (one(60), one(400), math.log(0.7))])
    return tb.frames(spark, d).select("recording", "frame", F.round(ll, 5).alias("loglik"))


# Distances and clusters


def sequences(spark, d):
    """All recordings with all their frames, in the order of ``tb.frames``, whose numbers are not needed: one shuffle."""
    s = tb.read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return s.select(F.col("user_id").alias("id"), F.col("s.value").alias("values"))


@query()
def dtw_pairs(spark, d):
    return sq.dtw_pairs(sequences(spark, d)).withColumn("dtw", vectors.rounded(F.col("dtw"), 4))


@query()
def dtw_pairs_path(spark, d):
    return sq.dtw_pairs(sequences(spark, d), norm="path").withColumn("dtw", vectors.rounded(F.col("dtw"), 4))


@query()
def dtw_pairs_length(spark, d):
    return sq.dtw_pairs(sequences(spark, d), norm="length").withColumn("dtw", vectors.rounded(F.col("dtw"), 4))


def all_vectors(spark, d):
    """Every vector of each label."""
    return tb.vec_frames(spark, d).select(F.col("vec_id").alias("id"), F.col("recording").alias("grp"), F.col("embedding").alias("v"))


DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"


WHOLE = f"WITH {VECS}, g AS MATERIALIZED (SELECT vec_id AS id, recording AS grp, v FROM vecs), pairs AS (SELECT a.id AS anchor, b.id AS comparison, a.grp AS gi, b.grp AS gj, {DIST} AS d FROM g a, g b)"
WHOLE_MEDOIDS = WHOLE + ", t AS (SELECT gi AS grp, anchor, round(sum(d), 6) AS total FROM pairs WHERE gi = gj GROUP BY gi, anchor), medoids AS (SELECT grp, anchor AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY total, anchor) AS k FROM t) WHERE k = 1)"


@query(WHOLE_MEDOIDS + " SELECT grp, medoid FROM medoids")
def cluster_medoids(spark, d):
    return clusters.whole_medoids(all_vectors(spark, d))


@query(WHOLE_MEDOIDS + ", l AS (SELECT gi AS model_i, gj AS model_j, min(d) AS single, max(d) AS complete, avg(d) AS average FROM pairs WHERE gi <> gj GROUP BY gi, gj), c AS (SELECT grp, v FROM g JOIN medoids USING (grp) WHERE medoid = id) SELECT model_i, model_j, round(single, 4) AS single, round(complete, 4) AS complete, round(average, 4) AS average, round(" + DIST + ", 4) AS medoid FROM l JOIN c a ON a.grp = model_i JOIN c b ON b.grp = model_j")
def submodel_linkages(spark, d):
    g = clusters.stored(all_vectors(spark, d))
    out = clusters.with_medoid_distance(clusters.whole_linkages(g), g, clusters.whole_medoids(g))
    return out.select("model_i", "model_j", *[F.round(c, 4).alias(c) for c in ("single", "complete", "average", "medoid")])


@query(WHOLE + ", r AS (SELECT gi // 2 AS root_i, gj // 2 AS root_j, d FROM pairs) SELECT root_i, root_j, round(min(d), 4) AS single, round(max(d), 4) AS complete, round(avg(d), 4) AS average FROM r WHERE root_i <> root_j GROUP BY root_i, root_j")
def merged_linkage(spark, d):
    g = all_vectors(spark, d)
    groups = g.groupBy(F.col("grp").alias("model")).agg(F.floor(F.first("grp") / 2).cast("int").alias("root"), F.count(F.lit(1)).alias("hits"))
    out = clusters.merged_linkage(clusters.whole_linkages(g), groups)
    return out.select("root_i", "root_j", *[F.round(c, 4).alias(c) for c in ("single", "complete", "average")])


@query(WHOLE_MEDOIDS + f", c AS (SELECT g.grp AS centre, v FROM g JOIN medoids ON medoid = id), r AS (SELECT a.id, b.centre, round({DIST}, 6) AS d FROM g a, c b) SELECT id, centre, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, centre) AS k FROM r) WHERE k = 1")
def nearest_medoid(spark, d):
    g = all_vectors(spark, d)
    m = clusters.whole_medoids(g).select(F.col("grp").alias("centre"), F.col("medoid").alias("id"))  # one per label
    return clusters.nearest(g, g.join(F.broadcast(m), "id").select(F.col("centre").alias("id"), "v"))


def distance_matrix(pairs: DataFrame) -> tuple[list[int], np.ndarray]:
    """A small pair table (clusters, or a filtered pool) as a matrix on the driver."""
    a, b, x = (c.to_numpy() for _, c in pairs.toPandas().items())
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    m = np.zeros((len(ids), len(ids)))
    m[at[: len(a)], at[len(a) :]] = m[at[len(a) :], at[: len(a)]] = x
    return ids.tolist(), m


@query()
def greedy_seriation(spark, d):
    links = clusters.whole_linkages(all_vectors(spark, d)).select("model_i", "model_j", F.round("average", 6).alias("d"))
    ids, m = distance_matrix(links)
    return spark.createDataFrame([(k, ids[x]) for k, x in enumerate(clusters.seriate(m))], "place int, model int")


# Hits


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY submodel ORDER BY llr DESC, hit, recording, line) AS rank FROM hits WHERE confidence > 0.8 AND classification <> 'NOISE'), t AS (SELECT *, count(*) OVER (PARTITION BY submodel) AS n FROM r WHERE rank <= 15)
SELECT submodel, rank, round(llr, 2) AS llr, classification FROM t WHERE n >= 5""")
def display_set_topk(spark, d):
    return ht.display_set(tb.hits(spark, d)).select("submodel", F.col("rank").cast("long").alias("rank"), F.round("llr", 2).alias("llr"), "classification")


@query(f"WITH {HITS}, t AS (SELECT unnest([10000.0, 30000.0, 50000.0, 70000.0])::DOUBLE AS threshold) SELECT classification, threshold, count(*) FILTER (llr > threshold) AS n_above, round(avg(n_frames) FILTER (llr > threshold), 4) AS mean_frames FROM hits, t GROUP BY classification, threshold")
def threshold_sweep(spark, d):
    return ht.sweep(tb.hits(spark, d), [10000, 30000, 50000, 70000]).withColumn("mean_frames", F.round("mean_frames", 4))


MARKS = "marks AS (SELECT o_orderkey AS recording, o_orderpriority AS mark FROM orders WHERE o_orderkey % 7 = 0)"


def marks(spark, d):
    return tb.read(spark, d, "orders").filter(F.col("o_orderkey") % 7 == 0).select(F.col("o_orderkey").alias("recording"), F.col("o_orderpriority").alias("mark"))


@query(f"WITH {HITS}, {MARKS} SELECT submodel, mark, count(*) AS n FROM hits LEFT JOIN marks USING (recording) GROUP BY submodel, mark")
def marked_hits_left_join(spark, d):
    return ht.with_marks(tb.hits(spark, d), marks(spark, d), "recording").groupBy("submodel", "mark").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HITS}, {MARKS} SELECT submodel, count(*) AS n FROM hits WHERE recording NOT IN (SELECT recording FROM marks) GROUP BY submodel")
def unmarked_anti_join(spark, d):
    return ht.unmarked(tb.hits(spark, d), marks(spark, d), "recording").groupBy("submodel").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS recording, CASE WHEN o_orderkey % 14 = 0 THEN 'changed' ELSE o_orderpriority END AS mark FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 21 <> 0 UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 14 = 0 AND o_orderkey % 21 = 0 AND o_orderkey % 42 <> 0")
def marks_upsert(spark, d):
    """Marks after a batch: every second one changes; then every third goes."""
    table = marks(spark, d)
    o = F.col("recording")
    change = table.filter(o % 14 == 0).select("recording", F.lit("changed").alias("mark"), F.lit(1).alias("seq"))
    delete = table.filter(o % 21 == 0).select("recording", F.lit(None).cast("string").alias("mark"), F.lit(2).alias("seq"))
    return ht.upsert(table, change.unionByName(delete), "recording")


@query("""WITH s AS (SELECT o_custkey AS encounter, o_orderdate AS tc, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS text FROM orders)
SELECT id, coalesce(last_value(text IGNORE NULLS) OVER (PARTITION BY encounter ORDER BY tc, id ROWS UNBOUNDED PRECEDING), 'none') AS text FROM s""")
def shotlog_ffill(spark, d):
    s = shotlog(spark, d).withColumn("text", F.when(F.col("id") % 3 == 0, F.col("text")))
    return ht.forward_fill(s, "text", ["encounter"], ["tc", "id"]).select("id", F.coalesce("text", F.lit("none")).alias("text"))


def shotlog(spark, d):
    return tb.read(spark, d, "orders").select(F.col("o_custkey").alias("encounter"), F.col("o_orderdate").alias("tc"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
