"""Tie rules, fixed values and brute force for the operators that SQL cannot check."""

import itertools
import math

import numpy as np
import pytest

from spindrift.functions import scalars
from spindrift.operators import clusters, evaluation as ev, features as ft, frames as fr, hits as ht, models, profile_hmm as ph, segments as sg, sequences as sq, smoothing as sm
from spindrift.plans import profiles

N, U, D, E = "NOISE", "UP", "DOWN", "ECHO"


def seq(spark, labels):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(labels)], "recording bigint, frame bigint, label string")


def spans(df):
    return sorted((r.start, r.stop) for r in df.collect())


def test_regions(spark):
    df = seq(spark, [N, U, U, N, E, E, E])
    assert spans(fr.regions(df, 2)) == [(1, 3), (4, 7)] and spans(fr.regions(df, 3)) == [(4, 7)]


def test_gaps_and_trains(spark):
    df = seq(spark, [U, N, N, U, N, N, N, U])
    from pyspark.sql import functions as F

    closed = {r.frame: r.label for r in fr.close_gaps(df, F.lit(D), 2).collect()}
    assert [closed[k] for k in range(8)] == [U, D, D, U, N, N, N, U]
    assert spans(fr.trains(seq(spark, [U, N, U, N, N, U]), 1, 1)) == [(0, 3), (5, 6)]


def test_majority_first_seen_wins(spark):
    from pyspark.sql import functions as F

    df = seq(spark, [U, D, N, N]).withColumn("pooled", F.when(F.col("label").isin(U, D), "WHISTLE").otherwise(F.col("label")))
    r = fr.majority(df, ["recording"], F.col("pooled"), F.col("frame")).first()
    assert (r.label, r.share) == ("WHISTLE", 0.5)


def test_fixed_values():
    w = sm.two_level().move
    assert math.isclose(w[0, 0], 300 / 304) and math.isclose(w[1, 2], 300 / 603) and math.isclose(w[3, 4], 1 / 304)
    x, y = np.array([[0.0], [1], [2]]), np.array([[0.0], [2]])
    assert sq.dtw(x, y, 1) == 1 and math.isclose(sq.dtw(x, y, 1, "length"), 0.2) and math.isclose(sq.dtw(x, y, 1, "path"), 1 / 3)
    assert math.isclose(scalars.beta_smoothed(0, 1), 1 / 3) and math.isclose(scalars.dwell_probability(100), 0.99)
    assert math.isclose(scalars.centred_smoothed(3, 4, 2 * 0.7, 0.5), scalars.beta_smoothed(3, 4, 0.7))
    assert scalars.parameter_count(1, 3, 2) == 21 and scalars.parameter_count(1, 3, 2, "shared") == 17 and scalars.parameter_count(2, 3, 2, "cluster") == 38
    assert sg.weave([0, 1, 2], [U, N, U]) == [0, -1, 1]
    assert clusters.merged_roots({1: 2, 3: 2}) == {1: 2, 3: 2, 2: 2} and clusters.unlink({1: 2, 3: 2}, 2) == {3: 1} and clusters.unlink({1: 2, 2: 5, 3: 2}, 2) == {1: 5, 3: 5}
    assert clusters.merged_roots({1: 2, 2: 3, 3: 1, 7: 1}) == {1: 1, 2: 1, 3: 1, 7: 1}
    assert clusters.merge({1: 2}, 1, 4) == {1: 2, 2: 4} and clusters.merge({1: 2}, 1, 2) == {1: 2}
    assert sg.forced_alignment(np.zeros((2, 1)), np.zeros((3, 1)), np.ones((3, 1))) is None
    assert profiles.SMALL.state_name(1) == "B" and profiles.SMALL.state_name(5 + 4) == "M1_1"
    assert ev.sign_test(0, 0) == 1 and math.isclose(ev.sign_test(5, 0), 2 / 32) and math.isclose(ev.sign_test(3, 1), 10 / 16) and ev.sign_test(2, 2) == 1


def test_change_points():
    steps = np.array([1.0, 3, 2, 5, 1])
    assert sg.change_points(np.concatenate([[0], steps.cumsum()])[:, None], 1) == [0, 3, 4]
    assert sg.change_points(np.zeros((2, 1)), 3) == [0, 0]


def slow_compress(x, anchors, rounds=10):
    """One frame at a time."""
    n, k = len(x), len(anchors)
    state = [0] * n
    for i in range(1, k):
        radius = (anchors[i] - anchors[i - 1]) // 2
        for t in range(anchors[i - 1], anchors[i]):
            state[t] = i - 1 if t < anchors[i - 1] + radius else i
    for t in range(anchors[-1], n):
        state[t] = k - 1
    mean, var = [x[min(a, n - 1)] for a in anchors], [np.ones(x.shape[1]) for _ in anchors]
    for _ in range(rounds):
        for s in range(k):
            own = [x[t] for t in range(n) if state[t] == s]
            if own:
                mean[s], var[s] = np.mean(own, axis=0), np.maximum(np.var(own, axis=0), 0.1)
        for t in range(n):
            ways = [(np.sqrt(((mean[s] - x[t]) ** 2).sum()), s) for s in range(k) if anchors[max(0, s - 1)] <= t < (anchors[s + 1] if s < k - 1 else n)]
            state[t] = min(ways)[1]
    return state, mean, var


def test_compress_frame_by_frame():
    rng = np.random.default_rng(6)
    for _ in range(60):
        x = rng.integers(0, 6, (int(rng.integers(2, 30)), 2)).astype(float)
        points = sg.change_points(x, int(rng.integers(0, 6)))
        got, want = sg.compress(x, points), slow_compress(x, points)
        assert got.state.tolist() == want[0] and np.allclose(got.mean, want[1]) and np.allclose(got.var, want[2])
    empty = sg.compress(np.array([[5.0], [5.5], [9.0], [9.1], [9.2]]), sg.change_points(np.array([[5.0], [5.5], [9.0], [9.1], [9.2]]), 1))
    assert empty.mean[0, 0] == 5 and set(empty.state.tolist()) == set(slow_compress(np.array([[5.0], [5.5], [9.0], [9.1], [9.2]]), [0, 1, 3])[0])


def test_profile_scores(spark):
    got = profiles.phmm_viterbi_score(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 150 and abs(got.score.sum() + 76156.2777) < 0.1


@pytest.mark.parametrize("full", [False, True])
def test_decoded_paths_have_their_score(full):
    rng = np.random.default_rng(4)
    hmm, noise = profiles.SMALL, profiles.QUIET
    xs = [rng.uniform(0, 100, (int(n), 1)) for n in rng.integers(0, 40, 30)]
    paths = ph.decode(xs, hmm, noise, full)
    for x, path in zip(xs, paths):
        alone = ph.decode([x], hmm, noise, full)[0]
        assert alone.score == path.score and (alone.state == path.state).all()
        if (path.state >= 0).any():
            assert math.isclose(path.score, ph.path_score(hmm, x, path, noise), rel_tol=1e-9)
            for h in range(int(path.begins.sum())):
                own = path.state[path.hit == h]
                assert len(set((own // 3).tolist())) == 1 and (np.diff(own) >= 0).all() and (not full or (own[0] % 3 == 1 and own[-1] % 3 == 2))


def test_segmentation_against_all_cuts():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 2))
    cost = lambda cuts: sum(((x[a:b] - x[a:b].mean(0)) ** 2).sum() for a, b in zip(cuts, [*cuts[1:], 9]))
    best = min(([0, *c] for c in itertools.combinations(range(1, 9), 2)), key=cost)
    state = sg.least_squares(x, 3)
    assert math.isclose(sg.moments(x, state, 3).squared_error, cost(best))
    mean, var = rng.normal(size=(3, 2)), rng.uniform(0.5, 2, (3, 2))
    ways = [np.repeat(range(3), np.diff([0, *c, 9])) for c in itertools.combinations(range(1, 9), 2)]
    score = lambda a: sg.gaussian_nats(x, mean, var)[np.arange(9), a].sum()
    assert math.isclose(score(sg.forced_alignment(x, mean, var)), max(map(score, ways)))
    for name in sg.STRATEGIES:
        s = sg.segment(x, 2, name, 4)
        assert name == "changepoint" or ((np.diff(s.state) >= 0).all() and set(s.state.tolist()) == set(range(len(s.mean))))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    move = np.log(sm.two_level().move)
    emits = [np.log(rng.random((n, 5))) for n in (4, 1, 3)]
    score = lambda e, p: -math.log(5) + e[0, p[0]] + sum(move[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))
    paths, scores = sm.best_paths(emits, move)
    for e, path, s in zip(emits, paths, scores):
        assert math.isclose(s, max(score(e, p) for p in itertools.product(range(5), repeat=len(e)))) and math.isclose(s, score(e, path.tolist()))


def test_lasting_noise_of_one_frame_is_plain():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(5), 60)
    one, plain = sm.lasting_noise(1), sm.two_level()
    with np.errstate(divide="ignore"):
        a, b = (sm.best_paths([np.log(p @ c.merge)], np.log(c.move))[0][0] for c in (one, plain))
    assert [one.shows[k] for k in a] == [plain.shows[k] for k in b]
    chain = sm.lasting_noise(4)
    assert np.allclose(chain.move.sum(1), 1) and np.allclose(sm.via_noise(0.01, {"whistle": 17, "echo": 9, "burst": 8}).move.sum(1), 1)


def test_transitions_agree(spark):
    rng = np.random.default_rng(5)
    paths = [[-1, -1, 1, 1, -1, 2, 2, -1], [-1, -1, -1], [3], [1, -1, -1, 3, 3, 1], *[rng.integers(-1, 4, 12).tolist() for _ in range(6)]]
    groups = [0, 1, 1, 0, *rng.integers(0, 3, 6).tolist()]
    rows = [(i, g, t, s) for i, (p, g) in enumerate(zip(paths, groups)) for t, s in enumerate(p)]
    df = spark.createDataFrame(rows, "seq int, grp int, frame int, state int")
    for dwell in (None, 25.0):
        flanks, each = models.estimate_transitions(df, 4, dwell)
        want, stay, entry = models.transitions_of(paths, groups, 4, dwell)
        got = flanks.first().asDict()
        assert all(math.isclose(got[k], want[k]) for k in want)
        for r in each.collect():
            assert math.isclose(r.stay, stay[r.grp, r.k]) and math.isclose(r.entry, entry[r.grp, r.k])
    alone = models.transitions_of([[-1, -1, 1, 1, -1, 2, 2, -1]], [0], 4)
    assert math.isclose(alone[0]["nn"], 2 / 4) and math.isclose(alone[0]["cc"], 1 / 2) and math.isclose(alone[0]["ec"], 2 / 3) and math.isclose(alone[1][0, 1], 3 / 5)


def candidate(i, x, labels=None):
    return models.Candidate(i, np.array(x, float)[:, None], labels or [U] * len(x))


def test_profile_of_two_exemplars(spark, tmp_path):
    a, b = candidate(1, [1, 1, 1, 9, 9, 9, 1, 1]), candidate(2, [5] * 4 + [20] * 4)
    hmm = models.make_profile([a, b], 2)
    assert hmm.mean.shape[0] == 2 and hmm.last == [len(sg.change_points(c.x, 2)) for c in (a, b)] and (hmm.var[:, 0] == 1).all()
    models.write_profile(spark, hmm, f"file://{tmp_path}/m", trained_from="here")
    back = models.read_profile(spark, f"file://{tmp_path}/m")
    assert all(np.allclose(getattr(hmm, k), getattr(back, k)) for k in ("mean", "var", "stay", "entry")) and back.last == hmm.last and back.flanks == hmm.flanks
    members = [[candidate(3, [1, 1, 2, 9, 9, 1, 1])], [candidate(4, [5])]]
    shared = models.make_profile([a, b], 2, models.FitConfig("shared"), members)
    real = [shared.var[n, k, 0] for n in range(2) for k in range(1, shared.last[n] + 1)]
    assert len(set(real)) == 1 and np.allclose(shared.mean, hmm.mean)
    assert shared.mean.shape == models.make_profile([a, b], 2, models.FitConfig("cluster"), members).mean.shape
    with pytest.raises(ValueError):
        models.make_profile([a], 2, models.FitConfig("cluster"))


def test_sweep_is_what_its_tasks_do(spark):
    pool = [candidate(k, v) for k, v in enumerate(([1] * 5 + [9] * 5, [1, 2] * 5, [7] * 4 + [3] * 6, [2] * 10))]
    rows = models.sweep(spark, pool, 3, 5, 2).collect()
    assert [(r.states, r.models) for r in sorted(rows, key=lambda r: (r.states, r.models))] == [(3, 1), (3, 2), (4, 1), (4, 2)]
    hmm = models.make_profile([pool[rows[0].exemplars[0]]], rows[0].states)
    norm, raw = models.score_pool(pool, hmm, False)
    every = [models.score_pool(pool, models.make_profile([c], rows[0].states), False)[0].sum() for c in pool]
    assert math.isclose(norm.sum(), max(every)) and math.isclose(rows[0].bic, models.bic_of(raw.sum(), 1, rows[0].states, 1, 40, "medoid"))
    assert models.best_of(spark.createDataFrame([(3, 1, 5.0), (4, 1, 4.0), (5, 1, 4.0)], "states bigint, models bigint, bic double")).first().states == 4


def test_noise_mixtures(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(9, 1, (200, 2))])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "embedding array<double>").repartition(3)
    one, _ = models.fit_noise(df)
    assert np.allclose(one.mean[0], x.mean(0)) and np.allclose(one.var[0], x.var(0))
    two, trace = models.fit_noise(df, 2, rounds=20)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:])) and np.allclose(sorted(np.exp(two.log_weight)), [0.4, 0.6], atol=0.01) and np.allclose(sorted(two.mean[:, 0]), [0, 9], atol=0.2)
    bayes, _ = models.fit_noise(df, 6, True, rounds=60, tolerance=1e-6)
    assert np.exp(bayes.log_weight).max() > 0.3 and abs(np.exp(bayes.log_weight).sum() - 1) < 0.01
    assert np.allclose(models.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890])


def test_training_statistics(spark):
    rng = np.random.default_rng(9)
    xs = [rng.uniform(0, 100, (int(n), 1)) for n in (30, 1, 45, 20)]
    rows = [(r, t, "UP", float(v)) for r, x in enumerate(xs) for t, v in enumerate(x[:, 0])]
    df = spark.createDataFrame(rows, "recording bigint, frame bigint, label string, value double").repartition(3)
    hmm, noise = profiles.SMALL.for_search(), profiles.QUIET
    stats = models.path_statistics(df, hmm, noise)
    got = {(r.kind, r.key, r.dim): (r.n, r["mean"], r.m2) for r in stats.collect()}
    paths = ph.decode(xs, hmm, noise)
    for key in range(6):
        own = np.concatenate([x[:, 0][p.state == key] for x, p in zip(xs, paths)])
        if len(own):
            n, mean, m2 = got["match", key, 0]
            assert n == len(own) and math.isclose(mean, own.mean()) and math.isclose(m2, own.var() * len(own), abs_tol=1e-6)
            assert got.get(("self", key, -1), (0,))[0] + got.get(("leave", key, -1), (0,))[0] == n
    assert got["frames", 0, -1][0] == 96 and sum(v[0] for k, v in got.items() if k[0] == "entry") == sum(p.begins.sum() for p in paths)
    model, back, row = models.trained(profiles.SMALL, noise, stats)
    assert np.allclose(np.exp2(model.entry).sum(1), 1) and math.isclose(row["score_per_frame"], sum(p.score for p in paths if np.isfinite(p.score)) / 96) if all(np.isfinite(p.score) for p in paths) else True
    a, b = (3.0, 2.0, 5.0), (4.0, 1.0, 2.0)
    assert np.allclose(models.merge(a, b), models.merge(b, a))


def slow_split(d, ids, epochs, rng):
    first = int(rng.choice(ids))
    total, reach = 0.0, []
    for i in ids:
        total += d[first, i]
        reach.append(total)
    r = rng.uniform(0, reach[-1])
    second = next((int(i) for i, c in zip(ids, reach) if i != first and r < c), int(ids[-1]))
    pair = [first, second]

    def parts():
        a, b, ta, tb = [], [], 0.0, 0.0
        for i in ids:
            if i not in pair:
                ta, tb = ta + d[pair[0], i], tb + d[pair[1], i]
                (a if d[pair[0], i] < d[pair[1], i] else b).append(int(i))
        return a, b, ta, tb

    for _ in range(epochs):
        a, b, ta, tb = parts()
        new = []
        for m, own, total in ((pair[0], a, ta), (pair[1], b, tb)):
            best, least = m, total / max(1, len(own))
            for i in own:
                mean = sum(d[i, j] for j in own) / len(own)
                if mean < least - 1e-12:
                    best, least = i, mean
            new.append(best)
        if new == pair:
            break
        pair = new
    a, b, _, _ = parts()
    return pair, a, b


def test_splits_one_by_one():
    rng = np.random.default_rng(4)
    for seed in range(40):
        pts = rng.normal(size=(int(rng.integers(3, 15)), 2))
        d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
        ids = np.arange(len(d))
        got = clusters.split_once(d, ids, 20, np.random.default_rng(seed))
        pair, a, b = slow_split(d, ids, 20, np.random.default_rng(seed))
        assert [h.medoid for h in got] == pair and got[0].members.tolist() == a and got[1].members.tolist() == b
    assert clusters.density(np.array([])) == 0 and clusters.density(np.zeros(2)) == math.inf and clusters.density(np.array([1.0, 3.0])) == 0.5


def test_seriation_and_leaves():
    d = np.array([[0, 5, 1, 9], [5, 0, 2, 1.5], [1, 2, 0, 4], [9, 1.5, 4, 0]])
    assert clusters.seriate(d) == [0, 2, 1, 3] and clusters.seriate(d[:2, :2]) == [0, 1]
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 0.1, (8, 2)), rng.normal(9, 0.1, (8, 2))])
    m = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    found = clusters.leaves(m)
    assert {k // 8 for k in found} == {0, 1} and found == clusters.leaves(m) and all(k in v for k, v in found.items())
    assert clusters.leaves(m[:2, :2]) == {0: [0], 1: [1]}


def test_thresholds_keep_null_scores_and_drop_disabled(spark):
    df = spark.createDataFrame([("WHISTLE", 29.0), ("WHISTLE", 30.0), ("OTHER", 0.0), ("BURST", None), ("ECHO", 99.0)], "classification string, llr double")
    kept = {(r[0], r[1]) for r in ht.threshold_filter(df, ht.CLASS_LLR | {"ECHO": None}).collect()}
    assert kept == {("WHISTLE", 30.0), ("OTHER", 0.0), ("BURST", None)}


def test_timecodes(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("01:02:03-17", 3723.9)], "t string, s double").select(scalars.timecode_seconds(F.col("t")), scalars.seconds_timecode(F.col("s"))).first()
    assert tuple(r) == (3723, "01:02:03")


def test_medoid_filter_covers_all(spark):
    rng = np.random.default_rng(3)
    seqs = [(k, [float(v) for v in rng.normal(10 * (k % 3), 1, int(rng.integers(4, 9)))]) for k in range(40)]
    df = spark.createDataFrame(seqs, "id bigint, x array<double>")
    for most in (7500, 25):
        out = clusters.medoid_filter(df, most=most).toPandas()
        assert sorted(out.id) == list(range(40)) and (out[out["rank"] == 0].id == out[out["rank"] == 0].medoid).all()
        assert set(out.medoid) == set(out[out["rank"] == 0].id)
        for _, g in out.groupby("medoid"):
            assert g.sort_values("rank").d.is_monotonic_increasing and sorted(g["rank"]) == list(range(len(g)))
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0])], "id bigint, x array<double>")
    assert sorted((r.id, r.medoid) for r in clusters.medoid_filter(few).collect()) == [(1, 1), (2, 2)]


def test_clean_lines(spark):
    from pyspark.sql import functions as F

    lines = {"mill/play": "millANDplay", " DIVE?2, FISH ": "DIVEAND FISH", "SWIM/": "SWIM", "A, B  C": "AAND BC", "CHASE AND  ": "CHASE", "_1?!": "", "x,  y": "xy", "AND": ""}
    df = spark.createDataFrame([(k,) for k in lines], "t string").select("t", scalars.clean_line(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == lines


def test_magnitudes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in (0.5, -1.0, 5.0, -29.9, 30.0, None)], "x double").select(scalars.magnitude(F.col("x")).alias("m"))
    assert [r.m for r in df.collect()] == ["negligible", "small", "moderate", "substantial", "significant", None]


def test_direction_needs_a_whistle_majority(spark):
    rows = [(1, t, label, 0) for t, label in enumerate([E, E, E, U, D])] + [(2, t, label, 0) for t, label in enumerate([U, D, U, E])]
    paths = spark.createDataFrame([(r, [t for q, t, _, _ in rows if q == r], [x for q, _, x, _ in rows if q == r], [1] * sum(q == r for q, *_ in rows), [0] * sum(q == r for q, *_ in rows), [1.0] * sum(q == r for q, *_ in rows), [0.5] * sum(q == r for q, *_ in rows)) for r in (1, 2)], "recording bigint, frame array<bigint>, label array<string>, state array<int>, hit array<int>, fit array<double>, quiet array<double>")
    got = {h.recording: (h.classification, h.direction, h.start_sample, h.stop_sample) for h in ph.hits(paths, 3).collect()}
    assert got == {1: ("ECHO", None, 0, 5 * 2560), 2: ("WHISTLE", "UP", 0, 4 * 2560)}


def test_annotation_and_features(spark):
    hits = spark.createDataFrame([(7, 0, 3, "WHISTLE", 40.0, 5.2, 6.0), (8, 0, 1, "ECHO", 9.0, 1.0, 2.0)], "encounter int, hit int, submodel int, classification string, mean_llr double, start_time_s double, stop_time_s double")
    log = spark.createDataFrame([(7, 1, "d1", None, "FISH/DIVE", "00:00:09-12", "x"), (7, 2, "d2", None, "talk", "00:00:02", None)], "encounter int, seq int, date string, ac string, behaviour string, timecode string, comment string")
    out = sorted(ft.annotate(hits, log).collect(), key=lambda r: r.place)
    assert [(r.timecode, r.behaviour, r.date) for r in out] == [("00:00:02", "talk", "d2"), ("00:00:05", "3", "d1"), ("00:00:09", "FISH/DIVE", "d1")]
    feats = ft.context_features(ft.clean(ft.annotate(hits, log))).first()
    names = ft.flag_names(ft.CONTEXTS, "is") + ft.flag_names(ft.ACTORS, "has")
    assert feats.heard == [3] and [names[k] for k in feats.flags] == ["is_dive", "is_fish"] and len(names) == 77
    row = ft.one_hot(ft.context_features(ft.clean(ft.annotate(hits, log))), 4, 77).first().features
    assert len(row) == 81 and row[3] == 1 and sum(row) == 3


def test_context_keeps_to_rows_before(spark):
    rows = [(1, 1, "4", "00:00:10"), (1, 2, "SWIM", "00:00:10"), (1, 3, "5", "00:00:10"), (1, 4, "6", "00:00:20"), (1, 5, "FISH", "00:00:20"), (1, 6, "note", "00:00:20"), (2, 7, "CHASE", "00:00:20")]
    df = spark.createDataFrame([(e, s, b, t, "WHISTLE", "99") for e, s, b, t in rows], "encounter int, seq int, behaviour string, timecode string, ac string, comment string")
    got = {r.seq: (r.n_context, r.heard) for r in ft.context_features(ft.clean(df)).collect()}
    assert got == {2: (1, [4]), 5: (3, [4, 5, 6])}
    assert set(r.seq for r in ft.context_features(ft.clean(df), keep_empty=True).collect()) == {2, 5, 7}


def test_aligned_slots(spark):
    """Two hits share a state's slots by time; the rest is silent; a recording without hits has its tail alone."""
    state = [-1, -1, -4, 1, 1, 2, -2, -4, 1, 5, -3]
    rows = [
        (1, 0.0, 11, list(range(11)), ["x"] * 11, state, [0] * 11, [0.0] * 11, [0.0] * 11),
        (2, 0.0, 3, [0, 1, 2], ["x"] * 3, [-3] * 3, [-1] * 3, [0.0] * 3, [0.0] * 3),
        (3, 0.0, 2, [0, 1], ["x"] * 2, [-4, 4], [-1, 0], [0.0] * 2, [0.0] * 2),
    ]
    got = {}
    for r in ph.aligned_slots(spark.createDataFrame(rows, ph.PATH_DDL), 2, 3).collect():
        got.setdefault(r["recording"], {})[r["slot"]] = (r["submodel"], r["k"], r["frame"])
    assert [len(v) for v in got.values()] == [16] * 3
    placed = {n: {s: x[2] for s, x in sorted(v.items()) if x[2] is not None} for n, v in got.items()}
    assert placed == {1: {0: 0, 1: 1, 4: 3, 5: 4, 6: 5, 12: 9, 14: 9, 15: 10}, 2: {14: 0, 15: 1}, 3: {0: 0, 10: 1, 14: 1}}
    assert got[1][0][:2] == (None, None) and got[1][4][:2] == (0, 1) and got[1][13][:2] == (1, 2) and got[1][2][:2] == (0, 0)


def test_picked_examples(spark):
    """Ties by key, nulls last, fewer rows than asked for, none at all."""
    df = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 5.0), (4, None), (5, 1.0)], "id long, change double")
    got = [(r["id"], r["picked"]) for r in ev.picked_examples(df, "id", "change", 2, 2, -df["id"]).collect()]
    assert sorted(got) == [(1, "most changed"), (2, "most changed"), (4, "random"), (5, "random")]
    assert ev.picked_examples(df, "id", "change", 4, 3).count() == 5 and ev.picked_examples(df.limit(0), "id", "change").count() == 0
