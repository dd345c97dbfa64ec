"""Pairs of copies: warped once, and made rows only behind Python."""

import itertools
import math

import numpy as np
import pytest

from spindrift.operators import sequences as sq
from spindrift.plans import catalog


def some_copies(n, copies, seed):
    """Paths that tie, so that they differ by which id is smaller; sequences without frames, and with ones that are no numbers."""
    rng = np.random.default_rng(seed)
    each = [rng.integers(0, 4, int(rng.integers(1, 9))).astype(float).tolist() for _ in range(n)] + [[], [1.0, math.nan]]
    return dict(enumerate(each[k] for k in rng.permutation(np.tile(np.arange(len(each)), copies))))


@pytest.mark.parametrize("block", [3, 256])
@pytest.mark.parametrize("norm", ["none", "path", "length"])
def test_every_pair_of_copies_is_a_row(spark, monkeypatch, norm, block):
    monkeypatch.setattr(sq, "BLOCK", block)
    seqs = some_copies(8, 7, block)
    got = sq.dtw_pairs(spark.createDataFrame(list(seqs.items()), "id bigint, values array<double>"), 2, norm).collect()
    rows = {k: np.array(v, float)[:, None] for k, v in seqs.items()}
    want = {(a, b): sq.dtw(rows[b], rows[a], 2, norm) for a, b in itertools.combinations(sorted(rows), 2)}
    assert len(got) == len(want) and {(r.anchor, r.comparison): r.dtw for r in got} == {k: None if math.isnan(d) else d for k, d in want.items()}


def test_python_hands_over_few_numbers():
    """Of 40 sequences with 60 copies each: it handed over each of 2.9 million pairs."""
    a, d = sq.Copies(np.arange(2400), np.full(40, 60)), np.zeros((40, 40))
    handed = [(len(p), len(q)) for p, q, _, _ in sq.met(a, a, d, d, True)]
    assert sum(p * q for p, q in handed) == 2400 * 2399 // 2 and sum(p + q for p, q in handed) < 2400 * 2399 // 40


@pytest.mark.parametrize("norm", ["none", "path", "length"])
def test_rows_are_made_behind_python(spark, norm):
    seqs = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id bigint, values array<double>")
    plan = sq.dtw_pairs(seqs, 5, norm)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Generate explode(p") < plan.find("Generate posexplode(q") < plan.find("MapInArrow")


def test_length_query_makes_rows_behind_python(spark, tmp_path):
    rows = [(10 * r + k, k, r, "view", float(k * (r % 2))) for r in range(6) for k in range(5)]
    spark.createDataFrame(rows, "event_id bigint, ts bigint, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.dtw_pairs_length(spark, str(tmp_path))
    assert "Generate explode(p" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.anchor, r.comparison): r.dtw for r in found.collect()} == {(a, b): 3.0 * ((a + b) % 2) for a in range(6) for b in range(a + 1, 6)}
