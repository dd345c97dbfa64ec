"""Connected components against union-find, with stars, chains and rings."""

import importlib

import numpy as np
import pytest

from spindrift.llm import common
from spindrift.llm.components import components


def brute(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("hot,task", [(4, 10), (512, 10), (512, 250_000)])
def test_components(spark, monkeypatch, hot, task):
    monkeypatch.setattr(importlib.import_module("spindrift.llm.components"), "TASK", task)
    monkeypatch.setattr(common.lookup, "__defaults__", (hot,))
    rng = np.random.default_rng(1)
    links = [(999, k) for k in range(40)] + [(1000 + k, 1001 + k) for k in range(30)] + [(2000, 2000 + k) for k in range(1, 40)] + [(5000, 5000)]
    links += [(int(a), int(b)) for a, b in rng.integers(3000, 3100, (60, 2))] + links[:5]
    df = spark.createDataFrame([*links, (None, 7), (8, None)], "a bigint, b bigint")
    assert {r.node: r.component for r in components(spark, df).collect()} == brute(links)
    assert components(spark, df.limit(0)).count() == 0
