"""Comparison of blocks: the links found connect just what all true links connect."""

import numpy as np
import pyarrow as pa

from spindrift.llm import neardup as nd


def connected(n, links):
    up = list(range(n))
    for a, b in links:
        x, y = up[a], up[b]
        up = [y if u == x else u for u in up]
    return [up.index(u) for u in up]


def cell_rows(sets, role):
    rows = []
    for k, s in enumerate(sets):
        small = len(s) <= nd.WHOLE
        sketch = nd.sketches([s], nd.REGISTERS if small else nd.FINE)[0].tobytes()
        rows.append((7, 0, 0, role(k), bytes([k]), sketch, s.tobytes() if small else b"", bytes([k]), len(s)))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list(nd.CELL))


def test_cells_connect_what_true_links_connect():
    rng = np.random.default_rng(5)
    for size in (20, 90, 400):
        base = rng.integers(1, 1 << 63, 3 * size).astype(np.uint64)
        sets = [np.unique(np.concatenate((base[k % 3 * size : k % 3 * size + size - cut], rng.integers(1, 1 << 63, cut).astype(np.uint64)))) for k in range(30) for cut in [int(rng.integers(0, size // 5))]]
        true = [(a, b) for a in range(30) for b in range(a) if nd.holds(sets[a], sets[b], 80)]
        got = [(x[0], y[0]) for t in nd.in_cells(80)(iter([cell_rows(sets, lambda k: 3)])) for x, y in zip(t.column(0).to_pylist(), t.column(1).to_pylist())]
        if size <= nd.WHOLE:
            assert set(map(frozenset, got)) <= set(map(frozenset, true)) and len(got) < 30
        held = [p for p in got if nd.holds(sets[p[0]], sets[p[1]], 80)]
        assert connected(30, held) == connected(30, true)


def test_cells_split_between_batches_and_empty():
    s = np.arange(1, 50, dtype=np.uint64)
    batch = cell_rows([s, s[:45], s[:5]], lambda k: 1 if k == 0 else 2)
    out = list(nd.in_cells(80)(iter([batch.slice(0, 1), batch.slice(1)])))
    assert [(r["a"], r["b"]) for t in out for r in t.to_pylist()] == [(b"\0", b"\1")]
    assert sum(t.num_rows for t in nd.in_cells(80)(iter([]))) == 0
