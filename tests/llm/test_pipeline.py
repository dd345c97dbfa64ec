"""Each stage of the pipeline on awkward rows, against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest

from spindrift.llm import packing, pii, toxicity
from test_text_operators import AWKWARD, LONG, SCHEMA, brute_near, brute_pii


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Awkward rows beside toxic texts, exact and near copies, and people's data; extra columns clash."""
    d, rng = str(tmp_path_factory.mktemp("pipeline")), np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in "klmn" for b in ("or", "ist", "ea", "oun")]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(i, t) for i, t, _, _ in AWKWARD]
    labels = []
    for k in range(100, 300):
        bad = k % 4 == 0
        rows.append((k, text(20) + (". you vile rotten fool. " if bad else ". ") + text(10)))
        labels.append((k, 1, int(bad)))
    copy, near = text(60), text(60).split()
    rows += [(k, copy) for k in range(400, 420)] + [(450, copy), (450, copy)]
    rows += [(500 + k, " ".join(w if j != k else "changed" for j, w in enumerate(near))) for k in range(12)]
    rows += [(600 + k, f"{text(15)} write to person{k % 3}@mail.example about Nickname{'abc'[k % 3]} {k}") for k in range(12)]
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, 1.0, "v", 2, 3, 4) for i, t in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*labels, (999999, 1, 1), (None, 0, 1), (1, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def steps(spark, tables):
    """Rows before the first and after each stage."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        after = stage(spark, docs, tables)
        rows = after.collect()
        if name != "packing":
            assert after.columns == docs.columns and after.schema["text"].dataType == docs.schema["text"].dataType
            docs = spark.createDataFrame(rows, docs.schema)
        out.append(rows)
    return out


def pairs(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_toxic_ones_go(spark, tables, steps):
    before, after = steps[0], steps[1]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    bias, weights = toxicity.train(spark, docs, spark.read.parquet(f"{tables}/labels.parquet"))
    clean = lambda t: toxicity.noisy_or(toxicity.sentence_scores(t or "", bias, toxicity.WordWeights(weights))) < 0.7
    assert pairs(after) == pairs([r for r in before if clean(r.text)])
    assert not any("vile" in (r.text or "") for r in after) and sum(r.text is None for r in after) == 1 and any(r.text == LONG for r in after)


def test_one_of_equal_texts_stays(steps):
    groups = {}
    for r in steps[1]:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    assert sorted((r.text or "", r.doc_id or -1) for r in steps[2]) == sorted((t, max(i if i is not None else -1 for i in ids)) for t, ids in groups.items())


def test_one_of_near_copies_stays(steps):
    rows = [(r.doc_id, r.text or "") for r in steps[2]]
    kept = Counter(i for i, _, component in brute_near(rows, 5, 80).elements() if i == component)
    assert Counter(r.doc_id for r in steps[3]) == kept
    assert sum(500 <= (r.doc_id or 0) < 512 for r in steps[3]) == 1


def test_personal_data_goes(spark, steps):
    before, after = {(r.doc_id, k): r for k, r in enumerate(sorted(steps[3], key=str))}, steps[4]
    assert len(after) == len(before) and Counter(r.doc_id for r in after) == Counter(i for i, _ in before)
    for r in after:
        assert r.text is None or not [s for s in brute_pii(r.text) if s.startswith("email")], r
        assert r.n_chars == (len(r.text) if r.text is not None else r.n_chars)
    assert not any(re.search("nickname", r.text or "", re.I) for r in after if 600 <= (r.doc_id or 0) < 612)
    assert sum("[EMAIL]" in (r.text or "") for r in after) >= 12 and sum(r.text is None for r in after) == sum(r.text is None for r in before.values())
    assert pii.redacted("a b", [], []) == "a b"


def test_packed_whole(steps):
    ids = packing.Ids()
    want = Counter()
    for r in steps[4]:
        n = len(ids(r.text or "")) + 1
        want[r.doc_id, n] += 1
    got = Counter()
    by_doc = {}
    for p in steps[5]:
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc, pieces in by_doc.items():
        copies = sum(p.piece == 0 for p in pieces)
        if copies == 1:
            got[doc, sum(p["length"] for p in pieces)] += 1
        else:
            assert sum(p["length"] for p in pieces) == sum(n * c for (d, n), c in want.items() if d == doc)
            for (d, n), c in want.items():
                if d == doc:
                    got[d, n] += c
    assert got == want
    seen = {}
    for p in steps[5]:
        seen.setdefault(p.sequence_id, []).append((p.offset, p["length"]))
    for places in seen.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048


def test_run_is_all_stages(spark, tables, steps):
    got = pipeline.run(spark, tables).collect()
    key = lambda rows: Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in rows)
    assert key(got) == key(steps[5])
