"""No text, token or phrase is cut short: cases at and beyond former limits."""

import numpy as np
import pytest

from spindrift.llm import fingerprint, neardup, pii, secrets


def test_long_opaque_tokens_are_owned(spark):
    token = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8" * 1000
    rows = [(1, f"see {token} now", "s1"), (2, f"see {token[:201]} now", "s2"), (3, f"see {token[:200]} now", "s2")]
    out = {r.doc_id: r for r in secrets.find_secrets(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert {k: [(s.kind, s.start, s.end) for s in r.spans] for k, r in out.items()} == {k: [("owned", 4, 4 + n)] for k, n in ((1, len(token)), (2, 201), (3, 200))}


@pytest.mark.parametrize("times", [1, 4, 10, 50])
def test_repeated_phrases_leave_enough_hashes(times):
    rng = np.random.default_rng(4)
    names = np.tile(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2), times)
    want = sorted({int(x) >> 32 for x in names})[: fingerprint.KEEP]
    assert fingerprint.smallest(names) == "".join(f"{x:08x}" for x in want)
    few = np.tile(names[:20], 40 * times)
    assert fingerprint.smallest(few) == "".join(f"{x:08x}" for x in sorted({int(x) >> 32 for x in few}))


def test_terms_far_from_mentions(spark):
    far = " ".join(f"the and of word{'xyz'[k % 3]}" for k in range(200))
    rows = [(k, f"Zephyr {far} mail boss@corp.example then {far} zephyr number {k}") for k in range(5)]
    rows += [(100 + k, f"mail {far} then number {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.id: [(rows[r.id][1][t.start : t.end], t.remove) for t in r.terms] if r.id < 5 else r.terms for r in pii.find_pii(spark, df).collect()}
    assert all(out[k] == ([("Zephyr", True), ("zephyr", True)] if k < 5 else []) for k, _ in rows)
    assert all("zephyr" not in r.text.lower() for r in pii.sanitise(spark, df).collect())


def test_a_corpus_given_twice_discloses_the_same(spark):
    rng = np.random.default_rng(3)
    words = [f"w{'abcdefghij'[a]}{'klmnopqrst'[b]}" for a in range(10) for b in range(10)]
    rows = []
    for k in range(120):
        own = f" mail p{k % 24}@corp.example from nick{'abcdefghijklmnopqrstuvwx'[k % 24]}zz" if k % 5 < 3 else ""
        rows.append((k, " ".join(rng.choice(words, 12)) + own + f" {k}"))

    def terms(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return {r.id: [(t.start, t.end, t.remove) for t in r.terms] for r in pii.find_pii(spark, df).collect()}

    once = terms(rows)
    assert sum(map(len, once.values())) >= 24 and terms(rows + rows) == once
    # By brute force: PMI over IC of each pair with its support.
    import math
    from collections import defaultdict

    in_rows, with_term, support = defaultdict(set), defaultdict(set), defaultdict(set)
    for k, text in rows:
        found = {m.lower() for m in __import__("re").findall(r"[a-z0-9]+@corp.example", text)}
        spots = set(pii.places(text))
        for t in {w.lower() for w in pii.TERM.findall(text)}:
            with_term[t].add(k)
        for e in found:
            in_rows[e].add(k)
            for t in spots:
                support[e, t].add(k)
    n = len(rows)
    want = {}
    for (e, t), ks in support.items():
        if len(ks) >= 3:
            d = math.log(n * len(ks) / (len(in_rows[e]) * len(with_term[t]))) / math.log(n / len(in_rows[e]))
            if d >= 0.7:
                for k in ks:
                    for span in pii.places(rows[k][1])[t]:
                        key = (k, *span)
                        want[key] = want.get(key, False) or d >= 0.95
    assert {(k, *t) for k, ts in once.items() for t in ts} == {(*key, r) for key, r in want.items()}


@pytest.mark.parametrize("words", range(1, 8))
def test_few_words_alone(words):
    texts = [b" ".join([b"w%d" % j for j in range(n)]) for n in range(words)]
    shingles = neardup.Shingles(5)
    alone = [next(shingles([t])).tolist() for t in texts]
    assert alone == [s.tolist() for s in shingles(texts + [b"a b c d e f g h"])][: len(texts)]
    assert [len(s) for s in alone] == [0 if not n else max(1, n - 4) for n in range(words)]


@pytest.mark.parametrize("n", [10, 399, 400, 401, 5000])
def test_all_levels_at_every_size(n):
    rng = np.random.default_rng(n)
    levels = fingerprint.fingerprints(["".join(rng.choice(list("abcdefgh "), n))])[0].split(".")
    assert len(levels) == fingerprint.LEVELS and all(levels)
