"""The methods against versions written one step at a time."""

import base64
import json
import math

import numpy as np
import public_tokenizers
import pytest

from spindrift.llm import fingerprint as fp, packing, toxicity

M64 = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def slow_levels(text):
    """Phrase names of each level of one text."""
    names, levels = [ord(c) for c in text], []
    for _ in range(fp.LEVELS):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        x = [mix((n + (k - 1) * 0xD6E8FEB86659FD93) & M64) for n, k in runs]
        label = x
        for _ in range(3):
            new = []
            for i, v in enumerate(label):
                differ = v ^ label[i - 1] if i else 1
                low = (differ & -differ).bit_length() - 1 if differ else 64 if label is x else 8
                new.append(2 * low + (v >> low & 1))
            label = new
        cuts = [i for i in range(len(x)) if i == 0 or (i < len(x) - 1 and label[i] > label[i - 1] and label[i] > label[i + 1])]
        base = 0x9E3779B97F4A7C15
        names = [mix((sum(v * pow(base, j & 63, 1 << 64) for j, v in enumerate(x[a:b])) + 1) & M64) for a, b in zip(cuts, [*cuts[1:], len(x)])]
        levels.append(names)
    return levels


TEXTS = ["a", "ab", "aaaa", "abcabcabcabc" * 9, "Straße \U0001f600 café " * 20]


def random_texts():
    rng = np.random.default_rng(2)
    return ["".join(rng.choice(list("abcdefgh .é"), int(n))) for n in (3, 50, 399, 400, 401, 3000)]


def test_parse_step_by_step():
    texts = TEXTS + random_texts()
    for text, found in zip(texts, fp.fingerprints(texts)):
        want = [sorted({x >> 32 for x in names})[: fp.KEEP] for names in slow_levels(text)]
        assert found == ".".join("".join(f"{x:08x}" for x in w) for w in want)
    assert fp.fingerprints(texts) == [fp.fingerprints([t])[0] for t in texts]


def test_likeness_against_all_phrases():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrst"), int(n))) for n in rng.integers(2, 9, 300)]
    for n in (40, 200, 2000):
        for share in (0.1, 0.33, 0.7):
            a = [words[k] for k in rng.integers(0, 300, n)]
            b = a[: int(n * (1 - share))] + [words[k] for k in rng.integers(0, 300, n - int(n * (1 - share)))]
            a, b = " ".join(a), " ".join(b)
            sets = [[{x >> 32 for x in names} for names in slow_levels(t)] for t in (a, b)]
            level = next(k for k in (2, 1, 0) if k == 0 or min(len(s[k]) for s in sets) >= fp.ENOUGH)
            x, y = sets[0][level], sets[1][level]
            exact = len(x & y) / len(x | y)
            got = fp.likeness(*fp.fingerprints([a, b]))
            if max(len(x), len(y)) < fp.KEEP:
                assert math.isclose(got, exact)
            assert abs(got - exact) <= 4 * math.sqrt(max(exact * (1 - exact), 0.01) / fp.KEEP)


def test_rank_file_and_tokenizer_agree_on_every_entry():
    """The packer's ids come from the rank file: its entries and merges are those of the JSON file."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    of_char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    as_bytes = lambda token: bytes(of_char[c] for c in token)
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    assert vocab == ranks
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    made = [ranks[as_bytes(a) + as_bytes(b)] for a, b in merges]
    assert made == sorted(made) and len(made) == len(ranks) - 256
    ids = packing.Ids()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    tokens = list(ranks)
    for _ in range(2000):
        text = b"".join(tokens[k] for k in rng.integers(0, len(tokens), 5)).decode("utf-8", "ignore")
        assert ids(text) == slow.encode(text, add_special_tokens=False).ids


def test_packing_goes_on_while_rounds_merge(spark, monkeypatch):
    """Many groups: the merge ends only when a round merges nothing, or one group is left."""
    monkeypatch.setattr(packing, "GROUP", 50)
    rng = np.random.default_rng(7)
    rows = [(k, "w " * int(n)) for k, n in enumerate(rng.integers(1, 900, 900))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40)
    out = packing.pack(spark, df).toPandas()
    assert sorted(out.doc_id.unique()) == list(range(900))
    used = out.groupby("sequence_id")["length"].sum()
    assert (used <= 2048).all() and used.sum() == out["length"].sum()
    best = math.ceil(used.sum() / 2048)
    assert len(used) <= 1.06 * best, (len(used), best)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g["length"].cumsum().tolist()[:-1]]


def slow_score(text, bias, weights):
    clean = 1.0
    for sentence in toxicity.SENTENCE.split(text.lower()):
        words = set(toxicity.WORD.findall(sentence))
        if words:
            clean *= 1 - 1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for w in words for f in toxicity.features(w)))))
    if not any(toxicity.WORD.findall(s) for s in toxicity.SENTENCE.split(text.lower())):
        clean = 1 - 1 / (1 + math.exp(-bias))
    return 1 - clean


def examples_of(rows):
    examples = toxicity.Examples()
    for row in rows:
        examples.add(*row)
    return examples


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(5)
    words = ["ham", "egg", "toast", "vile", "awful", "jam", "tea"]
    rows = []
    for _ in range(120):
        s = [" ".join(rng.choice(words, 4, p=[0.2, 0.2, 0.2, 0.03, 0.03, 0.17, 0.17])) for _ in range(int(rng.integers(1, 4)))]
        rows.append((". ".join(s), int(any("vile" in x or "awful" in x for x in s) != (rng.random() < 0.03))))
    return rows


def test_scores_one_sentence_at_a_time(labelled):
    bias, weights = toxicity.fit(examples_of(labelled))
    for text, _ in [*labelled, ("", 0), ("... !", 0), ("Vile", 1)]:
        p = toxicity.sentence_scores(text, bias, toxicity.WordWeights(weights))
        assert math.isclose(toxicity.noisy_or(p), slow_score(text, bias, weights), rel_tol=1e-9, abs_tol=1e-12)


def test_fit_is_a_maximum(labelled):
    """No small change of bias or weights raises the penalised likelihood of the labels."""
    bias, weights = toxicity.fit(examples_of(labelled), steps=3000)

    def objective(b, w):
        total = 0.0
        for text, label in labelled:
            p = min(max(slow_score(text, b, w), 1e-12), 1 - 1e-12)
            total += math.log(p if label else 1 - p)
        return total - 0.3 / 2 * sum(v * v for v in w.values())

    best, rng = objective(bias, weights), np.random.default_rng(0)
    for _ in range(30):
        step = {k: v + rng.normal(0, 0.05) for k, v in weights.items()}
        assert objective(bias + rng.normal(0, 0.05), step) <= best + 1e-3


def test_cut_off_is_the_same_for_any_number_of_rows(labelled):
    for n in (40, 120):
        few = examples_of(labelled[:n])
        kept = set(np.flatnonzero(few.rows_with >= toxicity.MIN_ROWS).tolist())
        assert set(toxicity.fit(few)[1]) <= kept
