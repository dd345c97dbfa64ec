"""Toxicity by multiple-instance learning: sentences scored, combined by noisy-or.

A text is toxic if any of its sentences is: p = 1 - prod(1 - p_s), with a logistic score
p_s for each sentence over its words. Weights are trained on document labels alone, and
the sentence scores then point to the offending sentences.

The model is fitted on at most ``MAX_LABELLED`` labelled rows (the smallest hashes of
their ids among the training rows); all rows are scored.

Cases: a null text counts as empty; a text without words has one empty sentence, whose
score is the bias alone; texts of any length are read whole; rows without a label or with
a null one do not train, and of several labels of one id the largest counts; without any
label all scores are those of the bias; repeated rows get equal scores; an empty table
gives no rows; other columns are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import read_table, remainder, small_batches, text_or_empty

#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 12_000
#: Features occur in at least this many labelled rows.
MIN_ROWS = 5
STEPS = 200
THRESHOLD = 0.7
#: Numbers that features are hashed to.
SPACE = 1 << 22
#: Words whose weights a worker remembers.
REMEMBER = 300_000

SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[list[str]]:
    return [w for s in SENTENCE.split(text.lower()) if (w := WORD.findall(s))] or [[]]


def features(word: str) -> list[int]:
    """Numbers of the word and of its stems by the first 3 to 8 letters: inflected forms share these."""
    return [zlib.crc32(f.encode()) % SPACE for f in (word, *(word[:k] + "-" for k in range(3, 9) if k <= len(word)))]


class WordWeights(dict):
    """Word -> sum of the weights of its features; remembers up to ``REMEMBER`` words."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = found
        return found


class Examples:
    """Labelled texts as numbers: which words each sentence has, and which features each word."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.features = array("i")  # of all words in turn
        self.ends = array("i")  # where each word's end
        self.words: list[np.ndarray] = []  # words of all sentences in turn
        self.sizes: list[np.ndarray] = []  # words in each sentence
        self.counts: list[int] = []  # sentences of each text
        self.labels: list[int] = []

    def add(self, text: str, label: int) -> None:
        sizes, words = [], []
        for s in sentences(text):
            distinct = set(s)
            sizes.append(len(distinct))
            for w in distinct:
                k = self.index.setdefault(w, len(self.ends))
                if k == len(self.ends):
                    self.features.extend(features(w))
                    self.ends.append(len(self.features))
                words.append(k)
        self.words.append(np.array(words, np.int32))
        self.sizes.append(np.array(sizes, np.int32))
        self.counts.append(len(sizes))
        self.labels.append(label)

    @property
    def rows_with(self) -> np.ndarray:
        """In how many texts each feature occurs."""
        every, ends = np.array(self.features, np.int32), np.array(self.ends, np.int32)
        begins, out = np.append(0, ends)[:-1], np.zeros(SPACE, np.int32)
        for words in self.words:
            own = np.unique(words)
            n = ends[own] - begins[own]
            place = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[np.unique(every[place])] += 1
        return out


def fit(examples: Examples, min_rows: int = MIN_ROWS, steps: int = STEPS, l2: float = 0.3) -> tuple[float, dict[int, float]]:
    """Bias and weights that maximise the likelihood of document labels under noisy-or (Adam, full batch)."""
    n = len(examples.labels)
    y = np.array(examples.labels, float)
    if not n or y.min() == y.max():
        return (-4.0 if not n or y[0] == 0 else 0.9), {}
    kept = np.flatnonzero(examples.rows_with >= min_rows)
    number = np.full(SPACE, -1, np.int32)
    number[kept] = np.arange(len(kept))
    n_words = len(examples.ends)
    feature = number[np.array(examples.features, np.int32)]
    of = np.repeat(np.arange(n_words, dtype=np.int32), np.diff(np.array(examples.ends, np.int32), prepend=0))
    del number
    of, feature = of[feature >= 0], feature[feature >= 0]
    useful = np.zeros(n_words, bool)
    useful[of] = True
    word, sizes = np.concatenate(examples.words), np.concatenate(examples.sizes)
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    owner = np.repeat(np.arange(n, dtype=np.int32), examples.counts)
    word, sentence = word[useful[word]], sentence[useful[word]]
    w, b = np.zeros(len(kept)), -5.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        of_word = np.bincount(of, w[feature], n_words)
        z = b + np.bincount(sentence, of_word[word], len(sizes))
        none = np.minimum(np.bincount(owner, -np.logaddexp(0, z), n), -1e-9)  # log(1 - p)
        pull = np.where(y == 1, np.exp(none) / -np.expm1(none), -1.0)  # d log likelihood / d -log(1 - p_s)
        g = pull[owner] / (1 + np.exp(-z)) / n
        by_word = np.bincount(word, g[sentence], n_words)
        grad = np.append(np.bincount(feature, by_word[of], len(w)) - l2 / n * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w + move[:-1], b + move[-1]
    return float(b), {int(k): float(a) for k, a in zip(kept, w) if abs(a) > 1e-3}


def sentence_scores(text: str, bias: float, weights: WordWeights) -> np.ndarray:
    z = np.array([bias + sum(map(weights.__getitem__, set(s))) for s in sentences(text)])
    return 1 / (1 + np.exp(-z))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def train(spark: SparkSession, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, mod: int = 3, held_remainder: int = 1) -> tuple[float, dict[int, float]]:
    """Model from the rows of ``df`` that have a label and are not held out."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("_id"), F.lit(11))
    chosen = known.filter(remainder(F.col("_id"), mod) != held_remainder)
    ids = df.select(F.col(id_col).alias("_id")).distinct()
    chosen = chosen.join(ids, "_id").orderBy(order, "_id").limit(max_labelled)
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    found = rows.select("_id", "text", F.col("toxic").cast("int")).distinct()

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = Examples()
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                examples.add(text, label)
        examples.index = {}  # the fit needs the words' numbers alone
        bias, weights = fit(examples)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *weights], pa.int64()), pa.array([bias, *weights.values()], pa.float64())], names=["feature", "weight"])

    # The rows are few by max_labelled, so one task fits them; the driver gets the weights only.
    fitted = found.repartition(1).sortWithinPartitions("_id", "text").mapInArrow(fit_all, "feature bigint, weight double")
    model = {r["feature"]: r["weight"] for r in fitted.collect()}
    return model.pop(-1, fit(Examples())[0]), model


def apply_model(df: DataFrame, model: tuple[float, dict[int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tkey, score, and the offending sentences' numbers and scores (those of 0.5 or more)."""
    schema = pa.schema([("id", pa.int64()), ("tkey", pa.int64()), ("score", pa.float64()), ("offending", pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = model[0], WordWeights(model[1])
        for batch in batches:
            each = [sentence_scores(t, bias, weights) for t in batch.column(2).to_pylist()]
            worst = [[{"sentence": int(k), "score": float(p[k])} for k in np.flatnonzero(p >= 0.5)] for p in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([noisy_or(p) for p in each], pa.float64()), pa.array(worst, schema.field(3).type)], schema=schema)

    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    return rows.mapInArrow(run, "id bigint, tkey bigint, score double, offending array<struct<sentence:int,score:double>>")


def drop_toxic(spark: SparkSession, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``df`` whose score stays below ``threshold``, with all their columns."""
    small_batches(spark)
    bias, weights = train(spark, df, labels, id_col, text_col)
    held: list[WordWeights] = []

    @F.pandas_udf("double")
    def toxicity(text):
        import pandas as pd

        if not held:
            held.append(WordWeights(weights))
        return pd.Series([noisy_or(sentence_scores(t, bias, held[0])) for t in text], dtype="float64")

    return df.filter(toxicity(text_or_empty(text_col)) < threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    scored = apply_model(docs, train(spark, docs, read_table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), (remainder(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
