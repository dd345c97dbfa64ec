"""Language-model scores by a hidden Markov model with classes for rare words.

Tokens are words (A-Z lower-cased) and one end for each text. All tokens of all rows are
counted. Words that make up at least one in ``OWN_SHARE`` training words, and ``LEAST`` of
them, have emissions of their own (so at most ``OWN_SHARE`` words, whatever the corpus); the others emit one of 64
classes by length and ending, and then the word by its smoothed share of the class, from a
table of counts that has every word of the corpus. Baum-Welch runs over all training rows,
in windows of ``WINDOW`` tokens: a text's first window begins in the start state, later
ones in the state that windows are found to resume in, which is learnt apart. Expected
counts are summed across partitions, and the driver only gets the model's own entries.
Scores are the exact likelihood of the whole text: a scaled forward recursion, in which
the texts of a batch advance together; what a few much longer texts have left goes by
transfer matrices of segments, multiplied in order, with the same result.

Counts of words that make up at least one in ``SHARE`` tokens (so at most ``SHARE`` words,
whatever the corpus) are broadcast; any other word of a text meets its count in a join,
in which it is too rare to be hot.

Cases: a null text counts as empty; an empty text is one end; texts of any length count
whole; a null id hashes as empty text; repeated rows each count; words of equal counts
fare alike; an empty table gives no rows; without training rows nothing is known; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import discard, materialise, read_table, remainder, small_batches, text_or_empty

STATES = 8
#: Fewer than 2**16 less the classes: a symbol has 16 bits.
OWN_SHARE = 60_000
#: Words seen less often stand for those never seen, so they have no emissions of their own.
LEAST = 8
SHARE = 1 << 20
ROUNDS = 5
WINDOW = 128
#: Windows that advance together.
TOGETHER = 1024
SEGMENT = 64
#: Counts that a pass holds before it sums and hands them on.
FLUSH = 1_000_000
#: Texts that are fewer than this many go by segments.
FEW = 32
CLASSES = 64
# Endings that set a class apart.
ENDINGS = b".,;:!?"


def word_classes(words: pa.BinaryArray) -> np.ndarray:
    """Class of each word; an empty one is in class 0."""
    n = pc.binary_length(words).to_numpy()
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    last = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + 1 + len(words)] - 1
    ending = np.zeros(len(words), bool)
    ending[n > 0] = np.isin(data[last[n > 0]], np.frombuffer(ENDINGS, np.uint8))
    return np.minimum(n, 31) + 32 * ending


def class_column(word: str = "token"):
    last = F.substring(F.col(word), -1, 1)
    ending = F.coalesce(last.isin(*[F.lit(bytes([c])) for c in ENDINGS]), F.lit(False))
    return F.least(F.octet_length(word), F.lit(31)) + F.when(ending, 32).otherwise(0)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts, their numbers along all texts, and each text's number of words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    coded = split.flatten().dictionary_encode()
    at, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    empty = pc.index(coded.dictionary, "").as_py()  # where white space begins or ends a text
    if empty >= 0:
        at, owner = at[at != empty], owner[at != empty]
    return coded.dictionary.cast(pa.binary()), at, np.bincount(owner, minlength=len(texts))


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (token, of training rows, of all rows)."""
    held: list[pa.Table] = []

    def give() -> Iterator[pa.RecordBatch]:
        summed = pa.concat_tables(held).group_by("token").aggregate([("n", "sum"), ("n_all", "sum")])
        yield from summed.select(["token", "n_sum", "n_all_sum"]).rename_columns(["token", "n", "n_all"]).to_batches(100_000)
        held.clear()

    for batch in batches:
        words, at, sizes = words_of(batch.column(1))
        train = np.repeat(~batch.column(0).to_numpy(zero_copy_only=False), sizes)
        n_all, n = np.bincount(at, minlength=len(words)), np.bincount(at[train], minlength=len(words))
        full = np.flatnonzero(n_all)
        held.append(pa.table([words.take(pa.array(full)), pa.array(n[full]), pa.array(n_all[full])], names=["token", "n", "n_all"]))
        if sum(len(x) for x in held) > FLUSH:
            yield from give()
    if held:
        yield from give()


CODED = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("inner", pa.float64()), ("symbols", pa.binary()), ("rare", pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())])))])
CODED_DDL = "rid bigint, id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, inner double, symbols binary, rare array<struct<token:binary,n:bigint>>"


def coder(shared, n_own: int, end_known: bool, end_base: float):
    """Symbols of each text, what its frequent words add to the scores, and its rare words."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, symbol, base, inner, known = shared.value
        for batch in batches:
            distinct, at, sizes = words_of(batch.column(3))
            n_texts, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            place = pc.fill_null(pc.index_in(distinct, words), -1).to_numpy().astype(np.int64)
            code = (n_own + word_classes(distinct)).astype("<u2")
            code[place >= 0] = symbol[place[place >= 0]]
            tokens = place[at]
            seen = tokens >= 0
            of_text = lambda values: np.bincount(owner[seen], values[tokens[seen]], n_texts)
            ends = np.cumsum(sizes + 1)
            symbols = np.empty(len(at) + n_texts, "<u2")
            symbols[ends - 1] = n_own + CLASSES
            symbols[np.arange(len(at)) + owner] = code[at]
            raw = pa.Array.from_buffers(pa.large_binary(), n_texts, [None, pa.py_buffer(np.concatenate(([0], 2 * ends)).astype(np.int64)), pa.py_buffer(symbols)]).cast(pa.binary())
            span = max(1, len(distinct))
            pairs, times = np.unique(owner[~seen] * span + at[~seen], return_counts=True)
            rare = pa.StructArray.from_arrays([distinct.take(pa.array(pairs % span)), pa.array(times, pa.int64())], names=["token", "n"])
            starts = np.searchsorted(pairs, np.arange(n_texts + 1) * span).astype(np.int32)
            cols = [sizes + 1, of_text(known).astype(np.int64) + end_known, of_text(base) + end_base, of_text(inner)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, f.type) for c, f in zip(cols, list(CODED)[3:])], raw, pa.ListArray.from_arrays(pa.array(starts), rare)], schema=CODED)

    return code


#: Start, resumption, moves, and emissions with a row for each symbol.
Model = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def initial(unigram: np.ndarray, states: int) -> Model:
    rng = np.random.default_rng(7)
    emit = (unigram + 1e-9)[:, None] * np.exp(rng.normal(0, 1, (states, len(unigram)))).T
    move = np.full((states, states), 0.4 / states) + 0.6 * np.eye(states)
    return np.full(states, 1 / states), np.full(states, 1 / states), move, np.ascontiguousarray(emit / emit.sum(0))


def maximised(first, resumed, moves, emissions, unigram: np.ndarray) -> Model:
    """The model of most likely entries, with one more start, resumption and move of each kind and ten more emissions."""
    first, resumed, moves, emissions = first + 1, resumed + 1, moves + 1, emissions + 10 * unigram[:, None]
    return first / first.sum(), resumed / resumed.sum(), moves / moves.sum(1, keepdims=True), np.ascontiguousarray(emissions / emissions.sum(0))


def expected(model: Model, grid: np.ndarray, lengths: np.ndarray, first: np.ndarray):
    """Expected starts, resumptions, moves and emissions, and log likelihood, over windows of symbols.

    ``grid`` (T, n) has a window in each column, the longest ones first; ``first`` says
    which begin a text. The state before a window's first token is drawn from the start
    or the resumption.
    """
    start, resume, move, rows = model
    (t_max, n), k = grid.shape, len(start)
    live = np.searchsorted(-lengths, -np.arange(t_max), side="left")  # windows that have a token there
    alpha, e, scale = np.empty((t_max + 1, n, k)), np.empty((t_max, n, k)), np.empty((t_max, n))
    alpha[0] = np.where(first[:, None], start, resume)
    ones, log_likelihood = np.ones(k), 0.0
    for t in range(t_max):
        m = live[t]
        np.take(rows, grid[t, :m], axis=0, out=e[t, :m], mode="clip")
        x = alpha[t, :m] @ move
        x *= e[t, :m]
        scale[t, :m] = x @ ones
        log_likelihood += float(np.log(scale[t, :m]).sum())
        np.divide(x, scale[t, :m, None], out=alpha[t + 1, :m])
    beta, moves, at = np.ones((n, k)), np.zeros((k, k)), 0
    sym, gamma = np.empty(int(live.sum()), np.int64), np.empty((int(live.sum()), k))
    for t in range(t_max - 1, -1, -1):
        m = live[t]
        sym[at : at + m] = grid[t, :m]
        np.multiply(alpha[t + 1, :m], beta[:m], out=gamma[at : at + m])
        at += m
        back = e[t, :m]
        back *= beta[:m]
        back /= scale[t, :m, None]
        moves += alpha[t, :m].T @ back
        beta[:m] = back @ move.T
    begin = alpha[0] * beta
    emissions = np.stack([np.bincount(sym, gamma[:, j], len(rows)) for j in range(k)], axis=1)
    return begin[first].sum(0), begin[~first].sum(0), moves * move, emissions, log_likelihood


def windows_of(symbols: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of texts (their symbols in turn) as ``expected`` takes them, up to ``TOGETHER`` at a time."""
    ends = np.cumsum(sizes)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = (ends - sizes)[owner] + WINDOW * nth
    lengths = np.minimum(WINDOW, ends[owner] - begin)
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        place = begin[some] + np.arange(lengths[some[0]])[:, None]
        yield symbols[np.minimum(place, len(symbols) - 1)].astype(np.int64), lengths[some], nth[some] == 0


def sized(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in turn, and each text's number of symbols."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u2"), np.array([len(x) // 2 for x in raw], np.int64)


def expecter(shared):
    """One pass of Baum-Welch over a partition: (entry of the model, expected count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros(sum(x.size for x in model) + 1)
        for batch in batches:
            for some in windows_of(*sized(batch.column(0))):
                *counts, log_likelihood = expected(model, *some)
                total += np.concatenate([*[c.ravel() for c in counts], [log_likelihood]])
        used = np.flatnonzero(total)
        for at in range(0, len(used), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(used[at : at + 100_000], pa.int64()), pa.array(total[used[at : at + 100_000]])], names=["entry", "count"])

    return run


def by_segments(model: Model, state: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Log10 likelihood of each sequence after a state: transfer matrices of all segments
    advance together, and those of a text are applied in order, scaled at each step."""
    _, _, move, rows = model
    k = len(move)
    owner = np.repeat(np.arange(len(texts)), [-(-len(t) // SEGMENT) for t in texts])
    segments = [t[a : a + SEGMENT] for t in texts for a in range(0, len(t), SEGMENT)]
    lengths = np.array([len(s) for s in segments])
    grid = np.zeros((len(segments), SEGMENT), np.int64)
    grid[np.arange(SEGMENT) < lengths[:, None]] = np.concatenate(segments)
    order = np.argsort(-lengths, kind="stable")  # those still alive come first
    x, grid, logs = np.tile(np.eye(k), (len(segments), 1, 1)), grid[order], np.zeros(len(segments))
    for t in range(int(lengths.max())):
        n = int(np.searchsorted(-lengths[order], -t, side="left"))
        y = (x[:n].reshape(n * k, k) @ move).reshape(n, k, k)
        y *= rows[grid[:n, t]][:, None, :]
        if t % 8 == 7:
            s = y.sum((1, 2))
            y /= s[:, None, None]
            logs[:n] += np.log10(s)
        x[:n] = y
    back = np.argsort(order, kind="stable")
    x, logs = x[back], logs[back]
    first, count = np.searchsorted(owner, np.arange(len(texts))), np.bincount(owner, minlength=len(texts))
    state, out = state.copy(), np.zeros(len(texts))
    for step in range(int(count.max())):
        live = np.flatnonzero(count > step)
        at = first[live] + step
        v = np.einsum("nk,nkj->nj", state[live], x[at])
        s = v.sum(1)
        state[live] = v / s[:, None]
        out[live] += np.log10(s) + logs[at]
    return out


def log10_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each symbol sequence, none empty.

    All texts advance together as far as ``FEW`` of them reach; the rest of those that are
    longer goes by segments.
    """
    start, _, move, rows = model
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    reach = int(sizes[min(FEW, len(texts)) - 1])
    flat, begin = np.concatenate([texts[k] for k in order]).astype(np.int64), np.cumsum(sizes) - sizes
    live = np.searchsorted(-sizes, -np.arange(reach), side="left")
    state, scale = np.tile(start, (len(texts), 1)), np.ones((len(texts), reach))
    for t in range(reach):
        m = live[t]
        x = state[:m] @ move
        x *= rows[flat[begin[:m] + t]]
        scale[:m, t] = x.sum(1)
        np.divide(x, scale[:m, t, None], out=state[:m])
    sorted_out = np.log10(scale).sum(1)
    longer = int(np.searchsorted(-sizes, -reach, side="left"))
    if longer:
        sorted_out[:longer] += by_segments(model, state[:longer], [texts[k][reach:].astype(np.int64) for k in order[:longer]])
    out = np.empty(len(texts))
    out[order] = sorted_out
    return out


def scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(raw, "<u2") for raw in batch.column(batch.num_columns - 1).to_pylist()]
            out, at = np.zeros(len(texts)), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 1_000_000):
                    size += len(texts[to])
                    to += 1
                out[at:to] = log10_likelihoods(shared.value, texts[at:to])
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], "forward"])

    return run


def score(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 5, held_remainder: int = 1, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    small_batches(spark)
    held = remainder(F.col(id_col), mod) == held_remainder
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), held.alias("held_out"), text_or_empty(text_col).alias("text"))
    partial = texts.select("held_out", "text").mapInArrow(counter, "token binary, n bigint, n_all bigint")
    counts = materialise(spark, partial.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")).withColumn("class", class_column()), "word-counts")

    ends = texts.agg(F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).first()[0]
    n_words, n_all, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    total, distinct = n_words + ends, n_distinct + (ends > 0)
    below = total + 0.5 * (distinct + 1)
    is_own = (F.col("n") >= LEAST) & (F.col("n") * OWN_SHARE >= F.lit(n_words))
    class_rows = counts.filter(~is_own).groupBy("class").agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in class_rows:
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    class_below = class_n + 0.5 * (class_v + 1)

    often = (F.col("n_all") * SHARE >= F.lit(n_all)) | is_own
    frequent = counts.filter(often).select("token", "n", is_own.alias("own")).orderBy(F.col("own").desc(), "token").toArrow()  # SHARE and OWN_SHARE words at most
    words, n = frequent.column("token").cast(pa.binary()).combine_chunks(), frequent.column("n").to_numpy().astype(float)
    words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    n_own = int(pc.sum(frequent.column("own")).as_py() or 0)
    of_class = word_classes(words).astype(np.int64)
    as_class = np.arange(len(words)) >= n_own
    symbol = np.where(as_class, n_own + of_class, np.arange(len(words))).astype(np.uint16)
    inner = np.where(as_class, np.log10((n + 0.5) / class_below[of_class]), 0.0)
    shared = spark.sparkContext.broadcast((words, symbol, np.log10((n + 0.5) / below), inner, (n > 0).astype(np.int64)))
    end_base = float(np.log10((ends + 0.5) / below))
    numbered = texts.withColumn("rid", F.monotonically_increasing_id()).select("rid", "id", "held_out", "text")
    coded = materialise(spark, numbered.mapInArrow(coder(shared, n_own, int(ends > 0), end_base), CODED_DDL), "coded")
    shared.destroy()

    unigram = np.concatenate([n[:n_own], class_n, [ends]])
    unigram = (unigram + 0.01) / (unigram + 0.01).sum()
    model = initial(unigram, states)
    edges = np.cumsum([x.size for x in model])
    train = coded.filter("NOT held_out").select("symbols")
    for _ in range(rounds):
        held_model = spark.sparkContext.broadcast(model)
        sums = train.mapInArrow(expecter(held_model), "entry bigint, count double").groupBy("entry").agg(F.sum("count").alias("count")).toArrow()
        held_model.destroy()
        flat = np.zeros(edges[-1] + 1)
        flat[sums.column("entry").to_numpy()] = sums.column("count").to_numpy()
        counted = [part.reshape(x.shape) for part, x in zip(np.split(flat, edges)[:4], model)]
        model = maximised(*counted, unigram)

    held_model = spark.sparkContext.broadcast(model)
    scored = coded.select("rid", "id", "held_out", "n_tokens", "n_known", "base", "inner", "symbols").mapInArrow(scorer(held_model), "rid bigint, id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, inner double, forward double")
    seldom = counts.filter(~often)
    size = F.element_at(F.array(*[F.lit(float(x)) for x in class_below]), F.col("class") + 1)
    seldom = seldom.select("token", (F.col("n") > 0).cast("long").alias("known"), F.log10((F.col("n") + 0.5) / below).alias("b"), F.log10((F.col("n") + 0.5) / size).alias("i"))
    spots = coded.select("rid", F.explode("rare").alias("r")).select("rid", "r.token", F.col("r.n").alias("times"))
    rare = spots.join(seldom, "token").groupBy("rid").agg(F.sum(F.col("known") * F.col("times")).alias("rk"), F.sum(F.col("b") * F.col("times")).alias("rb"), F.sum(F.col("i") * F.col("times")).alias("ri"))
    out = scored.join(rare, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rk", F.lit(0).cast("long"))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("rb"))).alias("base_score"), (F.col("forward") + F.col("inner") + zero(F.col("ri"))).alias("score"),
    )


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, read_table(spark, sf_dir, "documents"))
