"""Document fingerprints by locally consistent parsing.

Each level of the parse collapses runs of equal names, reduces the names by deterministic
coin tossing (position and value of the lowest bit in which a name differs from the one
before it) to a few labels, and cuts phrases at the labels' local maxima. A phrase's name
is a hash of what it holds. Cuts depend on a few neighbours only, so equal substrings get
equal names in their interior, wherever they stand. A fingerprint keeps, for three levels,
the ``KEEP`` smallest distinct phrase hashes; likeness is the bottom-k estimate of the
Jaccard index at the highest level where both have enough phrases, whatever their sizes.

Cases: a null text counts as empty; two empty texts have likeness 1, an empty and another
0; texts of any length are parsed whole; equal texts have equal fingerprints; rows with
one id follow one another by a hash of their text; a null id comes last; in a table of one
row that row is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import partitions, read_table, small_batches, text_or_empty

KEEP = 64
LEVELS = 3
#: A level counts if both texts have this many phrases in it.
ENOUGH = 6
#: Code points parsed at a time, so that the arrays stay in the processor's caches.
BLOCK = 1 << 17

BASE = 0x9E3779B97F4A7C15 | 1
POWERS = np.array([pow(BASE, k, 1 << 64) for k in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Deterministic coin tossing against the left neighbour; the first name of a text keeps its lowest bit."""
    d = np.empty_like(x)
    d[0] = 1
    np.bitwise_xor(x[1:], x[:-1], out=d[1:])
    d[first] = 1
    low = np.bitwise_count((d & (~d + d.dtype.type(1))) - d.dtype.type(1))
    return (low << np.uint8(1)) + ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)


def parse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases, and where each text's phrases start.

    ``starts``: where the texts start in ``names``; each has one name at least.
    """
    new = np.empty(len(names), bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[starts] = True
    at = np.flatnonzero(new)
    runs = np.diff(at, append=len(names)).astype(np.uint64)
    x = mix(names[at] + (runs - np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    first = np.searchsorted(at, starts)
    label = x
    for _ in range(3):
        label = toss(label, first)
    cut = np.zeros(len(x), bool)
    if len(x) > 2:
        np.greater(label[1:-1], label[:-2], out=cut[1:-1])
        cut[1:-1] &= label[1:-1] > label[2:]
    cut[first[1:] - 1] = False  # a text's last name has no right neighbour
    cut[first] = True
    cut_at = np.flatnonzero(cut)
    place = np.arange(len(x)) - np.repeat(cut_at, np.diff(cut_at, append=len(x)))
    phrases = mix(np.add.reduceat(x * POWERS[place & 63], cut_at) + np.uint64(1))
    return phrases, np.searchsorted(cut_at, first)


def smallest(names: np.ndarray) -> str:
    """The ``KEEP`` smallest distinct hashes, 8 hex digits each."""
    top = (names >> np.uint64(32)).astype(">u4")
    if len(top) > 4 * KEEP:
        low = np.unique(top[top <= np.partition(top, 3 * KEEP)[3 * KEEP]])
        if len(low) >= KEEP:
            return low[:KEEP].astype(">u4").tobytes().hex()
    kept = np.unique(top)
    return kept[:KEEP].astype(">u4").tobytes().hex()


def fingerprints(texts: list[str]) -> list[str]:
    out = [".." for _ in texts]
    full = [k for k, t in enumerate(texts) if t]
    while full:
        some, size = [], 0
        while full and (not some or size + len(texts[full[-1]]) <= BLOCK):
            size += len(texts[full[-1]])
            some.append(full.pop())
        names = np.frombuffer("".join(texts[k] for k in some).encode("utf-32-le"), "<u4").astype(np.uint64)
        starts = np.cumsum([0] + [len(texts[k]) for k in some[:-1]])
        parts: list[list[str]] = [[] for _ in some]
        for _ in range(LEVELS):
            names, starts = parse(names, starts)
            for part, a, b in zip(parts, starts, [*starts[1:], len(names)]):
                part.append(smallest(names[a:b]))
        for k, part in zip(some, parts):
            out[k] = ".".join(part)
    return out


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    levels = [[{x[k : k + 8] for k in range(0, len(x), 8)} for x in f.split(".")] for f in (a, b)]
    pick = [(x, y) for x, y in zip(*levels) if x and y]
    if not pick:
        return 0.0
    x, y = next(((x, y) for x, y in pick[::-1] if min(len(x), len(y)) >= ENOUGH), pick[0])
    union = x | y
    if len(x) == KEEP or len(y) == KEEP:  # the smallest of both sets' union are known up to the smaller end
        union = set(sorted(union)[:KEEP])
    return len(x & y & union) / len(union)


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


OUT_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str, str]]]:
    """(id, text, next text) in lists; rows come by bucket in order, and each bucket ends
    with the row that begins the next one."""
    held = None
    for batch in batches:
        out = []
        for bucket, halo, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if held is not None and held[0] == bucket:
                out.append((held[1], held[2], text))
            held = None if halo else (bucket, doc_id, text)
        yield out


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[str | None, str] = (None, "")  # a text that is next is mostly the next text
    for rows in with_next(batches):
        if not rows:
            continue
        texts = [t for _, t, _ in rows]
        changed = [edited(t, n) for _, t, n in rows]
        own, other, final = fingerprints(texts), fingerprints(changed), fingerprints([rows[-1][2]])[0]
        following = [own[k + 1] if k + 1 < len(rows) and rows[k][2] is texts[k + 1] else final if k + 1 == len(rows) else fingerprints([rows[k][2]])[0] for k in range(len(rows))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(own), pa.array(other),
             pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, following)], pa.float64())],
            schema=OUT,
        )


def in_order(spark: SparkSession, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, halo, id, text) by descending id, each bucket followed by the first row
    of the one after it, that of the last bucket by the first of all.

    Only the edges of buckets come to the driver: one number for each.
    """
    from pyspark.ml.feature import Bucketizer

    n = partitions(spark)
    key = F.coalesce(-F.col("id").cast("double"), F.lit(float("inf")))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    edges = rows.select(key.alias("key")).filter("key < double('inf')").approxQuantile("key", [k / (4 * n) for k in range(1, 4 * n)], 1 / (16 * n))
    splits = [-float("inf"), *sorted(set(edges)), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    bucketed = Bucketizer(splits=splits, inputCol="key", outputCol="bucket").transform(rows.withColumn("key", key)).withColumn("bucket", F.col("bucket").cast("int"))
    heads = bucketed.groupBy("bucket").agg(F.max("id").alias("head")).orderBy("bucket").collect()
    if not heads:
        return bucketed.select("bucket", F.lit(False).alias("halo"), "id", "text")
    follow = [(heads[k]["bucket"], heads[(k + 1) % len(heads)]["head"]) for k in range(len(heads))]
    table = spark.createDataFrame(follow, "to int, head bigint")
    halo = rows.join(F.broadcast(table), F.col("id").eqNullSafe(F.col("head"))).select(F.col("to").alias("bucket"), F.lit(True).alias("halo"), "id", "text")
    every = bucketed.select("bucket", F.lit(False).alias("halo"), "id", "text").unionByName(halo)
    return every.repartition(n, "bucket").sortWithinPartitions("bucket", "halo", F.col("id").desc_nulls_last(), F.xxhash64("text"))


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = in_order(spark, read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.mapInArrow(neighbours, OUT_DDL)
