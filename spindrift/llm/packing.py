"""Best-fit packing of tokenised documents into sequences of bounded length.

Each partition packs its own pieces best-fit, longest first, and emits the bins that are
nearly full. Underfull bins are items of the next round: groups of up to ``GROUP`` of
them are packed best-fit again, until one group is left or a round merges nothing. A
task thus holds at most the small piece records of its partition, or ``GROUP`` bins.

Cases: a null text counts as empty; an empty text is one piece of one token; documents
of over ``capacity`` tokens are cut, the first piece being the shorter one; repeated rows
are documents of their own; items of equal size, and bins of equal room, go by the order
in which they came, so which of them share a sequence is open, the number of sequences of
one partitioning is not; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import materialise, read_table, small_batches, text_or_empty

CAPACITY = 2048
#: A bin with at most this much room is nearly full.
SLACK = 4
#: Bins that one task of a later round packs.
GROUP = 20_000

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BINS = pa.schema([("full", pa.bool_()), ("bin", pa.int64()), ("used", pa.int32()), ("pieces", pa.list_(PIECE))])
BINS_DDL = "full boolean, bin bigint, used int, pieces array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


class Ids:
    """The JSON tokenizer's ids: by its rank file, which has the same merges and runs several
    times faster; a text that holds the special token's string goes to the JSON tokenizer."""

    special = "<|endoftext|>"

    def __init__(self, json_path: str | None = None, rank_path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def __call__(self, text: str) -> list[int]:
        if self.special not in text:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece may be short."""
    first = len(ids) % capacity or capacity
    edges = [0, *range(first, len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def best_fit(items: list[tuple[int, list]], capacity: int = CAPACITY) -> list[tuple[int, list]]:
    """Bins (used, contents) for items (size, contents): longest first, each into the fullest bin that takes it."""
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    bins: list[tuple[int, list]] = []
    for size, contents in sorted(items, key=lambda x: -x[0]):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
            bins[k] = (bins[k][0] + size, bins[k][1] + contents)
            room -= size
        else:
            k, room = len(bins), capacity - size
            bins.append((size, contents))
        if room:
            insort(rooms, (room, k))
    return bins


def bin_batches(bins: list[tuple[int, list]], round_no: int, part: int, capacity: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(bins), 10_000):
        some = bins[at : at + 10_000]
        number = (round_no << 56) + (part << 28) + at
        yield pa.RecordBatch.from_arrays(
            [pa.array([capacity - u <= SLACK for u, _ in some]), pa.array(range(number, number + len(some)), pa.int64()), pa.array([u for u, _ in some], pa.int32()), pa.array([c for _, c in some], BINS.field(3).type)],
            schema=BINS,
        )


def local_packer(capacity: int, json_path: str | None, rank_path: str | None):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = Ids(json_path, rank_path), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = np.array([*ids(text), 0], "<u4")
                items += [(length, [(doc_id, piece, start, length, crc)]) for piece, start, length, crc in cut(coded, capacity)]
        yield from bin_batches(best_fit(items, capacity), 0, TaskContext.get().partitionId(), capacity)

    return pack


def merger(round_no: int, capacity: int):
    def merge(key, table):
        pieces = [[tuple(p.values()) for p in x] for x in table.column("pieces").to_pylist()]
        bins = best_fit(list(zip(table.column("used").to_pylist(), pieces)), capacity)
        return pa.Table.from_batches(bin_batches(bins, round_no, key[0].as_py(), capacity), schema=BINS)

    return merge


def pack(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    bins = materialise(spark, rows.mapInArrow(local_packer(capacity, json_path, rank_path), BINS_DDL), "bins-0")
    done, left = [bins.filter("full")], bins.filter("NOT full")
    n, round_no = left.count(), 0
    while n > 1:
        round_no += 1
        groups = -(-n // GROUP)
        # A group takes bins of all sizes: they are dealt by a hash of their number.
        dealt = left.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(round_no)), F.lit(groups)).cast("long"))
        merged = materialise(spark, dealt.groupBy("g").applyInArrow(merger(round_no, capacity), BINS_DDL), f"bins-{round_no}")
        done.append(merged.filter("full"))
        left = merged.filter("NOT full")
        before, n = n, left.count()
        if groups == 1 or n >= before:
            break
    done.append(left)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    # Places in a sequence: what its pieces before take up.
    before = F.transform("pieces", lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice("pieces", 1, i), F.lit(0).cast("long"), lambda a, q: a + q["length"]).alias("offset")))
    each = every.select(F.col("bin").alias("sequence_id"), F.explode(before).alias("x"))
    return each.select(F.col("x.p.doc_id").alias(id_col), "x.p.piece", "x.p.start", "x.p.length", "x.p.ids_crc32", "sequence_id", "x.offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(spark, read_table(spark, sf_dir, "documents"))
