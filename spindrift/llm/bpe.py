"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary
entry as a whole gets its id with two hashes and one comparison. Tier two merges the
bytes of any other pre-token: a heap of adjacent pairs by rank over a doubly linked list,
O(n log n) for n bytes. A bounded cache in front spares repeated pre-tokens.

Cases: a null text counts as empty; an empty text has no ids; texts and pre-tokens of any
length are encoded whole; repeated rows give equal results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import read_table, small_batches, text_or_empty

#: Pre-tokens that a worker remembers.
CACHE = 600_000


class PerfectHash:
    """Minimal perfect hash by displacement: keys in small buckets, each with the seed
    that sends its keys to free slots; lookups verify the key itself."""

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.seeds = [0] * (self.n // 4 + 1)
        self.slots: list[int] = [-1] * self.n
        self.keys = keys
        buckets: dict[int, list[int]] = {}
        for k, key in enumerate(keys):
            buckets.setdefault(zlib.crc32(key) % len(self.seeds), []).append(k)
        free = iter(())
        for bucket, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:  # the last ones take the slots that are left, by number
                if not isinstance(free, list):
                    free = [s for s in range(self.n) if self.slots[s] < 0]
                slot = free.pop()
                self.seeds[bucket] = -slot - 1
                self.slots[slot] = members[0]
                continue
            seed = 1
            while True:
                places = {self.place(keys[k], seed) for k in members}
                if len(places) == len(members) and all(self.slots[p] < 0 for p in places):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for k in members:
                self.slots[self.place(keys[k], seed)] = k

    def place(self, key: bytes, seed: int) -> int:
        x = (zlib.adler32(key, seed) << 32 | zlib.crc32(key, seed)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return (x >> 29) % self.n

    def __call__(self, key: bytes) -> int:
        """The key's number, or -1."""
        seed = self.seeds[zlib.crc32(key) % len(self.seeds)]
        if not seed:
            return -1
        k = self.slots[-seed - 1 if seed < 0 else self.place(key, seed)]
        return k if k >= 0 and self.keys[k] == key else -1


class Codec(dict):
    """Pre-token -> its ids as little-endian 32-bit numbers; missing ones are worked out."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import regex

        with open(path, "rb") as f:
            entries = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        self.split = regex.compile(pattern).findall
        self.whole = PerfectHash([key for key, _ in entries])
        self.ids = [rank for _, rank in entries]
        self.ranks = dict(entries)
        self.by_id = dict((rank, key) for key, rank in entries)

    def __missing__(self, token: str) -> bytes:
        raw = token.encode()
        k = self.whole(raw)
        ids = [self.ids[k]] if k >= 0 else self.merge(raw)
        packed = np.array(ids, "<u4").tobytes()
        if len(token) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[token] = packed
        return packed

    def merge(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, until no adjacent pair is an entry."""
        n, ranks = len(raw), self.ranks
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i]
            if end[i] < 0 or j >= n or end[j] != stop or end[i] != j:  # one of the two has changed
                continue
            k = after[i] = after[j]
            end[i], end[j] = stop, -1
            if k < n:
                before[k] = i
                if (r := ranks.get(raw[i : end[k]])) is not None:
                    heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(raw[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """One for each worker process, kept over its tasks."""
    import public_tokenizers

    return Codec(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id and ids (array of bigint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            coded = [c.encode(t).astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.list_(pa.int64()))], names=["id", "ids"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, ids array<bigint>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and bytes of each row of ids; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            raw = [b"".join(map(c.by_id.__getitem__, x or [])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "bytes"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    return rows.mapInArrow(run, "id bigint, bytes binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass: id, n_tokens and digests of the ids and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, ids_hex, raw_hex = [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text)
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(ids.tobytes()).hexdigest())
                raw_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(raw_hex)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return round_trip(read_table(spark, sf_dir, "documents"))
