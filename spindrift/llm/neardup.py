"""Near-duplicate detection by HyperMinHash sketches, banding and full verification.

Each text's set of word shingles gives ``REGISTERS`` registers; a register holds the
leading-zero count and ten mantissa bits of the smallest of the set's hash values under
its own hash function. Texts with equal sets are one class. Bands of registers propose
pairs of classes; the Jaccard estimate, corrected for registers that agree by chance,
and the bound that the sets' sizes set drop those far off; the rest are verified on full shingle sets.

A band with many classes proposes no pairs among all of them. Its classes meet one hub, the
first in one of ``HUBS`` orders, so a class that shares many bands with a group meets
several of its members. Wherever the members of a band still span several components, those
outside the largest are compared with all others, by finer sketches and in blocks; what
met its hub before is not compared again. Two blocks propose no pair of classes that other
verified links of theirs connect. So no link between different components of one band is missed,
and groups of copies stay linear.

Cases: null texts and texts without words have the empty set and link with nothing; a text
of fewer words than a shingle is one shingle; texts of any length count whole; repeated
rows are equal sets; the component of a null id is by the other ids of its class, or null;
of rows that repeat id and text ``deduplicate`` leaves one, whichever, while rows of one id
(or none) with different texts share its verdict; an empty table gives no rows; other
columns are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import discard, lookup, materialise, may_hold, read_table, small_batches, text_or_empty
from spindrift.llm.components import components
from spindrift.llm.fingerprint import mix

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Registers of the finer sketches that whole bands are compared by.
FINE = 4 * REGISTERS
#: Sets of up to so many shingles go along whole with the finer sketches, to be verified there.
WHOLE = 256
#: A pair is verified if its estimate is no more standard errors below the threshold than this.
ERRORS = 4
#: Members that meet one copy of their hub.
SALT = 64
#: Bands' classes compared at a time in the last step.
BLOCK = 256
#: Hubs that the classes of a band's group meet: bands are dealt to so many orders of the classes.
HUBS = 4
#: Bytes hashed at a time.
BYTES = 1 << 20

MULTIPLIERS = mix(np.arange(1, FINE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BYTE_HASH = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
STEP = 0x9E3779B97F4A7C15 | 1
BACK = pow(STEP, -1, 1 << 64)
#: Columns of the rows that blocks are compared by.
CELL = ("band", "outer", "inner", "role", "cls", "sketch", "own", "part", "n")


def geometric(step: int, n: int) -> np.ndarray:
    x = np.full(n, step, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


class Shingles:
    """Hashes of the shingles of many texts at once."""

    def __init__(self, words: int):
        self.words = words
        self.forth, self.back = geometric(STEP, 1), geometric(BACK, 1)

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """For each text the hashes of its shingles, with repeats."""
        raw = b" ".join(texts) + b" "
        if len(self.forth) <= len(raw):
            self.forth, self.back = geometric(STEP, 2 * len(raw)), geometric(BACK, 2 * len(raw))
        data = np.frombuffer(raw, np.uint8)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_HASH[data] * self.forth[: len(raw)], out=sums[1:])
        space = SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        word = mix((sums[end] - sums[start]) * self.back[start])
        sizes = np.array([len(t) + 1 for t in texts])
        first = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
        k = self.words
        x = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for j in range(k if len(x) else 0):
            x += word[j : len(word) - k + 1 + j] * np.uint64(pow(STEP, j + 1, 1 << 64))
        x = mix(x)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield x[a : b - k + 1]
            elif b > a:
                whole = sum(int(w) * pow(STEP, 7 * j + 3, 1 << 64) for j, w in enumerate(word[a:b])) + int(b - a)
                yield mix(np.array([whole & 0xFFFFFFFFFFFFFFFF], np.uint64))
            else:
                yield x[:0]


def least_estimate(threshold: float, registers: int) -> float:
    return threshold - ERRORS * (threshold * (1 - threshold) / registers) ** 0.5


def sketches(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """Registers of non-empty sets: (len(sets), registers) of 16 bits."""
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((registers, len(sets)), np.uint64)
    for k, a in enumerate(MULTIPLIERS[:registers]):
        np.minimum.reduceat(every * a, starts, out=least[k])
    exponent = np.frexp(least.astype(np.float64))[1].clip(1, 64)
    zeros = (64 - exponent).astype(np.uint64)
    mantissa = (least << zeros) >> np.uint64(63 - MANTISSA) & np.uint64((1 << MANTISSA) - 1)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype("<u2").T.copy()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers, less what agrees by chance: of two different
    smallest values in about the same octave one in 2**MANTISSA agrees."""
    same = (a == b).mean(axis=-1)
    chance = 1 / 3 / (1 << MANTISSA)
    return (same - chance) / (1 - chance)


def by_bytes(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BYTES`` together, or of one longer text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BYTES):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def sketcher(words: int):
    schema = pa.schema([("id", pa.int64()), ("tkey", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            texts = [t.lower() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            for at, to in by_bytes(texts):
                sets = [np.unique(s) for s in shingles(texts[at:to])]
                full = [k for k, s in enumerate(sets) if len(s)]
                sketch: list[bytes | None] = [None] * len(sets)
                if full:
                    for k, row in zip(full, sketches([sets[k] for k in full])):
                        sketch[k] = row.tobytes()
                cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), keys.slice(at, to - at), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(sketch, pa.binary())], schema=schema)

    return run


def fine_sketcher(words: int):
    """Of each text with a small set the sketch and the set, of others the finer sketch and nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            texts = [t.lower() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for at, to in by_bytes(texts):
                sets = [np.unique(s) for s in shingles(texts[at:to])]
                sketch: list[bytes] = [b""] * len(sets)
                for registers in (REGISTERS, FINE):
                    some = [k for k, s in enumerate(sets) if (len(s) <= WHOLE) == (registers == REGISTERS)]
                    if some:
                        for k, row in zip(some, sketches([sets[k] for k in some], registers)):
                            sketch[k] = row.tobytes()
                own = [s.tobytes() if len(s) <= WHOLE else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(sketch, pa.binary()), pa.array(own, pa.binary())], names=["cls", "sketch", "own"])

    return run


def holds(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets, none empty, are linked."""
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def beside_hubs(batches: Iterator[pa.RecordBatch], linked) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, role, b, payload), a hub's own (role 0) before its members': pairs that
    ``linked`` accepts. Holds one hub at a time."""
    hub, own = None, None
    for batch in batches:
        out = []
        for a, role, b, payload in zip(*(batch.column(n).to_pylist() for n in ("a", "role", "b", "payload"))):
            if role == 0:
                hub, own = a, payload
            elif hub == a and linked(own, payload, hub):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])


def by_sketch(threshold: float):
    def run(batches):
        least = least_estimate(threshold, REGISTERS)
        linked = lambda x, y, _: estimate(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")) >= least
        return beside_hubs(batches, linked)

    return run


def by_set(words: int, percent: int):
    def run(batches):
        shingles, held = Shingles(words), {}

        def linked(x: str, y: str, hub: bytes) -> bool:
            if held.get("hub") != hub:
                held.update(hub=hub, set=np.unique(next(shingles([x.encode().lower()]))))
            return holds(held["set"], np.unique(next(shingles([y.encode().lower()]))), percent)

        return beside_hubs(batches, linked)

    return run


def compare(spark: SparkSession, pairs: DataFrame, payload: DataFrame, run, name: str) -> DataFrame:
    """Pairs (a, b) that ``run`` accepts, given ``payload`` (cls, payload) of both ends.

    A hub's members are dealt by salts of ``SALT``; each salt gets one copy of the hub's
    payload, so neither a hot hub nor its copies land in one task.
    """
    fan = materialise(spark, pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts")), f"{name}-fan")
    hubs = fan.join(payload, F.col("a") == F.col("cls")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("b"), "payload")
    # A class is the end of few pairs (one for each hub order of each of its bands), a hub of any number.
    dealt = lookup(pairs, fan, "a", "n", fan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    salted = dealt.join(payload, F.col("b") == F.col("cls")).select("a", "salt", F.lit(1).alias("role"), "b", "payload")
    both = hubs.unionByName(salted).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    out = materialise(spark, both.mapInArrow(run, "a binary, b binary"), name)
    discard(spark, fan)
    return out


class Joined:
    """Which components the links of two blocks connect."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: bytes, y: bytes) -> None:
        self.up[self.root(x)] = self.root(y)


def in_cells(percent: int):
    """Rows (band, outer, inner, role, cls, sketch, own, part, n) sorted by cell: the first three.

    Compares a cell's outer classes (role 1) with its inner ones (role 2); a class may be
    both (3). Gives links of small sets that connect all components they can, verified
    here, and the pairs of other components that may hold where a set is large. Holds one
    cell at a time, of about two blocks at most.
    """
    coarse, fine = (least_estimate(percent / 100, r) for r in (REGISTERS, FINE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for row in zip(*(batch.column(n).to_pylist() for n in CELL)):
                if row[:3] != key:
                    found += pairs(held)
                    key, held = row[:3], []
                held.append(row[3:])
            yield table(found)
        yield table(pairs(held))

    def table(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def pairs(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        outer, inner = ([k for k, r in enumerate(rows) if r[0] & side] for side in (1, 2))
        if not outer or not inner:
            return []
        _, cls, sketch, own, part, n = zip(*rows)
        x = np.frombuffer(b"".join(s[: 2 * REGISTERS] for s in sketch), "<u2").reshape(len(rows), -1)
        y, places, sets = x[inner], np.array(inner), [np.frombuffer(s, np.uint64) for s in own]
        sizes, joined, links, open_ = np.array(n)[inner], Joined(), [], []
        for k in outer:
            near = (estimate(x[k], y) >= coarse) & (100 * np.minimum(sizes, n[k]) >= percent * np.maximum(sizes, n[k]))
            for j in places[near]:
                if joined.root(part[k]) == joined.root(part[j]):
                    continue
                if not own[k] or not own[j]:
                    open_.append((k, j))
                elif holds(sets[k], sets[j], percent):
                    joined.join(part[k], part[j])
                    links.append((cls[k], cls[j]))
        for k, j in open_:
            if joined.root(part[k]) == joined.root(part[j]):
                continue
            if own[k] or own[j] or estimate(np.frombuffer(sketch[k], "<u2"), np.frombuffer(sketch[j], "<u2")) >= fine:
                links.append((cls[k], cls[j]))
        return links

    return run


class Finder:
    """Links between classes, found round by round."""

    def __init__(self, spark: SparkSession, texts: DataFrame, classes: DataFrame, words: int, percent: int):
        self.spark, self.texts, self.classes, self.words, self.percent = spark, texts, classes, words, percent
        self.sketch = classes.select("cls", F.col("sketch").alias("payload"))
        self.links: DataFrame | None = None

    def verify(self, pairs: DataFrame, name: str) -> int:
        """Adds the pairs that hold; says how many."""
        spark = self.spark
        ordered = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b").groupBy("x", "y").agg(F.min("a").alias("a"), F.max(F.struct("a", "b")).alias("ab"))
        pairs = materialise(spark, ordered.select("ab.a", "ab.b"), f"pairs-{name}")
        near = compare(spark, pairs, self.sketch, by_sketch(self.percent / 100), f"near-{name}")
        discard(spark, pairs)
        if not near.limit(1).count():
            return 0
        text = self.texts_of(near.select(F.explode(F.array("a", "b")).alias("cls")), name)
        more = compare(spark, near, text, by_set(self.words, self.percent), f"links-{name}")
        discard(spark, near, text)
        self.links = more if self.links is None else self.links.unionByName(more)
        return more.count()

    def texts_of(self, some: DataFrame, name: str) -> DataFrame:
        """(cls, payload): the text of one row of each class in ``some``."""
        need = some.distinct().join(self.classes.select("cls", "first"), "cls").select("cls", "first.id", "first.tkey")
        need = materialise(self.spark, need, f"need-{name}")
        rows = may_hold(self.texts, "tkey", need.select("tkey"))
        named = need.select("cls", F.col("id").alias("_id"), F.col("tkey").alias("_tkey"))
        found = rows.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey"))).select("cls", F.col("text").alias("payload"))
        out = materialise(self.spark, found.dropDuplicates(["cls"]), f"texts-{name}")
        discard(self.spark, need)
        return out

    def parts(self, members: DataFrame) -> DataFrame:
        """``members`` (band, cls) with the component of each class so far, of bands that span several."""
        if self.links is None:
            with_part = members.withColumn("part", F.col("cls"))
        else:
            found = components(self.spark, self.links)
            with_part = members.join(found, F.col("cls") == F.col("node"), "left").select("band", "cls", F.coalesce("component", "cls").alias("part"))
        with_part = materialise(self.spark, with_part, "parts")
        # Largest component and number of members of each band, combined before each shuffle.
        sizes = with_part.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"))
        bands = sizes.groupBy("band").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "part")).alias("largest"))
        bands = materialise(self.spark, bands.filter("parts > 1").select("band", "m", F.col("largest.part").alias("main"), F.col("largest.n").alias("n_main")), "bands")
        return lookup(with_part, bands, "band", "m", with_part.count()).filter("m IS NOT NULL")

    def blocks(self, left: DataFrame) -> DataFrame:
        """Pairs of classes outside a band's largest component with others of the band, ``BLOCK`` by ``BLOCK``."""
        text = self.texts_of(left.select("cls"), "fine")
        fine = materialise(self.spark, text.mapInArrow(fine_sketcher(self.words), "cls binary, sketch binary, own binary"), "fine")
        discard(self.spark, text)
        known = fine.join(self.classes.select("cls", F.col("n_shingles").alias("n")), "cls")
        # Cells of outer and inner blocks; each class goes once to every cell that needs it.
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        own = lambda n: F.pmod(F.xxhash64("cls"), blocks(n)).cast("int")
        dealt = left.withColumn("rest", F.col("m") - F.col("n_main")).select("band", "cls", "part", (F.col("part") != F.col("main")).alias("is_outer"), blocks("m").alias("n_inner"), blocks("rest").alias("n_outer"), own("m").alias("at_inner"), own("rest").alias("at_outer"))
        cell = "named_struct('outer', {}, 'inner', {}, 'role', {})"
        across = "transform(sequence(0, n_inner - 1), i -> " + cell.format("at_outer", "i", "if(i = at_inner, 3, 1)") + ")"
        down = "transform(filter(sequence(0, n_outer - 1), o -> NOT is_outer OR o <> at_outer), o -> " + cell.format("o", "at_inner", "2") + ")"
        cells = dealt.select("band", "cls", "part", F.explode(F.expr(f"if(is_outer, concat({across}, {down}), {down})")).alias("c")).select("band", "c.*", "cls", "part")
        rows = cells.join(known, "cls").select(*CELL).repartition("band", "outer", "inner").sortWithinPartitions("band", "outer", "inner")
        return rows.mapInArrow(in_cells(self.percent), "a binary, b binary")


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: id, tkey, n_shingles, component_id, kept."""
    small_batches(spark)
    text = text_or_empty(text_col)
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    rows = materialise(spark, texts.mapInArrow(sketcher(words), "id bigint, tkey bigint, n_shingles bigint, cls binary, sketch binary"), "sketches")
    sized = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("id", "tkey")).alias("first"), F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    classes = materialise(spark, sized, "classes")

    bands = F.array(*[F.struct(F.xxhash64(F.lit(k), F.substring("sketch", 2 * ROWS * k + 1, 2 * ROWS)).alias("band"), F.lit(k % HUBS).alias("order")) for k in range(BANDS)])
    each = classes.select("cls", F.explode(bands).alias("b")).select("cls", "b.*")
    ranked = each.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("cls", "order"), "cls")).alias("h"))
    shared = ranked.filter("m > 1").select("band", "m", F.col("h.cls").alias("hub"))
    shared = materialise(spark, shared, "shared-bands")
    members = lookup(each, shared, "band", "m", BANDS * classes.count()).filter("m IS NOT NULL")
    members = materialise(spark, members, "members")
    finder = Finder(spark, texts, classes, words, percent)
    finder.verify(members.filter("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "0")

    # What no hub joins: all other members of a band, if they are in several components.
    left = finder.parts(members.filter("m > 2 AND cls <> hub").select("band", "cls"))
    if left.limit(1).count():
        finder.verify(finder.blocks(left), "rest")

    if finder.links is None:
        ends = classes.select("cls", F.col("cls").alias("part"))
    else:
        ends = classes.select("cls").join(components(spark, finder.links), F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("part"))
    named = classes.select("cls", "least", "size").join(ends, "cls")
    smallest = named.groupBy("part").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    n_classes = classes.count()
    named = lookup(named.select("cls", "size", "part"), materialise(spark, smallest, "smallest"), "part", "n", n_classes).select("cls", "size", "component_id")
    full = rows.filter("cls IS NOT NULL").select("id", "tkey", "n_shingles", "cls")
    out = lookup(full, materialise(spark, named, "named"), "cls", "size", full.count())
    alone = rows.filter("cls IS NULL").select("id", "tkey", "n_shingles", F.col("id").alias("component_id"))
    every = out.select("id", "tkey", "n_shingles", "component_id").unionByName(alone)
    return every.select(F.col("id").alias(id_col), "tkey", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Rows of ``df`` that stay, one of each component, with all their columns."""
    found = near_duplicates(spark, df, id_col, text_col, **limits)
    stay = found.filter("kept").groupBy(F.col(id_col).alias("_sd_id"), F.col("tkey").alias("_sd_tkey")).agg(F.count(F.lit(1)).alias("_sd_n"))
    stay = materialise(spark, stay, "staying")
    here = df.withColumn("_sd_own", F.xxhash64(text_or_empty(text_col)))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_sd_id")) & (F.col("_sd_own") == F.col("_sd_tkey"))
    once = here.join(stay.filter("_sd_n = 1"), same, "left_semi")
    # One of the rows that repeat id and text, combined before their shuffle.
    several = here.join(stay.filter("_sd_n > 1"), same, "left_semi").dropDuplicates([id_col, "_sd_own"])
    return once.unionByName(several).drop("_sd_own")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, read_table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM shingles),
each AS (SELECT doc_id, unnest(s) AS x FROM shingles),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id) + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM sizes s JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""
