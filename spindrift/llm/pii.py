"""Personal data: patterned entities, and terms that reveal them by co-occurrence.

Entities (mail and network addresses, card and phone numbers) are found with fixed
patterns. Over the whole corpus, with N rows, an entity c in n_c rows, a term t in n_t
rows and both anywhere in n_ct rows (each row counts in all four, repeated ones too, so a
corpus given twice has the same disclosures), the disclosure of c by t is

    PMI(c; t) / IC(c) = log(N n_ct / (n_c n_t)) / log(N / n_c)

which is 1 where t is seen with c alone. With the support of ``min_support`` distinct
texts, a term at ``remove_at`` or above is removed wherever it stands in the rows that
hold that entity, one at ``generalise_at`` or above gives way to ``[TERM]``.

Cases: a null text counts as empty; empty texts have no spans; texts of any length are
read whole in linear time, as are long words; repeated rows give equal results and, as one
text, support nothing; of terms with equal disclosure all go; an empty table gives no rows; other columns are ignored by ``find_pii`` and kept
by ``sanitise``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import discard, lookup, materialise, may_hold, read_table, small_batches, text_or_empty

# The base kinds in their order.
KINDS = ["email", "ip", "card", "phone"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
#: Size of the filter over term hashes that pass two broadcasts: 2**20 bits, whatever the corpus.
FILTER_BITS = 1 << 20
#: Distinct terms that pass two counts before it hands them on.
FLUSH = 100_000


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, from each @ outwards, so that long runs cost no more than once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", last if found else at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            yield m.span()


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's rank, start, end) by kind, then start."""
    return [(k, a, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)]


def entity(kind: int, value: str) -> int:
    """A number for the entity behind a mention: numbers by their digits, addresses in lower case."""
    plain = value.lower() if kind < 2 else re.sub("[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def places(text: str) -> dict[str, list[tuple[int, int]]]:
    """Where each term of a text stands, but for those that touch a base span."""
    out: dict[str, list[tuple[int, int]]] = {}
    taken = sorted((a, b) for _, a, b in base_spans(text))
    at, reached = 0, 0
    for m in TERM.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reached = max(reached, taken[at][1])
            at += 1
        if m.start() >= reached:
            out.setdefault(m[0].lower(), []).append(m.span())
    return out


SCAN = pa.schema([("id", pa.int64()), ("tkey", pa.int64()), ("spans", pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))), ("entities", pa.list_(pa.int64()))])
SCAN_DDL = "id bigint, tkey bigint, spans array<struct<rank:int,start:int,end:int>>, entities array<bigint>"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, entities = [], []
        for text in batch.column(2).to_pylist():
            found = base_spans(text)
            spans.append([{"rank": k, "start": a, "end": b} for k, a, b in found])
            entities.append(list({entity(k, text[a:b]) for k, a, b in found}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, SCAN.field(2).type), pa.array(entities, SCAN.field(3).type)], schema=SCAN)


def pair_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (entity, term, rows, texts) over distinct texts (text, rows, entities)."""
    rows, support = Counter(), Counter()

    def give():
        keys = list(support)
        return pa.RecordBatch.from_arrays([pa.array([e for e, _ in keys], pa.int64()), pa.array([t for _, t in keys], pa.string()), pa.array([rows[k] for k in keys], pa.int64()), pa.array([support[k] for k in keys], pa.int64())], names=["entity", "term", "n_ct", "support"])

    for batch in batches:
        for text, n, entities in zip(*(batch.column(k).to_pylist() for k in range(3))):
            terms = list(places(text))
            for e in entities:
                for t in terms:
                    rows[e, t] += n
                    support[e, t] += 1
                if len(support) > FLUSH:
                    yield give()
                    rows.clear()
                    support.clear()
    if support:
        yield give()


def pair_finder(bits: bytes):
    """Where terms stand (tkey, rows, entity, term, start, end) whose pair's hash is in the filter."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits, np.uint8)).tobytes()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            for tkey, text, n, entities in zip(*(batch.column(k).to_pylist() for k in range(4))):
                out = [(tkey, n, e, t, a, b) for t, spots in places(text).items() for e in entities if wanted[zlib.crc32(f"{e}:{t}".encode()) % FILTER_BITS] for a, b in spots]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=["tkey", "rows", "entity", "term", "start", "end"])

    return find


def filter_of(table: DataFrame, key) -> bytes:
    marked = np.zeros(FILTER_BITS, np.uint8)
    marked[[r[0] for r in table.select((F.crc32(key.cast("binary")) % FILTER_BITS).alias("h")).distinct().collect()]] = 1  # 2**20 numbers at most
    return np.packbits(marked).tobytes()


def term_counter(bits: bytes):
    """Rows in which each term occurs, for terms whose hash is in the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = np.unpackbits(np.frombuffer(bits, np.uint8)).tobytes(), Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(w for w in {w.lower() for w in set(TERM.findall(text))} if wanted[zlib.crc32(w.encode()) % FILTER_BITS])
                if len(counts) > FLUSH:
                    yield give()
                    counts.clear()
        if counts:
            yield give()

    return count


def find_pii(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = 3, generalise_at: float = 0.7, remove_at: float = 0.95) -> DataFrame:
    """One row per row of ``df``: id, tkey, spans (base, by kind and start), terms (start, end, remove)."""
    text = text_or_empty(text_col)
    raw = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    rows = materialise(spark, raw.mapInArrow(scan, SCAN_DDL), "pii-scan")
    n_rows = rows.count()

    # Only entities with min_support texts can have terms with that support.
    held = rows.select("tkey", F.explode("entities").alias("entity"))  # each once a row
    held = materialise(spark, held.groupBy("entity", "tkey").agg(F.count(F.lit(1)).alias("rows")), "pii-held")
    entities = held.groupBy("entity").agg(F.sum("rows").alias("n_c"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= min_support)
    entities = materialise(spark, entities, "pii-entities")
    kept = lookup(held, entities, "entity", "texts", held.count()).filter("n_c IS NOT NULL")
    kept = materialise(spark, kept.groupBy("tkey").agg(F.first("rows").alias("rows"), F.collect_list("entity").alias("entities")), "pii-kept")
    own = may_hold(raw.select("tkey", "text"), "tkey", kept.select("tkey")).groupBy("tkey").agg(F.first("text").alias("text"))
    own = materialise(spark, own.join(kept, "tkey").select("tkey", "text", "rows", "entities"), "pii-texts")

    pairs = own.select("text", "rows", "entities").mapInArrow(pair_counter, "entity bigint, term string, n_ct bigint, support bigint")
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n_ct").alias("n_ct"), F.sum("support").alias("support"))
    pairs = materialise(spark, pairs.filter(F.col("support") >= min_support), "pii-pairs")
    df_t = raw.select("text").mapInArrow(term_counter(filter_of(pairs, F.col("term"))), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_t"))
    # A common term stands beside very many entities, and a common entity beside very many terms.
    n_pairs = pairs.count()
    df_t = materialise(spark, df_t.join(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n_entities")), "term"), "pii-term-rows")
    of_entity = materialise(spark, entities.select("entity", "n_c").join(pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("n_terms")), "entity"), "pii-entity-rows")
    known = lookup(lookup(pairs, df_t, "term", "n_entities", n_pairs), of_entity, "entity", "n_terms", n_pairs)
    pmi = F.log(F.lit(float(n_rows)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    ic = F.log(F.lit(float(n_rows)) / F.col("n_c"))
    known = known.withColumn("disclosure", F.when(ic > 0, pmi / ic).otherwise(0.0)).filter(F.col("disclosure") >= generalise_at)
    known = materialise(spark, known.select("entity", "term", (F.col("disclosure") >= remove_at).alias("remove")), "pii-terms")
    discard(spark, held, entities, pairs, df_t, of_entity)

    bits = filter_of(known, F.concat_ws(":", F.col("entity").cast("string"), "term"))
    spots = own.mapInArrow(pair_finder(bits), "tkey bigint, rows bigint, entity bigint, term string, start int, end int")
    spots = materialise(spark, spots.withColumn("pair", F.xxhash64("entity", "term")), "pii-spots")
    weights = spots.groupBy("pair", "entity", "term").agg(F.count(F.lit(1)).alias("n"))
    known = known.join(weights, ["entity", "term"]).select("pair", F.col("entity").alias("e"), F.col("term").alias("t"), "n", "remove")
    told = lookup(spots, known, "pair", "n", spots.count()).filter((F.col("entity") == F.col("e")) & (F.col("term") == F.col("t")))
    terms = told.groupBy("tkey", "rows", "start", "end").agg(F.max("remove").alias("remove"))
    terms = terms.groupBy("tkey", "rows").agg(F.array_sort(F.collect_list(F.struct("start", "end", "remove"))).alias("terms"))
    both = lookup(rows.drop("entities"), materialise(spark, terms, "pii-told"), "tkey", "rows", n_rows)
    discard(spark, own, spots)
    empty = F.array().cast("array<struct<start:int,end:int,remove:boolean>>")
    return both.select("id", "tkey", "spans", F.coalesce("terms", empty).alias("terms"))


def redacted(text: str | None, spans: list, terms: list) -> str | None:
    """``text`` with each base span named by its kind and each term generalised or removed.

    Of spans of two kinds that overlap, all that they cover gives way to the first's kind.
    """
    cuts = sorted([(s["start"], s["end"], f"[{KINDS[s['rank']].upper()}]") for s in spans] + [(t["start"], t["end"], "" if t["remove"] else "[TERM]") for t in terms])
    out, at = [], 0
    for start, end, name in cuts:
        if start >= at:
            out += [text[at:start], name]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``df`` with sanitised texts and all its columns; a null text stays null."""
    found = find_pii(spark, df, id_col, text_col, **limits).filter((F.size("spans") > 0) | (F.size("terms") > 0))
    found = found.select(F.col("id").alias("_sd_id"), F.col("tkey").alias("_sd_tkey"), F.struct("spans", "terms").alias("_sd_found"))
    found = found.dropDuplicates(["_sd_id", "_sd_tkey"])

    @F.pandas_udf("string")
    def redact(text, found):
        import pandas as pd

        return pd.Series([redacted(t, f["spans"], f["terms"]) for t, f in zip(text, found.to_dict("records"))])

    here = df.withColumn("_sd_own", F.xxhash64(text_or_empty(text_col)))
    both = here.join(found, F.col(id_col).cast("bigint").eqNullSafe(F.col("_sd_id")) & (F.col("_sd_own") == F.col("_sd_tkey")), "left")
    changed = both.filter("_sd_found IS NOT NULL").withColumn(text_col, redact(text_col, "_sd_found"))
    return changed.unionByName(both.filter("_sd_found IS NULL")).select(df.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = find_pii(spark, read_table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", F.concat(base, terms)).alias("spans"), F.size("terms").cast("long").alias("n_terms"))
