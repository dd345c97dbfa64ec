"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Every text is matched with fixed patterns. The values found (and other opaque tokens,
which are only candidates) are hashed and counted over the whole corpus: by how many
distinct repositories (documents) and owners (sources) hold each. A value that many
owners share is a copied example; one that few hold looks live. Opaque tokens that look
live and touch no base span become spans of the kind ``owned``.

Cases: a null text counts as empty; empty texts have no spans; texts are matched whole;
a null source counts as one owner; repeated rows give equal results and count once; an
empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import lookup, materialise, read_table, text_or_empty

# The base kinds in their order, and their patterns.
KINDS = ["assign", "access", "hex"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of capitals and digits is taken whole, so 16 in all is a lower bound on it
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_-])"

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def located(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches with offsets in code points.

    What lies between the matches comes from ``split``; lengths of both, summed in turn,
    give the starts.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(SPAN)), F.array(span)).alias("out"))

    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Base spans and opaque candidates of each row; the text is not carried on."""
    d = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), text_or_empty(text_col).alias("text"))
    d = d.select(
        "id", "owner", F.xxhash64("text").alias("tkey"),
        located(F.col("text"), ASSIGN, "assign", 0).alias("assign"), located(F.col("text"), ACCESS, "access", 1).alias("access"),
        located(F.col("text"), HEX, "hex", 2).alias("hex"), located(F.col("text"), OPAQUE, "owned", 3).alias("opaque"),
    )
    secret = lambda s: F.regexp_extract(s["value"], ASSIGN, 1)
    d = d.withColumn("assign", F.filter("assign", lambda s: F.char_length(secret(s)) >= 8))
    d = d.withColumn("assign", F.transform("assign", lambda s: s.withField("value", secret(s))))
    d = d.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    varied = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= 12)
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    d = d.withColumn("opaque", F.filter("opaque", lambda s: varied(s) & apart(s)))
    hashed = lambda s: s.withField("value", F.sha2(s["value"], 256))  # noqa: E731  values themselves go no further
    return d.select(
        "id", "owner", "tkey", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"), F.transform("base", hashed).alias("base"), F.transform("opaque", hashed).alias("opaque"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: rows, distinct repositories and distinct owners.

    Two levels of counting, each combined before its shuffle, so a value in a third of
    all documents is one row a task.
    """
    by_pair = found.groupBy("value", "owner", "id").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_pair.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_repos"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_rows"), F.sum("n_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def find_secrets(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = 3, example_repos: int = 5) -> DataFrame:
    """Spans of each row, with n_live and n_example of its base spans.

    A value is an example if at least ``example_owners`` owners and ``example_repos``
    repositories hold it. Result: id, tkey, counts, base, spans (arrays in order).
    """
    rows = materialise(spark, scan(df, id_col, text_col, owner_col), "secret-scan")
    found = rows.filter((F.size("base") > 0) | (F.size("opaque") > 0)).select("id", "owner", "tkey", F.explode(F.concat("base", "opaque")).alias("span"))
    found = found.select("id", "owner", "tkey", "span", F.col("span.value").alias("value"))
    stats = materialise(spark, ownership(found), "secret-owners")
    n_found = stats.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    judged = lookup(found.select("id", "tkey", "span", "value"), stats, "value", "n_rows", n_found)
    example = (F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos)
    judged = judged.select("id", "tkey", "span", example.alias("example"))
    per_doc = judged.groupBy("id", "tkey").agg(F.collect_set(F.struct("span", "example")).alias("judged"))
    other = per_doc.select(F.col("id").alias("_id"), F.col("tkey").alias("_tkey"), "judged")
    both = rows.join(other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey")), "left")
    judged_list = F.coalesce("judged", F.array().cast("array<struct<span:struct<start:int,rank:int,end:int,kind:string,value:string>,example:boolean>>"))
    both = both.withColumn("judged", judged_list)
    owned = F.transform(F.filter("judged", lambda j: (j["span"]["rank"] == 3) & ~j["example"]), lambda j: j["span"])
    count = lambda example: F.size(F.filter("judged", lambda j: (j["span"]["rank"] < 3) & (j["example"] == F.lit(example)))).cast("long")
    return both.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", owned)).alias("spans"),
        count(False).alias("n_live"), count(True).alias("n_example"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark, read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_example")
