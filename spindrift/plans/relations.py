"""Queries over hit tables, logs, texts, edits, samples and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import scalars
from spindrift.operators import browse, clusters, evaluation as ev, features as ft, frames as fr, hits as ht, sampling as sp
from spindrift.plans.catalog import MARKS, all_vectors, marks, shotlog
from spindrift.plans.registry import FRAMES, HITS, REGIONS, RUNS, VECS, query
from spindrift.sources import files, tables as tb

# Hits


@query(f"""WITH {REGIONS}, n AS (SELECT recording, count(*) AS n_frames FROM frames GROUP BY recording), sig AS (SELECT recording, island, count(*) AS len FROM signal GROUP BY ALL),
s AS (SELECT recording, count(*) AS n_found, count(*) FILTER (len >= 10) AS n_used, count(*) FILTER (len >= 15) AS n_medoids FROM sig GROUP BY recording)
SELECT recording, n_frames, coalesce(n_found, 0) AS n_found, coalesce(n_used, 0) AS n_used, coalesce(n_medoids, 0) AS n_medoids FROM n LEFT JOIN s USING (recording)""")
def candidate_stats(spark, d):
    """Regions of any length, those long enough to be candidates, and those among the medoids (here: long ones)."""
    f = tb.frames(spark, d)
    found = fr.regions(f, 1).withColumn("n", F.col("stop") - F.col("start"))
    sources = found.select("recording", "start", F.when(F.col("n") >= 10, F.struct("recording", "start")).alias("candidate"))
    medoids = found.filter("n >= 15").select(F.struct("recording", "start").alias("candidate"))
    sizes = f.groupBy("recording").agg(F.count(F.lit(1)).alias("n_frames"))
    return ht.candidate_stats(sizes, sources, medoids)


@query(f"WITH {HITS}, h AS (SELECT submodel, classification, llr / 1000 AS llr FROM hits) SELECT classification, count(*) AS n, CASE classification WHEN 'WHISTLE' THEN 30.0::DOUBLE WHEN 'BURST' THEN 10.0 ELSE 15.0 END AS threshold, count(*) FILTER (llr >= CASE classification WHEN 'WHISTLE' THEN 30 WHEN 'BURST' THEN 10 ELSE 15 END) AS n_pass, round(count(*) FILTER (llr >= CASE classification WHEN 'WHISTLE' THEN 30 WHEN 'BURST' THEN 10 ELSE 15 END) / count(*), 6) AS frac_pass FROM h GROUP BY classification")
def class_threshold_filter(spark, d):
    h = tb.hits(spark, d).withColumn("llr", F.col("llr") / 1000)
    return ht.pass_rates(h, ht.CLASS_LLR).withColumn("frac_pass", F.round("frac_pass", 6))


@query(f"WITH {HITS}, h AS (SELECT classification, llr / 10000 AS llr FROM hits) SELECT count(*) AS n FROM h WHERE llr >= CASE classification WHEN 'WHISTLE' THEN 3 ELSE 5 END")
def default_threshold_filter(spark, d):
    """Classes without a limit of their own take the default."""
    h = tb.hits(spark, d).withColumn("llr", F.col("llr") / 10000)
    return ht.threshold_filter(h, {"WHISTLE": 3.0}, default=5.0).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {HITS}, k AS (SELECT * FROM hits WHERE confidence > 0.5), c AS (SELECT submodel, classification, count(*) AS n FROM k GROUP BY ALL)
SELECT submodel, count(*) AS n, round(avg(llr), 2) AS mean_llr, round(avg(n_frames), 4) AS mean_frames, count(DISTINCT recording) AS n_recordings, (SELECT string_agg(classification || '=' || n, ',' ORDER BY n DESC, classification) FROM c WHERE c.submodel = k.submodel) AS classes FROM k GROUP BY submodel""")
def motif_summary(spark, d):
    return ht.motif_summary(tb.hits(spark, d).filter("confidence > 0.5")).select("submodel", "n", F.round("mean_llr", 2).alias("mean_llr"), F.round("mean_frames", 4).alias("mean_frames"), "n_recordings", F.expr("array_join(transform(classes, c -> concat(c.classification, '=', c.n)), ',')").alias("classes"))


@query(f"WITH {HITS}, a AS (SELECT o_orderkey AS recording, o_orderpriority AS path FROM orders WHERE o_orderkey % 5 <> 0), h AS (SELECT recording, count(*) AS n FROM hits GROUP BY recording) SELECT recording, n, path, path IS NULL AS missing FROM h LEFT JOIN a USING (recording)")
def hits_per_recording(spark, d):
    paths = tb.read(spark, d, "orders").filter(F.col("o_orderkey") % 5 != 0).select(F.col("o_orderkey").alias("recording"), F.col("o_orderpriority").alias("path"))
    return ht.per_recording(tb.hits(spark, d), paths)


@query(f"WITH {HITS}, e AS (SELECT min(llr) AS lo, max(llr) AS hi FROM hits) SELECT classification, least(59, floor((llr - lo) * 60 / (hi - lo)))::BIGINT AS bin, count(*) AS n FROM hits, e GROUP BY ALL")
def score_histogram(spark, d):
    """Sixty bins over all scores, the same for every class."""
    return ht.histogram(tb.hits(spark, d), "llr", 60)


@query(f"WITH {HITS} SELECT classification, round(min(llr), 2) AS low, round(quantile_cont(llr, 0.25), 2) AS q1, round(quantile_cont(llr, 0.5), 2) AS median, round(quantile_cont(llr, 0.75), 2) AS q3, round(max(llr), 2) AS high FROM hits GROUP BY classification")
def score_quartiles(spark, d):
    return ht.quartiles(tb.hits(spark, d), "llr").select("classification", *[F.round(c, 2).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query(f"WITH {HITS}, {MARKS}, s AS (SELECT * FROM (VALUES ('WHISTLE', true, 20000.0, 0.5), ('BURST', true, 40000.0, 0.1), ('NOISE', false, 0.0, 0.0)) t(classification, enabled, min_llr, min_conf)) SELECT submodel, count(*) AS n FROM hits JOIN s USING (classification) WHERE enabled AND llr >= min_llr AND confidence >= min_conf AND recording NOT IN (SELECT recording FROM marks) GROUP BY submodel")
def shown_hits(spark, d):
    settings = spark.createDataFrame([("WHISTLE", True, 20000.0, 0.5), ("BURST", True, 40000.0, 0.1), ("NOISE", False, 0.0, 0.0)], "classification string, enabled boolean, min_llr double, min_conf double")
    return browse.shown_hits(tb.hits(spark, d), settings, marks(spark, d), "recording").groupBy("submodel").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('WHISTLE', true, 25.0::DOUBLE), ('BURST', false, 5.0), ('ECHO', true, 10.0)) t(classification, enabled, min_llr)")
def settings_upsert(spark, d):
    ddl = "classification string, enabled boolean, min_llr double"
    table = spark.createDataFrame([("WHISTLE", True, 30.0), ("BURST", True, 10.0)], ddl)
    changes = spark.createDataFrame([("WHISTLE", False, 1.0, 1), ("WHISTLE", True, 25.0, 2), ("BURST", False, 5.0, 3), ("ECHO", True, 10.0, 4)], ddl + ", seq int")
    return browse.upsert_settings(table, changes)


@query(f"""WITH {HITS}, c AS (SELECT submodel, classification, count(*) AS n FROM hits GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY submodel ORDER BY n DESC, classification) AS k FROM c)
SELECT h.submodel, count(*) AS n, round(avg(llr), 2) AS mean_llr, round(stddev_pop(llr), 2) AS sd_llr, any_value(m.classification) AS majority, any_value(m.n) AS n_majority FROM hits h JOIN m ON m.submodel = h.submodel AND k = 1 GROUP BY h.submodel""")
def type_summary(spark, d):
    return browse.type_summary(tb.hits(spark, d)).withColumn("mean_llr", F.round("mean_llr", 2)).withColumn("sd_llr", F.round("sd_llr", 2))


@query(f"WITH {VECS}, pairs AS (SELECT a.recording AS gi, b.recording AS gj, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS d FROM vecs a, vecs b WHERE a.recording < b.recording) SELECT gi AS model_i, gj AS model_j, round(min(d), 4) AS single FROM pairs GROUP BY gi, gj")
def half_matrix(spark, d):
    return browse.half_matrix(clusters.whole_linkages(all_vectors(spark, d))).select("model_i", "model_j", F.round("single", 4).alias("single"))


@query("WITH RECURSIVE m AS (SELECT s_suppkey AS child, s_suppkey // 2 AS parent FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey > 1), n AS (SELECT child AS model FROM m UNION SELECT parent FROM m), up AS (SELECT model, model AS root FROM n UNION ALL SELECT model, parent FROM up JOIN m ON m.child = root) SELECT model, root FROM up WHERE root NOT IN (SELECT child FROM m)")
def merged_groups(spark, d):
    s = tb.read(spark, d, "supplier").filter("s_suppkey % 3 <> 0 AND s_suppkey > 1").select(F.col("s_suppkey").alias("child"), F.expr("s_suppkey div 2").alias("parent"))
    return browse.group_roots(spark, s)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS results_id FROM orders")
def running_ids(spark, d):
    return browse.numbered(tb.read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_orderkey", "results_id")


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS g, o_orderkey AS k, o_totalprice AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
p AS (SELECT g, k, size, rn, 0 AS part, 0.0::DOUBLE AS pos FROM o WHERE rn = 1
UNION ALL SELECT o.g, o.k, o.size, o.rn, CASE WHEN p.pos + p.size > 0 AND p.pos + p.size + o.size > 500000 THEN p.part + 1 ELSE p.part END, CASE WHEN p.pos + p.size > 0 AND p.pos + p.size + o.size > 500000 THEN 0.0 ELSE p.pos + p.size END FROM p JOIN o ON o.g = p.g AND o.rn = p.rn + 1)
SELECT g AS o_custkey, k AS o_orderkey, part, round(pos, 2) AS "offset" FROM p""")
def audio_parts(spark, d):
    o = tb.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return browse.audio_parts(o, "o_custkey", ["o_orderkey"], "o_totalprice", 500_000).select("o_custkey", "o_orderkey", "part", F.round("offset", 2).alias("offset"))


@query(f"WITH {HITS}, t AS (SELECT llr / 1000 AS t0, llr / 1000 + n_frames / 10 AS t1 FROM hits) SELECT count(*) AS n, round(min(greatest(0, t0 - 0.5)), 4) AS low, round(max(least(100.0, t1 + 0.5)), 4) AS high, round(min(t0 - greatest(0, t0 - 0.5)), 4) AS least_offset, round(max(t0 - greatest(0, t0 - 0.5)), 4) AS most_offset FROM t")
def context_regions(spark, d):
    t0 = F.col("llr") / 1000
    a, b, c = scalars.context_region(t0, t0 + F.col("n_frames") / 10, F.lit(100.0))
    r = tb.hits(spark, d).select(a.alias("a"), b.alias("b"), c.alias("c"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("a"), 4).alias("low"), F.round(F.max("b"), 4).alias("high"), F.round(F.min("c"), 4).alias("least_offset"), F.round(F.max("c"), 4).alias("most_offset"))


# Logs and texts

LOG = """log AS (SELECT o_custkey AS encounter, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS date, 'WHISTLE' AS ac,
  CASE (o_orderkey // 1499) % 6 WHEN 0 THEN 'SWIM' WHEN 1 THEN 'no/term2' WHEN 2 THEN '7' WHEN 3 THEN 'FISH, DIVE AND' WHEN 4 THEN NULL ELSE '4.0' END AS behaviour,
  format('{:02d}:{:02d}:{:02d}-12', (o_orderkey // 60) % 2, o_orderkey % 3, (o_orderkey * 7) % 60) AS timecode, (o_orderkey % 40)::VARCHAR AS comment FROM orders)"""


def log(spark, d):
    k = F.col("o_orderkey")
    text = F.element_at(F.array(F.lit("SWIM"), F.lit("no/term2"), F.lit("7"), F.lit("FISH, DIVE AND"), F.lit(None), F.lit("4.0")), (F.expr("o_orderkey div 1499") % 6 + 1).cast("int"))
    code = F.format_string("%02d:%02d:%02d-12", F.expr("o_orderkey div 60") % 2, k % 3, (k * 7) % 60)
    o = tb.read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("encounter"), k.alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("WHISTLE").alias("ac"), text.alias("behaviour"), code.alias("timecode"), (k % 40).cast("string").alias("comment"))


@query(f"""WITH {HITS}, {LOG}, h AS (SELECT recording % 700 AS encounter, submodel, classification, hit, line, llr / 100 AS t FROM hits), dates AS (SELECT encounter, arg_min(date, seq) AS date FROM log GROUP BY encounter),
u AS (SELECT encounter, date, classification AS ac, submodel::VARCHAR AS behaviour, format('0{{}}:{{:02d}}:{{:02d}}', floor(t)::BIGINT // 3600, floor(t)::BIGINT % 3600 // 60, floor(t)::BIGINT % 60) AS timecode FROM h JOIN dates USING (encounter)
UNION ALL SELECT encounter, date, ac, behaviour, split_part(timecode, '-', 1) FROM log WHERE encounter IN (SELECT encounter FROM h))
SELECT encounter, date, ac, behaviour, timecode, count(*) AS n FROM u GROUP BY ALL""")
def annotate_union(spark, d):
    h = tb.hits(spark, d).select((F.col("recording") % 700).alias("encounter"), "submodel", "classification", "hit", F.lit(0.0).alias("mean_llr"), (F.col("llr") / 100).alias("start_time_s"), (F.col("llr") / 100 + 1).alias("stop_time_s"))
    return ft.annotate(h, log(spark, d)).groupBy("encounter", "date", "ac", "behaviour", "timecode").agg(F.count(F.lit(1)).alias("n"))


CLEAN = r"regexp_replace({0}, '^[\x09-\x0D\x1C-\x20]+|[\x09-\x0D\x1C-\x20]+$', '', 'g')"


def clean_sql(x: str) -> str:
    x = CLEAN.format(f"regexp_replace({x}, '[0-9?!_]+', '', 'g')")
    x = CLEAN.format(rf"regexp_replace(regexp_replace({x}, '[/,]', 'AND', 'g'), 'AND[\x09-\x0D\x1C-\x20]*$', '')")
    return f"replace(replace({x}, 'AND  ', ''), '  ', '')"


@query(f"SELECT doc_id, md5({clean_sql('text')}) AS clean FROM documents")
def clean_text(spark, d):
    return tb.read(spark, d, "documents").select("doc_id", F.md5(scalars.clean_line(F.col("text")).cast("binary")).alias("clean"))


WORDS = "upper(replace(text, 'e', ' ')) AS text"


@query("WITH t AS (SELECT doc_id, upper(text) AS text FROM documents) SELECT doc_id, " + ", ".join(f"contains(text, '{t}') AS is_{t.lower().replace(' ', '_')}" for t in sorted(ft.CONTEXTS)) + ", " + ", ".join(f"contains(text, '{t}') AS has_{t.lower().replace(' ', '_')}" for t in sorted(ft.ACTORS)) + " FROM t WHERE text IS NOT NULL")
def keyword_flags(spark, d):
    t = tb.read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.upper("text").alias("text"))
    return ft.flags(t, "text").drop("text")


CLEANED = LOG + f""", kept AS (SELECT *, try_cast(behaviour AS DOUBLE) IS NOT NULL AS hit FROM log), f AS (SELECT * FROM kept WHERE NOT (hit AND try_cast(comment AS DOUBLE) < 30)),
cl AS (SELECT *, regexp_full_match(coalesce(behaviour, ''), '[+-]?[0-9]+') OR behaviour IS NULL AS is_motif FROM f),
cleaned AS (SELECT encounter, seq, timecode, is_motif, CASE WHEN is_motif THEN behaviour ELSE {clean_sql('behaviour')} END AS behaviour FROM cl),
texts AS (SELECT *, NOT is_motif AND behaviour <> 'AND' AND behaviour <> '' AS is_text FROM cleaned)"""


@query(f"WITH {CLEANED} SELECT encounter, seq, behaviour, is_motif, is_text FROM texts")
def cleaned_log(spark, d):
    return ft.clean(log(spark, d)).select("encounter", "seq", "behaviour", "is_motif", "is_text")


@query(f"""WITH {CLEANED}, tcs AS (SELECT *, split_part(split_part(timecode, '-', 1), ':', 1)::INT * 3600 + split_part(split_part(timecode, '-', 1), ':', 2)::INT * 60 + split_part(split_part(timecode, '-', 1), ':', 3)::INT AS tc,
  (contains(behaviour, 'SWIM') OR contains(behaviour, 'FISH') OR contains(behaviour, 'DIVE')) AS flagged FROM texts), nn AS (SELECT *, row_number() OVER (PARTITION BY encounter ORDER BY tc, seq) AS rn FROM tcs)
SELECT a.encounter, a.seq, count(*) AS n_context, string_agg(DISTINCT try_cast(c.behaviour AS DOUBLE)::INT::VARCHAR, ',' ORDER BY try_cast(c.behaviour AS DOUBLE)::INT::VARCHAR) AS heard FROM nn a JOIN nn c ON a.encounter = c.encounter AND c.rn < a.rn AND c.tc >= a.tc - 3000 AND NOT c.is_text WHERE a.is_text AND a.flagged GROUP BY a.encounter, a.seq""")
def context_window_onehot(spark, d):
    out = ft.context_features(ft.clean(log(spark, d)), seconds=3000, actors=[])
    heard = F.nullif(F.array_join(F.array_sort(F.transform("heard", lambda x: x.cast("string"))), ","), F.lit(""))
    return out.select("encounter", "seq", F.col("n_context").cast("long").alias("n_context"), heard.alias("heard"))


@query("""WITH n AS (SELECT o_custkey AS encounter, epoch(o_orderdate)::BIGINT AS s, o_orderkey AS id, o_orderpriority AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT a.id, count(*) AS n_context, count(DISTINCT c.text) AS n_texts, max(CASE WHEN c.text = '1-URGENT' THEN 1 ELSE 0 END) AS has_urgent FROM n a JOIN n c ON a.encounter = c.encounter AND c.rn < a.rn AND c.s >= a.s - 2592000 GROUP BY a.id""")
def context_pairs(spark, d):
    s = shotlog(spark, d).withColumn("s", F.unix_timestamp("tc"))
    p = ht.context_pairs(s, "encounter", ["s", "id"], "s", 30 * 86400)
    return p.groupBy(F.col("a.id").alias("id")).agg(F.count(F.lit(1)).alias("n_context"), F.countDistinct("c.text").alias("n_texts"), F.max(F.when(F.col("c.text") == "1-URGENT", 1).otherwise(0)).alias("has_urgent"))


@query("""WITH f AS (SELECT source || '.' || lang AS name, doc_id % 7 AS folder_rank, doc_id % 3 = 0 AS has_log, doc_id FROM documents), s AS (SELECT *, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem FROM f)
SELECT stem, name, folder_rank, has_log FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY has_log DESC, folder_rank, name) AS k FROM s) WHERE k = 1""")
def dedupe_by_stem(spark, d):
    f = tb.read(spark, d, "documents").select(F.concat_ws(".", "source", "lang").alias("name"), (F.col("doc_id") % 7).alias("folder_rank"), (F.col("doc_id") % 3 == 0).alias("has_log"))
    return files.one_per_stem(f).select("stem", "name", "folder_rank", "has_log")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey END AS encounter, CASE WHEN p_partkey % 3 = 0 THEN 1000000 + p_partkey END AS code, CASE WHEN p_partkey % 3 = 0 THEN 2000 + (p_partkey // 100) % 100 END AS year, CASE WHEN p_size < 5 THEN 0 ELSE least(p_size, 10) END::DOUBLE AS clamped, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS number FROM part")
def code_columns(spark, d):
    """Encounters of folder names, codes and years of stems, clamped thresholds and integers of texts."""
    k = F.col("p_partkey")
    folder = F.when(k % 4 == 0, F.concat(F.lit("Ex"), k)).otherwise(F.concat(F.lit("E"), k, F.lit("_any")))
    stem = F.when(k % 3 == 0, F.concat(F.lit("0"), (1000000 + k).cast("string"), F.lit("_NAME"))).otherwise(F.concat(k, F.lit("x")))
    text = F.when(k % 2 == 0, F.concat(F.lit(" "), k)).otherwise(F.concat(k, F.lit(".0")))
    code, year = scalars.encounter_year(stem)
    return tb.read(spark, d, "part").select("p_partkey", scalars.encounter_of(folder).alias("encounter"), code.cast("bigint").alias("code"), year.cast("bigint").alias("year"), scalars.clamp_threshold(F.col("p_size")).cast("double").alias("clamped"), scalars.as_integer(text).alias("number"))


# Samples and splits


@query("""WITH n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS total FROM documents)
SELECT lang, doc_id, 300 // total + CASE WHEN k <= 300 % total THEN 1 ELSE 0 END AS times FROM n WHERE 300 // total + CASE WHEN k <= 300 % total THEN 1 ELSE 0 END > 0""")
def oversample_balanced(spark, d):
    """Three hundred rows of each language, in the order of their numbers."""
    docs = tb.read(spark, d, "documents").select("lang", "doc_id")
    return sp.balanced(docs, "lang", "doc_id", 300, order=F.col("doc_id").cast("double")).groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("times"))


@query("""WITH b AS (SELECT doc_id, source || ':' || (doc_id // 50) AS block FROM documents), n AS (SELECT count(DISTINCT block) AS n FROM b)
SELECT round(n * 0.15)::BIGINT AS val_blocks, n - round(n * 0.15)::BIGINT AS train_blocks, (SELECT count(*) FROM b) AS n_rows, 0::BIGINT AS on_both FROM n""")
def block_split(spark, d):
    b = tb.read(spark, d, "documents").select("doc_id", sp.block_key(F.col("source"), F.col("doc_id"), 50).alias("block"))
    s = sp.block_split(b, "block")
    per = s.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("sides"), F.first("split").alias("split"))
    return per.agg(F.count_if(F.col("split") == "val").alias("val_blocks"), F.count_if(F.col("split") == "train").alias("train_blocks"), F.sum("n").alias("n_rows"), F.count_if(F.col("sides") > 1).alias("on_both"))


@query("SELECT count(*) AS n, 0::BIGINT AS wrong, 0::BIGINT AS missing FROM documents WHERE lang IS NOT NULL")
def triplet_check(spark, d):
    """Triplets of all rows, and how many break their rules."""
    docs = tb.read(spark, d, "documents").filter("lang IS NOT NULL").select("lang", "doc_id")
    t = sp.triplets(docs, "lang", "doc_id")
    lang = lambda c, n: docs.select(F.col("doc_id").alias(c), F.col("lang").alias(n))
    j = t.join(lang("positive", "pos_lang"), "positive").join(lang("negative", "neg_lang"), "negative")
    bad = (F.col("pos_lang") != F.col("lang")) | (F.col("neg_lang") == F.col("lang")) | (F.col("neg_lang") != F.col("negative_label")) | (F.col("positive") == F.col("doc_id"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("wrong"), F.count_if(F.col("negative").isNull()).alias("missing"))


@query()
def spread_sample(spark, d):
    """Sixty-four vectors drawn apart, and how many of each label."""
    v = tb.vec_frames(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    chosen = sp.spread_sample(v, 64, 16)
    return tb.read(spark, d, "embeddings").filter(F.col("vec_id").isin(chosen)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FRAMES}, s AS (SELECT DISTINCT recording, frame FROM frames WHERE label = 'BURST'), t AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY recording ORDER BY frame)),
u AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY frame) AS run FROM t) SELECT recording, min(frame) AS start, max(frame) + 2 AS stop, count(*) AS n_vectors FROM u GROUP BY recording, run""")
def window_spans(spark, d):
    return sp.window_spans(tb.frames(spark, d).filter("label = 'BURST'"), 2)


@query(f"""WITH {FRAMES}, r AS (SELECT recording, count(*) AS n FROM frames GROUP BY recording HAVING count(*) >= 60), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY recording ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
h AS (SELECT *, sum(CASE WHEN before < 800 THEN n ELSE 0 END) OVER () AS held FROM b) SELECT recording, CASE WHEN before < 800 THEN 'heldout' ELSE 'train' END AS split FROM h WHERE before < 800 OR before - held < 2000""")
def budget_split(spark, d):
    r = tb.frames(spark, d).groupBy("recording").agg(F.count(F.lit(1)).alias("n"))
    return sp.budget_split(r, "recording", "n", 800, 2000, 60, order=F.col("recording"))


@query(f"WITH {REGIONS} SELECT recording, start, w.s AS \"window\" FROM regions, unnest(range(start, stop - 4 + 1, 4)) AS w(s) WHERE stop - start >= 4")
def region_windows(spark, d):
    from spindrift.operators import frames as fr

    return sp.region_windows(fr.regions(tb.frames(spark, d)), 4).select("recording", "start", "window")


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.vec_id, a.x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id - a.vec_id % 10), r AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) + 1e-8 AS rx, sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(y)) + 1e-8 AS ry FROM p) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] + 0.5 * rx / ry * z[2]) ** 2))), 5) AS norm FROM r")
def background_mix(spark, d):
    """Vectors with the first one of their block of ten at half their loudness."""
    e = tb.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    b = e.select((F.col("vec_id")).alias("of"), F.col("x").alias("y"))
    mixed = e.join(b, F.col("vec_id") - F.col("vec_id") % 10 == F.col("of")).select("vec_id", sp.with_background(F.col("x"), F.col("y"), F.lit(0.5)).alias("m"))
    return mixed.select("vec_id", F.round(F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, v: a + v * v)), 5).alias("norm"))


@query("SELECT 'b' AS origin, doc_id AS candidate_index FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id FROM documents) UNION ALL SELECT 'm', (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY page_id) - 1 FROM pages")
def pool_union(spark, d):
    """Pages as candidates that go on after the documents'."""
    docs = browse.numbered(tb.read(spark, d, "documents").select("doc_id"), "doc_id", start=0, name="candidate_index").select(F.lit("b").alias("origin"), F.lit(0).cast("bigint").alias("page_id"), "candidate_index")
    pages = tb.read(spark, d, "pages").select(F.lit("m").alias("origin"), "page_id")
    return browse.pool_union(docs, pages, ["page_id"]).select("origin", "candidate_index")


@query(f"""WITH {RUNS}, c AS (SELECT recording, count(*) - 1 AS change FROM runs GROUP BY recording),
o AS (SELECT *, row_number() OVER (ORDER BY change DESC, recording) AS k FROM c), r AS (SELECT *, row_number() OVER (ORDER BY md5(recording::VARCHAR), recording) AS j FROM o WHERE k > 4)
SELECT recording, change, 'most changed' AS picked FROM o WHERE k <= 4 UNION ALL SELECT recording, change, 'random' FROM r WHERE j <= 2""")
def picked_examples(spark, d):
    """Recordings whose label changes most often, and others."""
    changes = fr.runs(tb.frames(spark, d)).groupBy("recording").agg((F.count(F.lit(1)) - 1).alias("change"))
    return ev.picked_examples(changes, "recording", "change", order=F.md5(F.col("recording").cast("string")))


# Reports


@query("""WITH c AS (SELECT unnest([0, 1]) AS cls) SELECT cls, count(*) FILTER (quality = cls) AS gold, count(*) FILTER (toxic = cls) AS guessed,
round(count(*) FILTER (quality = cls AND toxic = cls) / nullif(count(*) FILTER (toxic = cls), 0), 6) AS precision, round(count(*) FILTER (quality = cls AND toxic = cls) / nullif(count(*) FILTER (quality = cls), 0), 6) AS recall,
round(2 * count(*) FILTER (quality = cls AND toxic = cls) / (count(*) FILTER (toxic = cls) + count(*) FILTER (quality = cls)), 6) AS f1 FROM labels, c GROUP BY cls""")
def classification_report(spark, d):
    r = ht.balanced_accuracy(tb.read(spark, d, "labels"), "quality", "toxic")
    return r.select("cls", "gold", "guessed", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


SCORES = f"""WITH {FRAMES}, s AS (SELECT CASE label WHEN 'NOISE' THEN 0 WHEN 'UP' THEN 1 WHEN 'DOWN' THEN 2 WHEN 'ECHO' THEN 3 ELSE 4 END AS gold, [value % 7, value % 11, value % 13, value % 5, value % 3] AS s FROM frames),
p AS (SELECT gold, list_position(s, list_max(s)) - 1 AS a, list_position([-1.0, s[2], s[3], s[4], s[5]], list_max(s[2:5])) - 1 AS b FROM s), g AS (SELECT gold, count(*) AS n, count(*) FILTER (a = gold) AS ok, count(*) FILTER (b = gold) AS ok4, count(*) FILTER (a = 0) AS z FROM p GROUP BY gold)"""


@query(SCORES + " SELECT round(sum(ok) / sum(n), 6) AS accuracy, round(sum(ok4) / sum(n), 6) AS accuracy_masked, round(avg(ok4 / n), 6) AS balanced_accuracy, round(sum(z) / sum(n), 6) AS masked_rate FROM g")
def accuracy_report(spark, d):
    """Class scores made of the value's remainders, with NOISE masked or not."""
    f = tb.frames(spark, d)
    gold = F.array_position(F.array(*[F.lit(x) for x in tb.LABELS]), F.col("label")) - 1
    scored = f.select(gold.alias("gold"), F.array(*[F.col("value") % k for k in (7, 11, 13, 5, 3)]).alias("s"))
    return ev.accuracy(scored, "gold", "s", 0).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_masked", "balanced_accuracy", "masked_rate")])


@query("SELECT l_linestatus AS status, round(count(*) FILTER (l_returnflag = 'A') / count(*), 6) AS a, round(count(*) FILTER (l_returnflag = 'N') / count(*), 6) AS n, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS r FROM lineitem GROUP BY l_linestatus")
def crosstab(spark, d):
    c = ev.crosstab(tb.read(spark, d, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"], normalise=True)
    return c.select(F.col("l_linestatus").alias("status"), *[F.round(x, 6).alias(x.lower()) for x in "ANR"])


@query("SELECT l_returnflag AS flag, " + ", ".join(f"count(*) FILTER (least(l_linenumber, 4) = {k}) AS n{k}" for k in range(1, 5)) + " FROM lineitem GROUP BY l_returnflag")
def clipped_crosstab(spark, d):
    c = ev.crosstab(tb.read(spark, d, "lineitem"), "l_returnflag", "l_linenumber", [1, 2, 3, 4], most=4)
    return c.select(F.col("l_returnflag").alias("flag"), *[F.col(f"`{k}`").alias(f"n{k}") for k in range(1, 5)])


@query(f"""WITH {HITS}, r AS (SELECT classification AS run, avg(llr) AS llr, avg(n_frames) AS n_frames, 0.0::DOUBLE AS gap_ratio FROM hits GROUP BY classification), u AS (SELECT run, 'llr' AS metric, llr AS value FROM r UNION ALL SELECT run, 'n_frames', n_frames FROM r UNION ALL SELECT run, 'gap_ratio', gap_ratio FROM r),
l AS (SELECT u.run, u.metric, CASE WHEN b.value <> 0 THEN (u.value - b.value) / abs(b.value) * 100 WHEN u.value = 0 THEN 0 END AS lift FROM u JOIN u b ON b.metric = u.metric AND b.run = 'NOISE' WHERE u.run <> 'NOISE')
SELECT run, metric, round(lift, 4) AS lift, CASE WHEN abs(lift) < 1 THEN 'negligible' WHEN abs(lift) < 5 THEN 'small' WHEN abs(lift) < 15 THEN 'moderate' WHEN abs(lift) < 30 THEN 'substantial' ELSE 'significant' END AS magnitude FROM l""")
def run_comparison_lift(spark, d):
    r = tb.hits(spark, d).groupBy(F.col("classification").alias("run")).agg(F.avg("llr").alias("llr"), F.avg("n_frames").alias("n_frames"), F.lit(0.0).alias("gap_ratio"))
    out = ht.compare_runs(r, "run", "NOISE", ["llr", "n_frames", "gap_ratio"])
    return out.select("run", "metric", F.round("lift", 4).alias("lift"), "magnitude")


@query("""WITH r AS (SELECT l_suppkey % 5 AS run, l_partkey AS item, max(l_quantity) >= 30 AS before, min(l_quantity) >= 20 AS after FROM lineitem GROUP BY ALL), c AS (SELECT run, count(*) FILTER (after AND NOT before) AS gained, count(*) FILTER (before AND NOT after) AS lost FROM r GROUP BY run)
SELECT run, gained, lost FROM c""")
def paired_changes(spark, d):
    r = tb.read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("run"), F.col("l_partkey").alias("item")).agg((F.max("l_quantity") >= 30).alias("before"), (F.min("l_quantity") >= 20).alias("after"))
    return ev.paired_changes(r, "before", "after", "run").select("run", "gained", "lost")


@query("""WITH RECURSIVE h AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, o_totalprice AS loss FROM orders),
s AS (SELECT run, epoch, loss AS best, epoch AS best_at, 0 AS bad, epoch AS last FROM h WHERE epoch = 1
UNION ALL SELECT h.run, h.epoch, CASE WHEN s.bad < 4 AND h.loss < s.best - 0.0001 THEN h.loss ELSE s.best END, CASE WHEN s.bad < 4 AND h.loss < s.best - 0.0001 THEN h.epoch ELSE s.best_at END, CASE WHEN s.bad >= 4 THEN s.bad WHEN h.loss < s.best - 0.0001 THEN 0 ELSE s.bad + 1 END, CASE WHEN s.bad >= 4 THEN s.last ELSE h.epoch END FROM s JOIN h ON h.run = s.run AND h.epoch = s.epoch + 1)
SELECT run, arg_max(best_at, epoch) AS best_epoch, round(arg_max(best, epoch), 2) AS best_loss, arg_max(last, epoch) AS last_epoch FROM s GROUP BY run""")
def best_epoch(spark, d):
    from pyspark.sql import Window

    h = tb.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("epoch"), F.col("o_totalprice").alias("loss"))
    return ev.best_epoch(h, "run", "epoch", "loss").withColumn("best_loss", F.round("best_loss", 2))


@query("""WITH h AS (SELECT o_custkey AS run, o_orderkey // 1000 AS epoch, o_orderkey AS step, o_totalprice AS loss FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY run, epoch ORDER BY step) AS i, count(*) OVER (PARTITION BY run, epoch) AS n, row_number() OVER (PARTITION BY run ORDER BY epoch, step) AS j, count(*) OVER (PARTITION BY run) AS m, avg(loss) OVER (PARTITION BY run ORDER BY epoch, step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a FROM h)
SELECT run, step, round(i / n + epoch - 1, 6) AS x, round(CASE WHEN j >= least(5, m) THEN a END, 2) AS smoothed FROM w""")
def step_curve(spark, d):
    h = tb.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.expr("o_orderkey div 1000").alias("epoch"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"))
    return ev.step_curve(h, "run", "epoch", "step", "loss", 5).select("run", "step", F.round("x", 6).alias("x"), F.round("smoothed", 2).alias("smoothed"))


@query("WITH RECURSIVE f AS (SELECT p_partkey AS folder, CASE WHEN p_partkey > 1 THEN p_partkey // 3 + 1 END AS parent FROM part WHERE p_partkey <> 2), t AS (SELECT folder AS top, folder FROM f UNION ALL SELECT t.top, f.folder FROM t JOIN f ON f.parent = t.folder), s AS (SELECT p_partkey AS folder, p_size AS size FROM part) SELECT top AS folder, sum(size)::BIGINT AS size FROM t JOIN s USING (folder) GROUP BY top")
def folder_sizes(spark, d):
    p = tb.read(spark, d, "part")
    tree = p.filter("p_partkey <> 2").select(F.col("p_partkey").alias("folder"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 3 + 1")).alias("parent"))
    return files.folder_sizes(tree, p.select(F.col("p_partkey").alias("folder"), F.col("p_size").alias("size")))


@query(f"WITH {VECS}, s AS (SELECT recording, min(frame) AS a, max(frame) AS b FROM vecs WHERE frame >= 3 AND frame < 9 GROUP BY recording) SELECT recording AS exemplar, recording, a AS start FROM s")
def located_slices(spark, d):
    """Slices of six vectors found again by the content of their first and last one."""
    v = tb.vec_frames(spark, d).select("recording", "frame", F.col("embedding").alias("x"))
    some = v.filter("frame >= 3 AND frame < 9").groupBy(F.col("recording").alias("exemplar")).agg(F.array_sort(F.collect_list(F.struct("frame", "x"))).alias("s"))
    return ht.locate(some.select("exemplar", F.col("s.x").alias("xs")), v)
