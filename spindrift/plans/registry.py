"""Where queries and their SQL are registered, and the SQL views that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FRAMES = """frames AS (
  SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
         CASE event_type WHEN 'view' THEN 'NOISE' WHEN 'click' THEN 'UP' WHEN 'purchase' THEN 'DOWN' WHEN 'signup' THEN 'ECHO' WHEN 'error' THEN 'BURST' ELSE 'NOISE' END AS label, value
  FROM events)"""
RUNS = FRAMES + """,
steps AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER w THEN 0 ELSE 1 END AS new FROM frames WINDOW w AS (PARTITION BY recording ORDER BY frame)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY frame) AS run FROM steps),
runs AS (SELECT recording, run, min(label) AS label, min(frame) AS start, max(frame) + 1 AS stop, count(*) AS n FROM numbered GROUP BY recording, run)"""
REGIONS = FRAMES + """,
signal AS (SELECT *, frame - row_number() OVER (PARTITION BY recording ORDER BY frame) AS island FROM frames WHERE label <> 'NOISE'),
regions AS (SELECT recording, min(frame) AS start, max(frame) + 1 AS stop FROM signal GROUP BY recording, island HAVING count(*) >= 10)"""
HITS = """hits AS (
  SELECT l_suppkey AS submodel, l_extendedprice AS llr, l_quantity / 50 AS confidence,
         CASE l_returnflag WHEN 'R' THEN 'WHISTLE' WHEN 'A' THEN 'BURST' ELSE 'NOISE' END AS classification,
         l_orderkey AS recording, l_partkey AS hit, l_linenumber AS line, l_quantity AS n_frames FROM lineitem)"""
VECS = """vecs AS MATERIALIZED (SELECT vec_id, label AS recording, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding::DOUBLE[] AS v FROM embeddings)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
