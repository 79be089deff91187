"""Queries over the registry snapshots and the vector listings, with the SQL that states the same."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.references import orphan_references, orphan_report
from quern.operators.snapshots import listing_changes, snapshot_changes
from quern.session import read_table

#: The snapshot at which the current listing of the vector store was taken (fixed by the data's description).
LISTING_SNAPSHOT = 5


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Both tables' deliveries are jobs one after the other; the tables don't wait for each other."""
    columns = ["tbl", "snapshot_no", "source_id", "item_key", "change_type"]
    registry = lambda: snapshot_changes(read_table(spark, d, "ingestion_registry")).withColumn("tbl", F.lit("ingestion_registry"))
    listing = lambda: listing_changes(read_table(spark, d, "vectors_prior"), read_table(spark, d, "vectors"), LISTING_SNAPSHOT).withColumn("tbl", F.lit("vectors"))
    with ThreadPoolExecutor(2) as pool:
        found = [pool.submit(inheritable_thread_target(spark)(f)) for f in (registry, listing)]
        return found[0].result().select(*columns).unionByName(found[1].result().select(*columns))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("tbl", "snapshot_no", "change_type").agg(F.count("*").alias("n"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The digests before and after, of the records that changed."""
    changes = snapshot_changes(read_table(spark, d, "ingestion_registry")).where("change_type = 'changed'")
    return changes.select("snapshot_no", "source_id", "item_key", F.col("old_value").alias("old_digest"), F.col("new_value").alias("new_digest"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(read_table(spark, d, "ingestion_registry"), read_table(spark, d, "vectors")).select("snapshot_no", "chunk_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(read_table(spark, d, "ingestion_registry"), read_table(spark, d, "vectors"), "ingestion_registry")


_KEY = r"regexp_replace(lower(trim(item_key)), '/$', '')"

_P2 = rf"""
WITH held AS (
  SELECT snapshot_no, source_id, {_KEY} AS item_key,
         nullif(regexp_replace(lower(trim(content_hash)), '^[^:]*:', ''), '') AS digest,
         row_number() OVER (PARTITION BY snapshot_no, source_id, {_KEY}
                            ORDER BY delivered_at DESC NULLS LAST, lower(content_hash) DESC NULLS LAST) AS rn
  FROM ingestion_registry WHERE snapshot_no IS NOT NULL AND source_id IS NOT NULL AND item_key IS NOT NULL),
cur AS (SELECT * FROM held WHERE rn = 1),
pairs AS (
  SELECT source_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY source_id ORDER BY snapshot_no) AS prev
  FROM (SELECT DISTINCT source_id, snapshot_no FROM cur)),
reg AS (
  SELECT p.snapshot_no, n.source_id, n.item_key,
         CASE WHEN o.item_key IS NULL THEN 'added' WHEN n.digest <> o.digest THEN 'changed' END AS change_type
  FROM pairs p JOIN cur n ON n.source_id = p.source_id AND n.snapshot_no = p.snapshot_no
  LEFT JOIN cur o ON o.source_id = p.source_id AND o.snapshot_no = p.prev AND o.item_key = n.item_key
  WHERE p.prev IS NOT NULL
  UNION ALL
  SELECT p.snapshot_no, o.source_id, o.item_key, 'removed'
  FROM pairs p JOIN cur o ON o.source_id = p.source_id AND o.snapshot_no = p.prev
  LEFT JOIN cur n ON n.source_id = p.source_id AND n.snapshot_no = p.snapshot_no AND n.item_key = o.item_key
  WHERE n.item_key IS NULL),
a AS (SELECT source_id, {_KEY} AS item_key, list_sort(list(DISTINCT id)) AS ids FROM vectors_prior
      WHERE source_id IS NOT NULL AND item_key IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT source_id, {_KEY} AS item_key, list_sort(list(DISTINCT id)) AS ids FROM vectors
      WHERE source_id IS NOT NULL AND item_key IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2),
vec AS (
  SELECT source_id, item_key,
         CASE WHEN a.ids IS NULL THEN 'added' WHEN b.ids IS NULL THEN 'removed' WHEN a.ids <> b.ids THEN 'changed' END AS change_type
  FROM a FULL JOIN b USING (source_id, item_key)),
found AS (
  SELECT 'ingestion_registry' AS tbl, snapshot_no, source_id, item_key, change_type FROM reg WHERE change_type IS NOT NULL
  UNION ALL
  SELECT 'vectors', 5, source_id, item_key, change_type FROM vec WHERE change_type IS NOT NULL)
"""

_P6 = """
WITH refs AS (
  SELECT snapshot_no, chunk_id, min(snapshot_at) AS snapshot_at
  FROM (SELECT snapshot_no, snapshot_at, unnest(chunk_ids) AS chunk_id FROM ingestion_registry)
  WHERE chunk_id IS NOT NULL GROUP BY 1, 2),
par AS (SELECT id, min(created_at) AS created_at FROM vectors GROUP BY 1),
checked AS (
  SELECT r.snapshot_no, r.chunk_id,
         CASE WHEN p.id IS NULL THEN 'missing' WHEN p.created_at > r.snapshot_at THEN 'later' END AS reason
  FROM refs r LEFT JOIN par p ON p.id = r.chunk_id)
"""

QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p2_values": p2_values, "p6_found": p6_found, "p6_report": p6_report}

ORACLE = {
    "p2_found": _P2 + "SELECT tbl, snapshot_no, source_id, item_key, change_type FROM found",
    "p2_counts": _P2 + "SELECT tbl, snapshot_no, change_type, count(*) AS n FROM found GROUP BY ALL",
    "p2_values": _P2
    + """SELECT p.snapshot_no, n.source_id, n.item_key, o.digest AS old_digest, n.digest AS new_digest
      FROM pairs p JOIN cur n ON n.source_id = p.source_id AND n.snapshot_no = p.snapshot_no
      JOIN cur o ON o.source_id = p.source_id AND o.snapshot_no = p.prev AND o.item_key = n.item_key WHERE n.digest <> o.digest""",
    "p6_found": _P6 + "SELECT snapshot_no, chunk_id FROM checked WHERE reason IS NOT NULL",
    "p6_report": _P6
    + """SELECT 'ingestion_registry' AS tbl, snapshot_no, count(*) AS n_references,
             count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'later') AS n_later
      FROM checked GROUP BY snapshot_no""",
}
