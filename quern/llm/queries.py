"""Queries of the training-data operators, with the SQL that states the same where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.boilerplate import main_content, page_boilerplate
from quern.llm.encoding import garbled
from quern.llm.leakage import leaked_items, without_leaks
from quern.llm.mixing import mixture, mixture_report
from quern.llm.neighbours import nearest, neighbour_pairs
from quern.llm.repeated_lines import repeated_lines, without_repeated_lines
from quern.llm.splitting import oversized, split_files, split_items
from quern.session import read_table, scratch_dir


def _website(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "vectors").where(F.lower(F.trim("source_type")) == "website")
    return rows.select("id", "text", F.element_at("metadata", F.lit("title")).alias("title"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return page_boilerplate(_website(spark, d))


def p1_bodies(spark: SparkSession, d: str) -> DataFrame:
    return main_content(_website(spark, d)).select("id", "main_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(read_table(spark, d, "vectors")).select("id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_items(read_table(spark, d, "vectors"))


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """The texts as files of many megabytes, split by byte ranges: ``file_no, piece_no, start_byte, n_tokens, digest``."""
    texts = read_table(spark, d, "vectors").where("text is not null")
    n = 4 + texts.count() // 50_000
    path = f"{scratch_dir(spark)}/texts-{uuid.uuid4().hex[:12]}"
    texts.repartition(n, "id").sortWithinPartitions("id", "text").select("text").write.option("lineSep", "\n\n").text(path)
    pieces = split_files(spark, path)
    return pieces.select(F.regexp_extract("path", "part-([0-9]+)", 1).cast("int").alias("file_no"), "piece_no", "start_byte", "n_tokens", F.md5("piece").alias("digest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(read_table(spark, d, "vectors")).select("id", "line_no").distinct()


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return without_repeated_lines(read_table(spark, d, "vectors").select("id", "source_id", "text")).select("id", "source_id", "n_cut", "clean_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(read_table(spark, d, "vectors"), min_cosine=0.85)


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest, whatever their cosine, of a stated set: ids whose digest is divisible by 100, against all."""
    stated = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long") % 100 == 0
    return nearest(read_table(spark, d, "vectors"), asked=stated).select("key_a", "key_b", "rank", F.round("cosine", 6).alias("cosine"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked: documents that hold part of each, and the longest run of words found."""
    leaks = leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("longest"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(read_table(spark, d, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled(read_table(spark, d, "documents"))


_BARE = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"

_P4 = r"""
WITH lines AS (
  SELECT DISTINCT source_id, id, i AS line_no,
         regexp_replace(lower(string_split(text, chr(10))[i]), '[\s0-9!-/:-@\[-`{-~]+', '', 'g') AS norm
  FROM (SELECT source_id, id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM vectors
        WHERE id IS NOT NULL AND source_id IS NOT NULL AND text IS NOT NULL)),
sizes AS (SELECT source_id, count(DISTINCT id) AS n FROM vectors WHERE text IS NOT NULL GROUP BY 1),
often AS (
  SELECT source_id, norm FROM (SELECT source_id, norm, count(DISTINCT id) AS k FROM lines WHERE norm <> '' GROUP BY 1, 2) JOIN sizes USING (source_id)
  WHERE k >= 5 AND k >= n * 0.02::DOUBLE)
SELECT DISTINCT id, line_no::INT AS line_no FROM lines JOIN often USING (source_id, norm)"""

_P7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e)),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))
"""

_P7_RUNS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
eg AS (SELECT item_id, j, array_to_string(w[j:j+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS j FROM e)),
m AS (SELECT DISTINCT doc_id, item_id, i, j FROM dg JOIN eg USING (g)),
s AS (SELECT doc_id, item_id, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM m),
r AS (SELECT doc_id, item_id, count(*) + 12 AS n_words FROM s GROUP BY doc_id, item_id, diagonal, run)
"""

QUERIES = {"p1_found": p1_found, "p1_bodies": p1_bodies, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_files": p3_files, "p4_found": p4_found, "p4_cleaned": p4_cleaned, "p5_found": p5_found, "p5_nearest": p5_nearest,
    "p7_found": p7_found, "p7_items": p7_items, "p7_clean": p7_clean,
    "p8_mixture": p8_mixture, "p8_report": p8_report,
    "p9_found": p9_found, "p9_restored": p9_restored}

ORACLE = {
    "p3_found": rf"""SELECT DISTINCT id FROM vectors
      WHERE length({_BARE}) > 0
        AND floor(greatest(length({_BARE}) / 4.0::DOUBLE, len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE)) + 1 > 750""",
    "p4_found": _P4,
    "p4_cleaned": f"""WITH found AS ({_P4}), cut AS (SELECT id, list(line_no) AS ns FROM found GROUP BY 1)
      SELECT v.id, v.source_id, coalesce(len(ns), 0)::INT AS n_cut,
        array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(coalesce(ns, []), i::INT)), chr(10)) AS clean_text
      FROM vectors v LEFT JOIN cut USING (id)""",
    "p7_found": _P7 + "SELECT doc_id, item_id FROM found",
    "p7_items": _P7_RUNS + "SELECT item_id, count(DISTINCT doc_id) AS n_documents, max(n_words)::INT AS longest FROM r GROUP BY 1",
    "p7_clean": _P7 + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)",
    "p5_found": """
WITH u AS (
  SELECT DISTINCT id, lower(trim(embed_provider)) AS p,
         list_transform(list_resize(embedding, 64, 0::FLOAT)::DOUBLE[], lambda x: coalesce(x, 0)) AS v
  FROM vectors WHERE embedding IS NOT NULL AND lower(trim(embed_provider)) NOT IN ('', 'legacy:unknown')),
n AS (SELECT id, p, v, sqrt(list_dot_product(v, v)) AS l FROM u WHERE list_dot_product(v, v) > 0),
c AS (SELECT a.id AS x, b.id AS y, max(list_dot_product(a.v, b.v) / (a.l * b.l)) AS s
      FROM n a JOIN n b ON a.p = b.p AND a.id <> b.id
      WHERE list_dot_product(a.v, b.v) / (a.l * b.l) >= 0.85 GROUP BY 1, 2),
r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS rn FROM c)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE rn <= 10""",
}
