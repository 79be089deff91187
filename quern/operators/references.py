"""References to records that don't exist.

Parent keys are read as integers within a group: an id ``group::ordinal::digest`` has the ordinal as its
integer, and any other id is a group of its own with the integer 0. The sorted integers of a group are
compressed into *contiguous runs* ``[start, end]``. A reference is as-of matched to the run that starts at or
before its integer: what lies beyond the run's end is an orphan, whatever its digest, and is reported there and
then. Only what falls inside a run goes on to the exact check, by 128 bits of hash of the whole id, for the digest
and for the time at which the parent came.

Runs are far fewer than parents (one for each page or section), so the as-of match ships them to ``SALTS``
partitions each; references are spread over these, and a group that holds a third of all references is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Partitions over which the references of one group are spread.
SALTS = 16

_PATTERN = r"^(.*)::(0|[1-9][0-9]{0,8})::([^:]*)$"


def _parts(key: Column) -> list[Column]:
    """``grp`` (hash of the group), ``ord`` (the integer) and ``h1, h2`` (the exact id, hashed)."""
    plain = F.regexp_extract(key, _PATTERN, 2)
    return [
        F.when(plain != "", F.xxhash64(F.lit(1), F.regexp_extract(key, _PATTERN, 1))).otherwise(F.xxhash64(F.lit(0), key)).alias("grp"),
        F.when(plain != "", plain.cast("int")).otherwise(F.lit(0)).alias("ord"),
        F.xxhash64(key).alias("h1"),
        F.xxhash64(F.lit("second"), key).alias("h2"),
    ]


def key_runs(parents: DataFrame) -> DataFrame:
    """``grp, start, end``: the contiguous runs of the parents' integers. Repeated integers count once."""
    # Runs only need the distinct integers; what is ordered in a window is a group's ordinals, without payload.
    distinct = parents.select("grp", "ord").distinct()
    order = Window.partitionBy("grp").orderBy("ord")
    return (
        distinct.withColumn("island", F.col("ord") - F.row_number().over(order))
        .groupBy("grp", "island")
        .agg(F.min("ord").alias("start"), F.max("ord").alias("end"))
        .select("grp", "start", "end")
    )


def exploded_references(rows: DataFrame) -> DataFrame:
    """Distinct ``snapshot_no, chunk_id`` with the earliest ``snapshot_at``, of non-null elements of ``chunk_ids``."""
    return (
        rows.where("snapshot_no is not null")
        .select(F.col("snapshot_no").cast("int").alias("snapshot_no"), "snapshot_at", F.explode("chunk_ids").alias("chunk_id"))
        .where("chunk_id is not null")
        .groupBy("snapshot_no", "chunk_id")
        .agg(F.min("snapshot_at").alias("snapshot_at"), F.count("*").alias("n_rows"))
    )


def orphan_references(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """References with no parent at the time of their snapshot.

    ``rows``: ``snapshot_no, snapshot_at, chunk_ids``; ``parents``: ``id, created_at``; other columns are ignored.
    Returns ``snapshot_no, chunk_id, n_rows, reason``: ``missing`` (no parent has this id) or ``later`` (the
    earliest ``created_at`` of the parent is after the snapshot). Null and empty lists and null elements give
    nothing; an empty string is a reference like any other; a parent without ``created_at`` counts as present
    always, and a reference without ``snapshot_at`` is never *later*.
    """
    held = (
        parents.where("id is not null")
        .groupBy("id")
        .agg(F.min("created_at").alias("created_at"), F.max(F.col("created_at").isNull()).alias("always"))
        .select(*_parts(F.col("id")), F.when(~F.col("always"), F.col("created_at")).alias("created_at"))
    )
    references = exploded_references(rows).select("*", *_parts(F.col("chunk_id")))

    runs = key_runs(held).select(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("start").alias("ord"), F.col("end"), F.lit(0).alias("is_ref")
    )
    salted = references.select("*", F.pmod("h1", F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("is_ref"))
    preceding = Window.partitionBy("grp", "salt").orderBy("ord", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    matched = (
        salted.unionByName(runs, allowMissingColumns=True)
        .withColumn("run_end", F.last("end", ignorenulls=True).over(preceding))
        .where("is_ref = 1")
        .withColumn("beyond", F.col("run_end").isNull() | (F.col("ord") > F.col("run_end")))
    )
    out = ["snapshot_no", "chunk_id", "n_rows"]
    beyond = matched.where("beyond").select(*out, F.lit("missing").alias("reason"))
    there = held.select("h1", "h2", F.lit(True).alias("found"), F.col("created_at").alias("parent_created_at"))
    inside = matched.where("not beyond").select(*out, "snapshot_at", "h1", "h2").join(there, ["h1", "h2"], "left")
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("parent_created_at") > F.col("snapshot_at"), "later")
    return beyond.unionByName(inside.select(*out, reason.alias("reason")).where("reason is not null"))


def orphan_report(rows: DataFrame, parents: DataFrame, table: str) -> DataFrame:
    """Number of references and orphans, for each snapshot of ``table``: ``tbl, snapshot_no, n_references, n_missing, n_later``."""
    totals = exploded_references(rows).groupBy("snapshot_no").agg(F.count("*").alias("n_references"))
    orphans = (
        orphan_references(rows, parents)
        .groupBy("snapshot_no")
        .agg(F.count_if(F.col("reason") == "missing").alias("n_missing"), F.count_if(F.col("reason") == "later").alias("n_later"))
    )
    return totals.join(orphans, "snapshot_no", "left").select(
        F.lit(table).alias("tbl"),
        "snapshot_no",
        "n_references",
        F.coalesce("n_missing", F.lit(0)).cast("bigint").alias("n_missing"),
        F.coalesce("n_later", F.lit(0)).cast("bigint").alias("n_later"),
    )
