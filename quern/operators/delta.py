"""Incremental ingestion: what is new, what changed, and how the registry and the stores are brought up to date.

Everything is a join on (source_id, item_key); inputs are expected to hold one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import content_hash, stripped

KEY = ["source_id", "item_key"]
REASON_MAX = 300


def _ids(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(-1))


def delta_reason(provider: Column | None) -> Column:
    """Why an item needs work, from the joined registry row (``r_`` columns) and the fresh hash; in this order."""
    reason = (
        F.when(F.col("r_item_key").isNull(), "new")
        .when(~F.col("r_content_hash").eqNullSafe(F.col("content_hash")), "changed")
        .when(_ids("r_chunk_ids") <= 0, "no-vectors")
        .when(~F.coalesce(F.col("r_status").isin("indexed", "unchanged"), F.lit(False)), "previous-run-incomplete")
    )
    if provider is not None:
        reason = reason.when(~F.col("r_embed_provider").eqNullSafe(provider), "embedding-model-changed")
    return reason.otherwise("unchanged")


def decide(fresh: DataFrame, registry: DataFrame, provider: str | None = None) -> DataFrame:
    """``source_id, item_key, content_hash, reason`` for every fresh item."""
    known = registry.select(*KEY, *(F.col(c).alias(f"r_{c}") for c in ("content_hash", "chunk_ids", "status", "embed_provider")), F.col("item_key").alias("r_item_key"))
    joined = fresh.select(*KEY, "content_hash").join(known, KEY, "left")
    return joined.withColumn("reason", delta_reason(None if provider is None else F.lit(provider))).select(*KEY, "content_hash", "reason")


def reason_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("reason").agg(F.count("*").alias("n"))


def confirm(decisions: DataFrame, live: DataFrame, stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Decisions checked against the live vectors: ``source_id, item_key, reason, changed``.

    ``live``: ``source_id, item_key, id, content_hash``, a row for each chunk; ``stored``: ``text`` of each item;
    ``rebuilt``: ``ids``, the chunk ids the fresh text gives, as an array. A changed item that has live vectors
    counts as unchanged if its stored text, a live hash or the whole set of ids agrees; an unchanged one without
    live vectors is ``vectors-missing``.
    """
    alive = live.groupBy(*KEY).agg(F.array_sort(F.collect_set("id")).alias("live_ids"), F.min_by("content_hash", "id").alias("live_hash"))
    kept = stored.select(*KEY, content_hash(stripped("text")).alias("stored_hash"), (F.length(stripped(F.coalesce("text", F.lit("")))) > 0).alias("has_text"))
    joined = (
        decisions.join(alive, KEY, "left")
        .join(kept, KEY, "left")
        .join(rebuilt.select(*KEY, F.array_sort(F.array_distinct("ids")).alias("new_ids")), KEY, "left")
    )
    there = F.col("live_ids").isNotNull()
    same = (
        F.when(F.col("has_text") & (F.col("stored_hash") == F.col("content_hash")), "already-indexed-unchanged")
        .when(F.col("live_hash") == F.col("content_hash"), "already-indexed-live-hash-match")
        .when((F.size("new_ids") > 0) & (F.col("new_ids") == F.col("live_ids")), "already-indexed-exact-chunks-match")
    )
    reason = F.when(F.col("reason") == "unchanged", F.when(there, "unchanged").otherwise("vectors-missing")).otherwise(F.coalesce(F.when(there, same), F.col("reason")))
    out = joined.withColumn("reason", reason)
    return out.select(*KEY, "reason", (~F.col("reason").startswith("already-indexed") & (F.col("reason") != "unchanged")).alias("changed"))


def crawl_diff(old: DataFrame, new: DataFrame, probes: DataFrame) -> DataFrame:
    """``url, title, change_type`` of a crawl against the one before: NEW, MODIFIED, DELETED or RETAINED.

    ``old`` and ``new``: ``url, title, hash``; ``probes``: ``url, status`` of pages that weren't reached. Only a
    probe answered 404 or 410 deletes; any other answer or none retains. Unchanged pages have no row.
    """
    joined = (
        old.select("url", F.col("title").alias("old_title"), F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
        .join(new.select("url", "title", "hash", F.lit(True).alias("is")), "url", "full_outer")
        .join(probes.select("url", "status"), "url", "left")
    )
    kind = (
        F.when(F.col("was").isNull(), "NEW")
        .when(F.col("is").isNull(), F.when(F.col("status").isin(404, 410), "DELETED").otherwise("RETAINED"))
        .when(~F.col("hash").eqNullSafe(F.col("old_hash")), "MODIFIED")
    )
    title = F.when(F.col("is"), F.col("title")).otherwise(F.coalesce("old_title", F.lit("Unknown")))
    return joined.withColumn("change_type", kind).where("change_type is not null").select("url", title.alias("title"), "change_type")


def changes_summary(changes: DataFrame) -> DataFrame:
    """One row, ``summary``: the changes of a crawl in a sentence."""
    n = lambda kind: F.count_if(F.col("change_type") == kind)
    part = lambda c, one, many: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.when(F.col(c) > 1, F.lit(many)).otherwise(F.lit(one))))
    counts = changes.agg(n("NEW").alias("new"), n("MODIFIED").alias("mod"), n("DELETED").alias("gone"), F.count("*").alias("n"))
    text = F.concat_ws(
        ", ", part("new", " new page discovered", " new pages discovered"), part("mod", " updated page", " updated pages"), part("gone", " deleted page purged", " deleted pages purged")
    )
    summary = (
        F.when(F.col("n") == 0, "No changes detected. Website content is up to date.")
        .when(text == "", "No content changes detected. Knowledge base already up to date.")
        .otherwise(F.concat(F.lit("Changes detected: "), text))
    )
    return counts.select(summary.alias("summary"))


def merged_state(old: DataFrame, new: DataFrame, deleted: DataFrame) -> DataFrame:
    """The crawl state after a crawl: new rows over old ones, without the deleted URLs."""
    gone = deleted.select("url").distinct()
    return old.join(new.select("url"), "url", "left_anti").join(gone, "url", "left_anti").unionByName(new)


def upsert_items(stored: DataFrame, incoming: DataFrame, now: Column, replace_missing: bool = False) -> DataFrame:
    """The knowledge store after a merge, with what happened to each item.

    ``stored``: ``source_id, item_key, title, text, hash, first_seen, last_seen, updated``; ``incoming``:
    ``source_id, item_key, title, text``. Returns the stored columns and ``change``: ``new``, ``updated``,
    ``unchanged``, ``kept`` (not in the input) or, if ``replace_missing``, ``removed``. An item whose text is blank
    is skipped – it changes nothing, but counts as present.
    """
    bare = stripped(F.coalesce("text", F.lit("")))
    fresh = incoming.select(*KEY, F.col("title").alias("n_title"), bare.alias("n_text"), F.lit(True).alias("present"))
    fresh = fresh.withColumn("n_hash", F.when(F.length("n_text") > 0, F.md5("n_text")))
    both = stored.withColumn("was", F.lit(True)).join(fresh, KEY, "full_outer")
    change = (
        F.when(F.col("was").isNull(), F.when(F.col("n_hash").isNotNull(), "new"))
        .when(F.col("present").isNull(), "removed" if replace_missing else "kept")
        .when(F.col("n_hash").isNull(), "kept")
        .when(F.col("hash").eqNullSafe(F.col("n_hash")), "unchanged")
        .otherwise("updated")
    )
    both = both.withColumn("change", change).where("change is not null")
    write = F.col("change").isin("new", "updated")
    seen = write | (F.col("change") == "unchanged")
    pick = lambda new, old: F.when(write, new).otherwise(F.col(old)).alias(old)
    return both.select(
        *KEY,
        pick(F.coalesce("n_title", "item_key"), "title"),
        pick(F.col("n_text"), "text"),
        pick(F.col("n_hash"), "hash"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        pick(now, "updated"),
        "change",
    )


def registry_record(registry: DataFrame, indexed: DataFrame, now: Column) -> DataFrame:
    """The registry rows of freshly indexed items: the revision goes up, ``first_seen`` stays.

    ``indexed``: ``source_id, item_key, title, content_hash, chunk_ids, token_count, embed_provider``.
    """
    old = registry.select(*KEY, F.col("title").alias("old_title"), F.col("revision").alias("old_revision"), F.col("first_seen").alias("old_first"))
    return indexed.join(old, KEY, "left").select(
        *KEY,
        F.coalesce("title", "old_title", "item_key").alias("title"),
        "content_hash",
        F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
        F.greatest(_ids("chunk_ids"), F.lit(0)).alias("chunk_count"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        "embed_provider",
        F.lit("indexed").alias("status"),
        F.coalesce("old_first", now).alias("first_seen"),
        now.alias("last_embedded"),
        (F.coalesce("old_revision", F.lit(0)) + 1).alias("revision"),
    )


def registry_touch(registry: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """The registry with ``last_scraped`` and status of the given, existing items refreshed."""
    hit = registry.join(keys.select(*KEY).distinct().withColumn("hit", F.lit(True)), KEY, "left")
    return hit.withColumn("last_scraped", F.when(F.col("hit"), now).otherwise(F.col("last_scraped"))).withColumn("status", F.when(F.col("hit"), "indexed").otherwise(F.col("status"))).drop("hit")


def registry_fail(registry: DataFrame, failures: DataFrame) -> DataFrame:
    """``source_id, item_key, status, failure_reason`` after failures, which make a row where there was none."""
    bad = failures.select(*KEY, F.substring("reason", 1, REASON_MAX).alias("new_reason"), F.lit(True).alias("bad"))
    both = registry.select(*KEY, "status", "failure_reason").join(bad, KEY, "full_outer")
    return both.select(*KEY, F.when(F.col("bad"), "failed").otherwise(F.col("status")).alias("status"), F.when(F.col("bad"), F.col("new_reason")).otherwise(F.col("failure_reason")).alias("failure_reason"))


def forget(registry: DataFrame, keys: DataFrame) -> DataFrame:
    return registry.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def registry_backfill(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """Registry rows made from the vector store, for items that have none with chunk ids.

    The chunk with the least id supplies hash, provider and name. Chunks without an item key are skipped, those
    without a source belong to ``website``.
    """
    rows = chunks.where("item_key is not null").withColumn("source_id", F.coalesce("source_id", F.lit("website")))
    first = F.min(F.struct("id", "content_hash", "embed_provider", "source_name")).alias("first")
    made = rows.groupBy(*KEY).agg(first, F.array_sort(F.collect_set("id")).alias("chunk_ids"), F.sum(F.coalesce("tokens", F.lit(0))).alias("token_count"))
    have = registry.where(_ids("chunk_ids") > 0).select(*KEY).distinct()
    return made.join(have, KEY, "left_anti").select(
        *KEY,
        F.coalesce("first.source_name", "item_key").alias("title"),
        F.coalesce("first.content_hash", F.lit("")).alias("content_hash"),
        "chunk_ids",
        F.size("chunk_ids").alias("chunk_count"),
        "token_count",
        F.coalesce("first.embed_provider", F.lit("legacy:unknown")).alias("embed_provider"),
        F.lit("indexed").alias("status"),
        F.lit(1).alias("revision"),
    )


def known_chunk_ids(registry: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Distinct chunk ids the registry lists, of all items or of the given ones."""
    rows = registry if keys is None else registry.join(keys.select(*KEY).distinct(), KEY, "left_semi")
    return rows.select(F.explode("chunk_ids").alias("chunk_id")).where("chunk_id is not null").distinct()
