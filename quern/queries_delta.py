"""Queries over the registry, the stores and the planning of work, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import dedupe_key
from quern.operators import delta as D
from quern.operators import embedding as E
from quern.operators import store as S
from quern.operators.reports import regrouped_text
from quern.plans import slices as P
from quern.queries_text import WS, bare
from quern.session import read_table, scratch_path

PROVIDER = "gemini:text-alpha-2"
#: The snapshots compared: the last two there are, by their place from the end.
OLD, NEW = 1, 0
NOW = "2025-04-01 00:00:00"


def _last_two(s: SparkSession, d: str) -> list:
    """Number and time of the last two snapshots, the newest first."""
    times = read_table(s, d, "ingestion_registry").where("snapshot_no is not null").groupBy("snapshot_no").agg(F.max("snapshot_at").cast("timestamp_ntz").alias("at"))
    return times.orderBy(F.desc("snapshot_no")).limit(2).collect()


def _then(s: SparkSession, d: str):
    """The time of the earlier snapshot; null if there is only one."""
    two = _last_two(s, d)
    return F.lit(str(two[OLD]["at"]) if len(two) > OLD else None).cast("timestamp")


def _registry(s: SparkSession, d: str, n: int) -> DataFrame:
    two = _last_two(s, d)
    rows = read_table(s, d, "ingestion_registry").where(F.col("snapshot_no") == (two[n]["snapshot_no"] if len(two) > n else None))
    return S.latest(rows, ["source_id", "item_key"], [F.desc("delivered_at"), F.desc_nulls_last("content_hash"), F.desc_nulls_last("status")])


def _vectors(s, d):
    return read_table(s, d, "vectors")


def _earlier(s, d, rows: DataFrame) -> DataFrame:
    return rows.where(F.col("created_at") < _then(s, d))


def _unique(s, d):
    return S.latest(_vectors(s, d), ["id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("embed_provider"), F.desc_nulls_last("tokens"), F.desc_nulls_last("item_key"), F.desc_nulls_last("content_hash"), F.desc_nulls_last("source_name")])


def delta_decide(s, d):
    return D.decide(_registry(s, d, NEW), _registry(s, d, OLD), PROVIDER)


def delta_reason_counts(s, d):
    return D.reason_counts(delta_decide(s, d))


def confirm_unchanged(s, d):
    stored = regrouped_text(_vectors(s, d))
    rebuilt = _registry(s, d, NEW).select("source_id", "item_key", F.filter("chunk_ids", lambda x: x.isNotNull()).alias("ids"))
    return D.confirm(delta_decide(s, d), _vectors(s, d).where("item_key is not null"), stored, rebuilt)


def _crawl(s, d, n):
    return _registry(s, d, n).select(F.concat_ws("|", "source_id", "item_key").alias("url"), "item_key", "title", F.col("content_hash").alias("hash"))


def _changes(s, d):
    known = read_table(s, d, "crawl_state").select(F.col("url").alias("item_key")).distinct()
    probes = _crawl(s, d, OLD).join(known, "item_key", "left_anti").select("url", F.lit(404).alias("status"))
    return D.crawl_diff(_crawl(s, d, OLD), _crawl(s, d, NEW), probes)


def crawl_diff(s, d):
    return _changes(s, d)


def changes_summary(s, d):
    return D.changes_summary(_changes(s, d))


def crawl_state_merge(s, d):
    cols = ["url", "hash"]
    gone = _changes(s, d).where("change_type = 'DELETED'")
    return D.merged_state(_crawl(s, d, OLD).select(*cols), _crawl(s, d, NEW).select(*cols), gone)


def knowledge_upsert(s, d):
    old = regrouped_text(_earlier(s, d, _vectors(s, d)))
    then = _then(s, d)
    bare_text = F.regexp_replace("text", rf"^{WS}+|{WS}+$", "")
    stored = old.select("source_id", "item_key", F.col("item_key").alias("title"), bare_text.alias("text"), F.md5(bare_text).alias("hash"), then.alias("first_seen"), then.alias("last_seen"), then.alias("updated"))
    incoming = regrouped_text(_vectors(s, d)).withColumn("title", F.lit(None).cast("string"))
    done = D.upsert_items(stored, incoming, F.lit(NOW).cast("timestamp"))
    return done.select("source_id", "item_key", "title", "hash", "first_seen", "last_seen", "updated", "change")


def registry_record(s, d):
    indexed = _registry(s, d, NEW).where("status = 'indexed'")
    return D.registry_record(_registry(s, d, OLD), indexed, F.lit(NOW).cast("timestamp")).select("source_id", "item_key", "title", "content_hash", "chunk_count", "token_count", "first_seen", "revision")


def registry_touch(s, d):
    same = delta_decide(s, d).where("reason = 'unchanged'")
    return D.registry_touch(_registry(s, d, OLD), same, F.lit(NOW).cast("timestamp")).select("source_id", "item_key", "last_scraped", "status")


def registry_fail(s, d):
    bad = _registry(s, d, NEW).where("failure_reason is not null").select("source_id", "item_key", F.col("failure_reason").alias("reason"))
    return D.registry_fail(_registry(s, d, OLD), bad)


def registry_forget(s, d):
    return D.forget(_registry(s, d, OLD), _registry(s, d, NEW)).select("source_id", "item_key")


def registry_backfill(s, d):
    return D.registry_backfill(_registry(s, d, OLD), _unique(s, d)).select("source_id", "item_key", "title", "content_hash", "chunk_count", "token_count", "embed_provider", "revision")


def registry_chunk_ids(s, d):
    return D.known_chunk_ids(_registry(s, d, OLD))


def unique_chunks(s, d):
    return S.unique_chunks(_unique(s, d), [F.col("id")]).select("id")


def append_anti_join(s, d):
    rows = _unique(s, d)
    new = rows.where(F.col("created_at") >= _then(s, d))
    return S.appendable(_earlier(s, d, rows), new, [F.col("id")]).select("id")


def index_merge(s, d):
    cols = ["id", "source_id", "item_key"]
    return S.merge_stores(_unique(s, d).select(*cols), read_table(s, d, "vectors_prior").select(*cols).dropDuplicates(["id"]), "id").select("id")


def latest_per_id(s, d):
    return _unique(s, d).select("id", "updated_at")


def remap_sources(s, d):
    mapping = s.createDataFrame([("website", "site-main")], "old string, new string")
    return S.remap_sources(_vectors(s, d).select("id", "source_id").distinct(), mapping)


def pending_reembed(s, d):
    return S.pending(_unique(s, d), PROVIDER).select("id", "embed_provider")


def source_deleted(s, d):
    store = S.VersionedStore(s, scratch_path(s, "deleted"))
    store.write(_vectors(s, d).select("id", "source_id"))
    store.delete(F.col("source_id") == "website")
    return store.read().select("id").distinct()


def _sizes(s, d):
    return _unique(s, d).where("item_key is not null").groupBy(F.concat_ws("|", "source_id", "item_key").alias("item_key")).agg(F.count("*").cast("int").alias("n_chunks"))


def commit_slices(s, d):
    return P.commit_slices(_sizes(s, d))


def commit_slices_capped(s, d):
    return P.commit_slices(_sizes(s, d), 150, 600)


def request_batches(s, d):
    inputs = read_table(s, d, "documents").select("source", F.col("doc_id").alias("pos"), F.floor(F.col("n_chars") / 4).cast("long").alias("n_tokens"))
    return P.request_batches(inputs, 20, 4000, 500, "source")


def budget_prefix(s, d):
    rows = read_table(s, d, "ingestion_registry").groupBy(F.col("snapshot_no").alias("slice")).agg(F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("miss_tokens"))
    return P.affordable(rows, 200_000, 50_000)


def cache_misses(s, d):
    texts = _vectors(s, d).select(F.weekofyear("created_at").alias("slice"), F.sha1("text").alias("fp"), F.length("text").cast("long").alias("n_tokens"))
    cache = _earlier(s, d, _vectors(s, d)).where("tokens is not null").select(F.sha1("text").alias("fp"))
    return P.first_misses(texts, cache)


def cache_hit_rate(s, d):
    cache = _earlier(s, d, _vectors(s, d)).select(F.lit(PROVIDER).alias("space"), F.sha1("text").alias("fp")).distinct().withColumn("vector", F.lit(1))
    return E.hit_rate(E.cache_lookup(_vectors(s, d).select("text"), cache, PROVIDER))


def cache_stored(s, d):
    old = _earlier(s, d, _vectors(s, d)).select(F.lit(PROVIDER).alias("space"), F.sha1("text").alias("fp")).distinct()
    return E.cache_store(old, _vectors(s, d).select(F.lit(PROVIDER).alias("space"), F.sha1("text").alias("fp")), 1_000_000)


def token_ledger(s, d):
    ev = read_table(s, d, "events")
    return E.ledger_daily(ev, F.col("ts"), F.floor("value").cast("long"), F.lit(0).cast("long"))


def budget_status(s, d):
    return E.budget_status(token_ledger(s, d), 4000)


def duplicate_digests(s, d):
    w = Window.partitionBy("source_id", "digest").orderBy("id")
    rows = _unique(s, d).select("source_id", "id", dedupe_key(F.col("text")).alias("digest"))
    return rows.withColumn("n", F.row_number().over(w)).where("n > 1").select("id", "source_id", "n")


def duplicate_documents(s, d):
    """Documents whose normalised text an earlier one has."""
    rows = read_table(s, d, "documents").select("doc_id", dedupe_key(F.col("text")).alias("digest"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))).where("n > 1").select("doc_id", "n")


_REG = """(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, item_key ORDER BY delivered_at DESC, content_hash DESC NULLS LAST, status DESC NULLS LAST) AS rn
           FROM ingestion_registry WHERE snapshot_no = {n}) WHERE rn = 1)"""
_LAST = "(SELECT max(snapshot_no) FROM ingestion_registry)"
_BEFORE = f"(SELECT max(snapshot_no) FROM ingestion_registry WHERE snapshot_no < {_LAST})"
_O, _N = _REG.format(n=_BEFORE), _REG.format(n=_LAST)
_THEN = f"(SELECT max(snapshot_at)::TIMESTAMP FROM ingestion_registry WHERE snapshot_no = {_BEFORE})"
_U = """u AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, embed_provider DESC NULLS LAST, tokens DESC NULLS LAST,
         item_key DESC NULLS LAST, content_hash DESC NULLS LAST, source_name DESC NULLS LAST) AS rn FROM vectors) WHERE rn = 1)"""
_DECIDE = f"""o AS {_O}, n AS {_N},
dec AS (SELECT n.source_id, n.item_key, n.content_hash,
  CASE WHEN o.item_key IS NULL THEN 'new' WHEN o.content_hash IS DISTINCT FROM n.content_hash THEN 'changed' WHEN coalesce(len(o.chunk_ids), 0) = 0 THEN 'no-vectors'
       WHEN NOT coalesce(o.status IN ('indexed', 'unchanged'), false) THEN 'previous-run-incomplete' WHEN o.embed_provider IS DISTINCT FROM '{PROVIDER}' THEN 'embedding-model-changed'
       ELSE 'unchanged' END AS reason FROM n LEFT JOIN o USING (source_id, item_key))"""
_CRAWL = f"""co AS (SELECT source_id || '|' || item_key AS url, item_key, title, content_hash AS hash FROM {_O}),
cn AS (SELECT source_id || '|' || item_key AS url, item_key, title, content_hash AS hash FROM {_N}),
ch AS (SELECT coalesce(co.url, cn.url) AS url, CASE WHEN cn.url IS NOT NULL THEN cn.title ELSE coalesce(co.title, 'Unknown') END AS title,
  CASE WHEN co.url IS NULL THEN 'NEW' WHEN cn.url IS NULL THEN CASE WHEN co.item_key NOT IN (SELECT url FROM crawl_state) THEN 'DELETED' ELSE 'RETAINED' END
       WHEN co.hash IS DISTINCT FROM cn.hash THEN 'MODIFIED' END AS change_type FROM co FULL JOIN cn ON co.url = cn.url)"""


def _regrouped(where: str) -> str:
    return f"""(SELECT source_id, item_key, string_agg(text, chr(10) || chr(10) ORDER BY n, id) AS text FROM (
      SELECT DISTINCT source_id, item_key, id, text, coalesce(try_cast(regexp_extract(id, '::([0-9]{{1,9}})::[^:]*$', 1) AS INT), 0) AS n FROM vectors
      WHERE item_key IS NOT NULL AND text IS NOT NULL {where}) GROUP BY 1, 2)"""


_DIGEST = f"md5(lower({bare(f'''regexp_replace(text, '{WS}+', ' ', 'g')''')}))"
_SLICES = f"""WITH RECURSIVE {_U},
z AS (SELECT source_id || '|' || item_key AS item_key, count(*)::INT AS n_chunks FROM u WHERE item_key IS NOT NULL GROUP BY 1),
o AS (SELECT item_key, n_chunks, row_number() OVER (ORDER BY n_chunks DESC, item_key) AS rank FROM z),
f AS (
  SELECT 0::BIGINT AS rank, NULL::VARCHAR AS item_key, 0 AS n_chunks, 0 AS slice, 0 AS nxt, 0 AS held, 0::BIGINT AS used, '' AS state
  UNION ALL
  SELECT o.rank, o.item_key, o.n_chunks, f.nxt,
    CASE WHEN NOT (§ > 0 AND f.used > 0 AND f.used + o.n_chunks > §) AND f.held + o.n_chunks >= 150 THEN f.nxt + 1 ELSE f.nxt END,
    CASE WHEN § > 0 AND f.used > 0 AND f.used + o.n_chunks > § THEN f.held WHEN f.held + o.n_chunks >= 150 THEN 0 ELSE f.held + o.n_chunks END,
    CASE WHEN § > 0 AND f.used > 0 AND f.used + o.n_chunks > § THEN f.used ELSE f.used + o.n_chunks END,
    CASE WHEN § > 0 AND f.used > 0 AND f.used + o.n_chunks > § THEN 'deferred' ELSE 'planned' END
  FROM f JOIN o ON o.rank = f.rank + 1)
SELECT item_key, n_chunks, CASE WHEN state = 'planned' THEN slice END AS slice, state FROM f WHERE rank > 0"""

QUERIES = {
    "delta_decide": delta_decide, "delta_reason_counts": delta_reason_counts, "confirm_unchanged": confirm_unchanged, "crawl_diff": crawl_diff, "changes_summary": changes_summary,
    "crawl_state_merge": crawl_state_merge, "knowledge_upsert": knowledge_upsert, "registry_record": registry_record, "registry_touch": registry_touch, "registry_fail": registry_fail,
    "registry_forget": registry_forget, "registry_backfill": registry_backfill, "registry_chunk_ids": registry_chunk_ids, "unique_chunks": unique_chunks,
    "append_anti_join": append_anti_join, "index_merge": index_merge, "latest_per_id": latest_per_id, "remap_sources": remap_sources, "pending_reembed": pending_reembed,
    "source_deleted": source_deleted, "commit_slices": commit_slices, "commit_slices_capped": commit_slices_capped, "request_batches": request_batches,
    "budget_prefix": budget_prefix, "cache_misses": cache_misses, "cache_hit_rate": cache_hit_rate, "cache_stored": cache_stored, "token_ledger": token_ledger,
    "budget_status": budget_status, "duplicate_digests": duplicate_digests, "duplicate_documents": duplicate_documents,
}

ORACLE = {
    "delta_decide": f"WITH {_DECIDE} SELECT source_id, item_key, content_hash, reason FROM dec",
    "delta_reason_counts": f"WITH {_DECIDE} SELECT reason, count(*) AS n FROM dec GROUP BY 1",
    "confirm_unchanged": f"""WITH {_DECIDE},
      live AS (SELECT source_id, item_key, list_sort(list(DISTINCT id)) AS ids, arg_min_null(content_hash, id) AS h FROM vectors WHERE item_key IS NOT NULL GROUP BY 1, 2),
      st AS (SELECT source_id, item_key, 'sha256:' || sha256({bare('text')}) AS h, length({bare('text')}) > 0 AS has FROM {_regrouped('')}),
      rb AS (SELECT source_id, item_key, list_sort(list_distinct(list_filter(chunk_ids, lambda x: x IS NOT NULL))) AS ids FROM n),
      j AS (SELECT dec.*, live.ids AS lids, live.h AS lh, st.h AS sh, st.has, rb.ids AS nids FROM dec LEFT JOIN live USING (source_id, item_key) LEFT JOIN st USING (source_id, item_key) LEFT JOIN rb USING (source_id, item_key)),
      r AS (SELECT source_id, item_key, CASE WHEN reason = 'unchanged' THEN CASE WHEN lids IS NOT NULL THEN 'unchanged' ELSE 'vectors-missing' END
          WHEN lids IS NOT NULL AND has AND sh = content_hash THEN 'already-indexed-unchanged' WHEN lids IS NOT NULL AND lh = content_hash THEN 'already-indexed-live-hash-match'
          WHEN lids IS NOT NULL AND len(nids) > 0 AND nids = lids THEN 'already-indexed-exact-chunks-match' ELSE reason END AS reason FROM j)
      SELECT source_id, item_key, reason, NOT starts_with(reason, 'already-indexed') AND reason <> 'unchanged' AS changed FROM r""",
    "crawl_diff": f"WITH {_CRAWL} SELECT url, title, change_type FROM ch WHERE change_type IS NOT NULL",
    "changes_summary": f"""WITH {_CRAWL}, k AS (SELECT count(*) FILTER (change_type = 'NEW') AS a, count(*) FILTER (change_type = 'MODIFIED') AS b, count(*) FILTER (change_type = 'DELETED') AS c, count(change_type) AS n FROM ch)
      SELECT CASE WHEN n = 0 THEN 'No changes detected. Website content is up to date.' WHEN a + b + c = 0 THEN 'No content changes detected. Knowledge base already up to date.'
        ELSE 'Changes detected: ' || concat_ws(', ', CASE WHEN a > 0 THEN a || ' new page' || CASE WHEN a > 1 THEN 's' ELSE '' END || ' discovered' END,
          CASE WHEN b > 0 THEN b || ' updated page' || CASE WHEN b > 1 THEN 's' ELSE '' END END, CASE WHEN c > 0 THEN c || ' deleted page' || CASE WHEN c > 1 THEN 's' ELSE '' END || ' purged' END) END AS summary FROM k""",
    "crawl_state_merge": f"""WITH {_CRAWL} SELECT url, hash FROM cn UNION ALL
      SELECT url, hash FROM co WHERE url NOT IN (SELECT url FROM cn) AND url NOT IN (SELECT url FROM ch WHERE change_type = 'DELETED')""",
    "knowledge_upsert": f"""WITH a AS (SELECT source_id, item_key, md5({bare('text')}) AS h FROM {_regrouped(f"AND created_at < {_THEN}")}),
      b AS (SELECT source_id, item_key, CASE WHEN length({bare('text')}) > 0 THEN md5({bare('text')}) END AS h FROM {_regrouped('')}),
      j AS (SELECT source_id, item_key, a.h AS ah, b.h AS bh, CASE WHEN a.h IS NULL THEN CASE WHEN b.h IS NOT NULL THEN 'new' END WHEN b.h IS NULL THEN 'kept' WHEN a.h = b.h THEN 'unchanged' ELSE 'updated' END AS change
            FROM a FULL JOIN b USING (source_id, item_key))
      SELECT source_id, item_key, item_key AS title, CASE WHEN change IN ('new', 'updated') THEN bh ELSE ah END AS hash,
        CASE WHEN change = 'new' THEN TIMESTAMP '{NOW}' ELSE {_THEN} END AS first_seen, CASE WHEN change = 'kept' THEN {_THEN} ELSE TIMESTAMP '{NOW}' END AS last_seen,
        CASE WHEN change IN ('new', 'updated') THEN TIMESTAMP '{NOW}' ELSE {_THEN} END AS updated, change FROM j WHERE change IS NOT NULL""",
    "registry_record": f"""WITH o AS {_O}, n AS {_N}
      SELECT n.source_id, n.item_key, coalesce(n.title, o.title, n.item_key) AS title, n.content_hash, coalesce(len(n.chunk_ids), 0)::INT AS chunk_count, coalesce(n.token_count, 0) AS token_count,
        coalesce(o.first_seen::TIMESTAMP, TIMESTAMP '{NOW}') AS first_seen, coalesce(o.revision, 0) + 1 AS revision
      FROM n LEFT JOIN o USING (source_id, item_key) WHERE n.status = 'indexed'""",
    "registry_touch": f"""WITH {_DECIDE} SELECT o.source_id, o.item_key, CASE WHEN d.reason IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE o.last_scraped::TIMESTAMP END AS last_scraped,
        CASE WHEN d.reason IS NOT NULL THEN 'indexed' ELSE o.status END AS status FROM o LEFT JOIN (SELECT * FROM dec WHERE reason = 'unchanged') d USING (source_id, item_key)""",
    "registry_fail": f"""WITH o AS {_O}, b AS (SELECT source_id, item_key, left(failure_reason, 300) AS r FROM {_N} WHERE failure_reason IS NOT NULL)
      SELECT source_id, item_key, CASE WHEN b.r IS NOT NULL THEN 'failed' ELSE o.status END AS status, CASE WHEN b.r IS NOT NULL THEN b.r ELSE o.failure_reason END AS failure_reason FROM o FULL JOIN b USING (source_id, item_key)""",
    "registry_forget": f"WITH o AS {_O}, n AS {_N} SELECT source_id, item_key FROM o ANTI JOIN n USING (source_id, item_key)",
    "registry_backfill": f"""WITH {_U}, o AS {_O},
      g AS (SELECT source_id, item_key, arg_min_null(source_name, id) AS nm, arg_min_null(content_hash, id) AS ch, arg_min_null(embed_provider, id) AS ep, count(DISTINCT id)::INT AS chunk_count, sum(coalesce(tokens, 0))::BIGINT AS token_count
            FROM u WHERE item_key IS NOT NULL GROUP BY 1, 2)
      SELECT source_id, item_key, coalesce(nm, item_key) AS title, coalesce(ch, '') AS content_hash, chunk_count, token_count, coalesce(ep, 'legacy:unknown') AS embed_provider, 1 AS revision
      FROM g ANTI JOIN (SELECT * FROM o WHERE len(chunk_ids) > 0) x USING (source_id, item_key)""",
    "registry_chunk_ids": f"SELECT DISTINCT c AS chunk_id FROM (SELECT unnest(chunk_ids) AS c FROM {_O}) WHERE c IS NOT NULL",
    "unique_chunks": f"WITH {_U} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source_id, item_key, {_DIGEST} ORDER BY id) AS n FROM u) WHERE n = 1",
    "append_anti_join": f"""WITH {_U}, l AS (SELECT id, {_DIGEST} AS dg FROM u WHERE created_at < {_THEN}),
      n AS (SELECT id, {_DIGEST} AS dg, row_number() OVER (PARTITION BY source_id, item_key, {_DIGEST} ORDER BY id) AS k FROM u WHERE created_at >= {_THEN})
      SELECT id FROM n WHERE k = 1 AND id NOT IN (SELECT id FROM l) AND dg NOT IN (SELECT dg FROM l)""",
    "index_merge": "SELECT DISTINCT id FROM vectors UNION SELECT DISTINCT id FROM vectors_prior",
    "latest_per_id": f"WITH {_U} SELECT id, updated_at::TIMESTAMP AS updated_at FROM u",
    "remap_sources": """SELECT DISTINCT CASE WHEN source_id = 'website' THEN CASE WHEN starts_with(id, 'website::') THEN 'site-main::' || substr(id, 10) ELSE 'site-main::' || id END ELSE id END AS id,
      CASE WHEN source_id = 'website' THEN 'site-main' ELSE source_id END AS source_id FROM vectors""",
    "pending_reembed": f"WITH {_U} SELECT id, embed_provider FROM u WHERE embed_provider IS DISTINCT FROM '{PROVIDER}'",
    "source_deleted": "SELECT DISTINCT id FROM vectors WHERE source_id <> 'website'",
    "commit_slices": _SLICES.replace("§", "0"),
    "commit_slices_capped": _SLICES.replace("§", "600"),
    "request_batches": """WITH RECURSIVE o AS (SELECT source, doc_id AS pos, least(floor(n_chars / 4), 500)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
      f AS (SELECT source, pos, n, rank, 0 AS batch, 1 AS texts, n AS held FROM o WHERE rank = 1
        UNION ALL SELECT o.source, o.pos, o.n, o.rank, CASE WHEN f.texts >= 20 OR f.held + o.n > 4000 THEN f.batch + 1 ELSE f.batch END,
          CASE WHEN f.texts >= 20 OR f.held + o.n > 4000 THEN 1 ELSE f.texts + 1 END, CASE WHEN f.texts >= 20 OR f.held + o.n > 4000 THEN o.n ELSE f.held + o.n END
        FROM f JOIN o ON o.source = f.source AND o.rank = f.rank + 1)
      SELECT source, pos, n AS n_tokens, batch FROM f""",
    "budget_prefix": """WITH s AS (SELECT snapshot_no AS slice, sum(coalesce(token_count, 0))::BIGINT AS miss_tokens FROM ingestion_registry GROUP BY 1)
      SELECT slice, miss_tokens, sum(miss_tokens) OVER (ORDER BY slice)::BIGINT AS running, sum(miss_tokens) OVER (ORDER BY slice) <= 150000 AS affordable FROM s""",
    "cache_misses": f"""WITH t AS (SELECT weekofyear(created_at)::INT AS slice, sha1(text) AS fp, length(text) AS n FROM vectors),
      c AS (SELECT DISTINCT sha1(text) AS fp FROM vectors WHERE created_at < {_THEN} AND tokens IS NOT NULL),
      m AS (SELECT slice, n, min(slice) OVER (PARTITION BY fp) AS first FROM t WHERE fp NOT IN (SELECT fp FROM c))
      SELECT slice, coalesce((SELECT sum(n) FROM m WHERE m.slice = s.slice AND m.first = s.slice), 0)::BIGINT AS miss_tokens FROM (SELECT DISTINCT slice FROM t) s""",
    "cache_hit_rate": f"""WITH c AS (SELECT DISTINCT sha1(text) AS fp FROM vectors WHERE created_at < {_THEN}), h AS (SELECT sha1(text) IN (SELECT fp FROM c) AS hit FROM vectors)
      SELECT count(*) FILTER (hit) AS hits, count(*) AS total, round(count(*) FILTER (hit) / count(*)::DOUBLE, 3) AS rate FROM h""",
    "cache_stored": f"SELECT DISTINCT '{PROVIDER}' AS space, sha1(text) AS fp FROM vectors",
    "token_ledger": "SELECT ts::DATE AS day, sum(floor(value))::BIGINT AS tokens, count(*) AS requests, 0::BIGINT AS cached_tokens FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 60",
    "budget_status": """WITH l AS (SELECT ts::DATE AS day, sum(floor(value))::BIGINT AS tokens FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 60)
      SELECT day, tokens AS spent, greatest(0, 4000 - tokens)::BIGINT AS remaining, tokens >= 4000 AS exhausted FROM l""",
    "duplicate_documents": f"SELECT doc_id, n FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_DIGEST} ORDER BY doc_id)::INT AS n FROM documents) WHERE n > 1",
    "duplicate_digests": f"WITH {_U} SELECT id, source_id, n FROM (SELECT id, source_id, row_number() OVER (PARTITION BY source_id, {_DIGEST} ORDER BY id)::INT AS n FROM u) WHERE n > 1",
}
