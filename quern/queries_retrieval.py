"""Queries of retrieval and of the reports, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vectors import fitted
from quern.operators import answers as A
from quern.operators import reports as R
from quern.operators import retrieval as Q
from quern.operators.sessions import sessions
from quern.queries_delta import _N, _O, _U, NEW, OLD, PROVIDER, _registry, _unique, _vectors
from quern.queries_text import _PATH, filter_stems_sql, stems_sql, terms_sql
from quern.operators.store import VersionedStore
from quern.session import materialise, read_table, scratch_path
from quern.sources.readers import csv_sections as sections_of_rows
from quern.streaming.ingest import SessionWindow, deduplicated, run_available, windowed_counts


def _queries(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: the titles of documents whose id is divisible by 100."""
    return read_table(s, d, "documents").where("doc_id % 100 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _chunks(s, d):
    """A row for each id. Written once: it is read for each kind of score, and for the texts of the pools."""
    m = lambda k: F.element_at("metadata", F.lit(k))
    return materialise(
        _unique(s, d).select(
            "id", "source_id", "source_name", "item_key", "text", m("title").alias("title"), m("section_title").alias("section"), Q.hit_time().alias("ts"), Q.hit_time().alias("time")
        ),
        "chunks",
    )


def retrieve_dense_topk(s, d):
    rows = read_table(s, d, "embeddings").where("embedding is not null")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit("all").alias("space"), F.col("embedding").alias("vector"))
    return Q.vector_topk(asked, rows.select(F.col("vec_id").alias("id"), F.lit("all").alias("space"), F.col("embedding").alias("vector")), 10).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def retrieve_in_space(s, d):
    rows = read_table(s, d, "embeddings").where("embedding is not null")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("space"), F.col("embedding").alias("vector"))
    return Q.vector_topk(asked, rows.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("space"), F.col("embedding").alias("vector")), 5).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def retrieve_dense_text(s, d):
    return Q.text_scores(_queries(s, d), _chunks(s, d), 40, unique=True).select("query_id", "id", F.round("dense", 5).alias("dense"))


def _pool(s, d):
    asked, chunks = _queries(s, d), _chunks(s, d)
    dense = Q.text_scores(asked, chunks, max(40, Q.pool_size()), unique=True)
    return asked, chunks, Q.pool(Q.hybrid_candidates(asked, chunks, dense, Q.TOP_K))


def hybrid_score(s, d):
    asked, chunks = _queries(s, d), _chunks(s, d)
    return Q.hybrid_candidates(asked, chunks, Q.text_scores(asked, chunks, 40, unique=True)).select("query_id", "id", "kw", "title_hits", "score")


def retrieve_capped(s, d):
    return _pool(s, d)[2].select("query_id", "id", "pos", "score")


def _reranked(s, d):
    asked, chunks, pooled = _pool(s, d)
    return asked, Q.rerank(pooled, asked, chunks)


def rerank(s, d):
    return _reranked(s, d)[1].select("query_id", "id", "rank", "rerank_score")


def relevance_filter(s, d):
    asked, hits = _reranked(s, d)
    return Q.relevant(hits, asked).select("query_id", "id", "place")


def citations(s, d):
    asked, hits = _reranked(s, d)
    return A.citations(Q.relevant(hits, asked))


def synthesis(s, d):
    asked, hits = _reranked(s, d)
    return A.answers(Q.relevant(hits, asked), asked)


def vocabulary(s, d):
    return Q.vocabulary(_vectors(s, d))


def spell_correct(s, d):
    words = Q.vocabulary(_vectors(s, d))
    stems = read_table(s, d, "eval_items").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("stem")).distinct()
    return Q.corrected_terms(stems, words)


def space_stats(s, d):
    return R.store_stats(_vectors(s, d), PROVIDER)


def source_stats(s, d):
    return R.source_stats(_unique(s, d))


def registry_stats(s, d):
    return R.registry_stats(read_table(s, d, "ingestion_registry"), ["snapshot_no", "source_id"])


def provider_counts(s, d):
    return R.provider_counts(_registry(s, d, NEW))


def knowledge_stats(s, d):
    return R.knowledge_stats(read_table(s, d, "documents"), "source", "text")


def source_catalogue(s, d):
    return R.catalogue(_unique(s, d))


def grand_totals(s, d):
    return R.grand_totals(_unique(s, d))


def source_top_samples(s, d):
    return R.first_of_group(read_table(s, d, "documents").select("source", "doc_id", "title"), ["source"], [F.col("doc_id")], 5)


def _pages(s, d):
    rows = read_table(s, d, "crawl_state")
    return rows.groupBy("url").agg(F.max("title").alias("title"), F.max("length").alias("length"), F.max("hash").alias("hash"))


def page_categories(s, d):
    return R.page_categories(_pages(s, d))


def clean_titles(s, d):
    p = _pages(s, d)
    return p.select("url", R.clean_title(F.col("title"), F.col("url")).alias("title"), R.chunk_estimate(F.lit(None).cast("int"), F.col("length")).alias("estimate"))


def union_page_sources(s, d):
    crawl = _pages(s, d).select("url", F.lit("crawl").alias("origin"))
    registry = _registry(s, d, NEW).where("item_key like 'http%'").select(F.col("item_key").alias("url"), F.lit("registry").alias("origin")).distinct()
    store = _unique(s, d).where("item_key like 'http%'").select(F.col("item_key").alias("url"), F.lit("store").alias("origin")).distinct()
    return R.by_priority([crawl, registry, store], "url")


def document_merge(s, d):
    docs = _unique(s, d).where("source_type = 'document'").groupBy(F.col("source_id").alias("id")).agg(F.min("source_name").alias("name"))
    listed = read_table(s, d, "ingestion_registry").groupBy(F.col("source_id").alias("id")).agg(F.min("source_id").alias("name"))
    return R.merged_documents([docs, listed])


def page_listing(s, d):
    """Four sources: knowledge texts, the crawl's state, chunks in the store, and the listing before."""
    of_site = F.col("source_id") == "website"
    texts = R.regrouped_text(_vectors(s, d).where(of_site)).select(F.col("item_key").alias("url"), F.lit(None).cast("string").alias("title"), F.length("text").alias("chars"), F.lit(0).alias("n_chunks"))
    state = read_table(s, d, "crawl_state").select("url", "title", F.col("length").alias("chars"), F.lit(0).alias("n_chunks"))
    store = _unique(s, d).where(of_site).select(F.col("item_key").alias("url"), F.element_at("metadata", F.lit("title")).alias("title"), F.length("text").alias("chars"), F.lit(1).alias("n_chunks"))
    prior = read_table(s, d, "vectors_prior").where(of_site).select(F.col("item_key").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("chars"), F.lit(1).alias("n_chunks"))
    return R.page_listing([texts, state, store, prior])


def catalogue_search(s, d):
    return R.found_pages(page_listing(s, d), "course").select("url", "title")


def document_listing(s, d):
    """Six places: history, knowledge, chunks, the listing before, the uploads, and the list that is to be repaired."""
    named = lambda rows, i, n: rows.groupBy(F.col(i).cast("string").alias("id")).agg(F.min(n).alias("name"))
    history = named(_registry(s, d, OLD).where("status = 'indexed'"), "source_id", "source_id")
    knowledge = named(_registry(s, d, NEW), "source_id", "source_id")
    chunks = named(_unique(s, d).where("source_type = 'document'"), "source_id", "source_name")
    prior = named(read_table(s, d, "vectors_prior"), "source_id", "source_id")
    uploads = named(_vectors(s, d).where("source_type = 'document' and source_name is not null"), "source_name", "source_name")
    return R.document_listing([history, knowledge, chunks, prior, uploads])


def last_runs(s, d):
    runs = read_table(s, d, "ingestion_registry").groupBy(F.col("snapshot_no").alias("id")).agg(F.max("snapshot_at").alias("ts"), F.count("*").alias("n"))
    return R.last_runs(runs, read_table(s, d, "crawl_state"))


def last_runs_legacy(s, d):
    none = s.createDataFrame([], "id string, ts timestamp, n long")
    return R.last_runs(none, read_table(s, d, "crawl_state"))


def origin_counts(s, d):
    return R.origin_counts(_vectors(s, d).select(F.coalesce("source_type", F.lit("default")).alias("origin")))


def pagination(s, d):
    return R.page_of(read_table(s, d, "documents").select("doc_id", "title"), [F.col("doc_id")], 3).select("doc_id", "position")


def run_log(s, d):
    runs = read_table(s, d, "ingestion_registry").groupBy(F.col("snapshot_no").alias("id")).agg(F.max("snapshot_at").alias("ts"), F.count("*").alias("n"))
    return R.run_log(runs, 3)


def status_repair(s, d):
    rows = _registry(s, d, NEW).select(F.concat_ws("|", "source_id", "item_key").alias("id"), F.when(F.col("status") == "failed", "Processing").otherwise(F.col("status")).alias("status"), "chunk_count")
    return R.repaired_status(rows, rows.where("chunk_count > 8"))


def crawl_bfs(s, d):
    # The tree of paths: each page hangs from the folder it lies in.
    pages = read_table(s, d, "crawl_state").select(F.regexp_replace(F.lower(F.trim("url")), "/$", "").alias("dst")).distinct()
    levels = pages.select("dst", F.regexp_replace("dst", "/[^/]*$", "").alias("src"))
    folders = levels.select(F.col("src").alias("dst")).distinct().select("dst", F.regexp_replace("dst", "/[^/]*$", "").alias("src"))
    edges = levels.unionByName(folders).where("src <> dst and length(src) > 8")
    seeds = edges.select(F.col("src").alias("url")).distinct().join(edges.select(F.col("dst").alias("url")).distinct(), "url", "left_anti")
    return R.reachable(edges, seeds, 4)


def session_ttl(s, d):
    return sessions(read_table(s, d, "events"), "user_id", "ts")


def csv_sections(s, d):
    return sections_of_rows(read_table(s, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"], "c_nationkey")


def regrouped(s, d):
    return R.regrouped_text(_vectors(s, d)).select("source_id", "item_key", F.md5("text").alias("text_md5"))


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    """The table may be a file or a folder of files; a path with a pattern stands for either."""
    schema = read_table(s, d, "events").schema
    return s.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _collected(s: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives when it is read to its end, gathered batch by batch in the shared folder."""
    base = scratch_path(s, name)
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{base}/out")


def stream_dedupe(s, d):
    """Distinct keys of a stream: near repeats are dropped by state of a day, far ones by the table of keys seen."""
    store = VersionedStore(s, scratch_path(s, "seen"))

    def step(batch: DataFrame, number: int) -> None:
        seen = store.read()
        new = batch.distinct()
        store.append(new if seen is None else new.join(seen, ["user_id", "event_type"], "left_anti"), number)

    run_available(deduplicated(_event_stream(s, d), ["user_id", "event_type"], "ts", "1 day").select("user_id", "event_type"), step, scratch_path(s, "seen-state"))
    return store.read()


def stream_windows(s, d):
    """Counts of closed daily windows: a window is given out once the watermark has passed its end."""
    return _collected(s, windowed_counts(_event_stream(s, d), "ts", ["event_type"], "1 day", "0 seconds"), "windows")


def stream_batches(s, d):
    """Rows by user: each micro-batch appends its sums under its number, so one that is repeated counts once."""
    store = VersionedStore(s, scratch_path(s, "sums"))
    step = lambda batch, number: store.append(batch.groupBy("user_id").agg(F.count("*").alias("n")), number)
    run_available(_event_stream(s, d), step, scratch_path(s, "sums-state"))
    return store.read().groupBy("user_id").agg(F.sum("n").alias("n"))


def stream_sessions(s, d):
    window = SessionWindow(s, scratch_path(s, "sessions"))
    run_available(_event_stream(s, d).select("user_id", "event_id", "ts"), window.step, scratch_path(s, "sessions-state"))
    return window.read()


def vector_fit(s, d):
    return _vectors(s, d).where("embedding is not null").select("id", F.size(fitted(F.col("embedding"), 32)).alias("n")).distinct()


_STEP = (1 << 32) % 768
_TEXT_SCORES = rf"""{_U},
ask AS (SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
c AS (SELECT id, source_id, source_name, item_key, text, metadata['title'] AS title, metadata['section_title'] AS section, coalesce(updated_at, created_at) AS ts, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS dw FROM u),
tok AS (SELECT 'q' AS kind, query_id::VARCHAR AS k, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+') AS w FROM ask UNION ALL SELECT 'c', id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') FROM c),
ex AS (SELECT kind, k, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM tok),
word AS (SELECT DISTINCT token, md5(token) AS h FROM ex),
place AS (SELECT token, list_reduce([0::BIGINT] || list_transform(range(4), lambda i: ('0x' || substr(h, (i * 8 + 1)::INT, 8))::BIGINT), lambda a, b: (a * {_STEP} + b) % 768)::INT AS bucket,
  (CASE WHEN ('0x' || substr(h, 31, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS sg FROM word),
bw AS (SELECT kind, k, bucket, sum(sg / sqrt(pos)) AS w FROM ex JOIN place USING (token) GROUP BY ALL),
nw AS (SELECT kind, k, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY kind, k)) AS w FROM bw),
sc AS (SELECT a.k::BIGINT AS query_id, b.k AS id, sum(a.w * b.w) AS s FROM nw a JOIN nw b ON a.kind = 'q' AND b.kind = 'c' AND a.bucket = b.bucket GROUP BY 1, 2),
dense AS (SELECT query_id, id, greatest(0, least(1, s)) AS dense FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS n FROM sc) WHERE n <= 40 AND s > 0.15)
"""
#: A stem begins a word: the words of a text are listed once, as a pattern for each pair would be compiled anew.
_BEGINS = "len(list_filter({w}, lambda w: starts_with(w, s))) > 0"
_HYBRID = (
    _TEXT_SCORES
    + rf""", st AS (SELECT query_id, query, {stems_sql('query')} AS stems FROM ask),
h0 AS (SELECT st.query_id, st.stems, c.*, coalesce(d.dense, 0) AS dense,
  len(list_filter(st.stems, lambda s: {_BEGINS.format(w='c.dw')})) AS kw,
  len(list_filter(st.stems, lambda s: contains(lower(concat_ws(' ', coalesce(c.source_name, ''), coalesce(c.title, ''))), s))) AS title_hits
  FROM c CROSS JOIN st LEFT JOIN dense d ON d.query_id = st.query_id AND d.id = c.id),
hy AS (SELECT *, round(dense * 0.85::DOUBLE + least(kw * 0.025::DOUBLE, 0.10::DOUBLE) + least(title_hits * 0.035::DOUBLE, 0.07::DOUBLE), 4) AS score FROM h0
  WHERE dense > 0 OR title_hits > 0 OR kw >= 2 OR (len(stems) = 1 AND kw >= 1 AND length(stems[1]) >= 4)),
p0 AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id, source_id, item_key ORDER BY score DESC, round(dense, 9) DESC, id) AS n FROM hy),
po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round(dense, 9) DESC, id) AS pos FROM p0 WHERE best >= 0.28 AND n <= 3) WHERE pos <= 25)
"""
)
_RERANK = (
    _HYBRID
    + rf""", tm AS (SELECT query_id, lower(query) AS lq, {terms_sql('query')} AS terms FROM ask),
t2 AS (SELECT query_id, lq, terms, list_transform(terms, lambda w: CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END) AS rs FROM tm),
r0 AS (SELECT po.*, t2.lq, t2.terms, t2.rs, epoch(ts) AS t, count(*) OVER (PARTITION BY po.query_id) AS alone,
  round((round(dense, 4) * 0.70::DOUBLE + score * 0.15::DOUBLE
    + least(len(list_filter(list_distinct(rs), lambda s: {_BEGINS.format(w='dw')})) / greatest(len(rs), 1)::DOUBLE * 0.15::DOUBLE, 0.15::DOUBLE)
    + CASE WHEN len(terms) >= 2 AND contains(lower(text), array_to_string(terms[1:4], ' ')) THEN 0.12::DOUBLE ELSE 0 END
    + least(len(list_filter(rs, lambda s: contains(lower(coalesce(source_name, '')), s) OR contains(lower(coalesce(section, '')), s))) * 0.05::DOUBLE, 0.10::DOUBLE)
    + CASE WHEN regexp_matches(lq, '[\p{{Nd}}₹$€%]') AND regexp_matches(lower(text), '[\p{{Nd}}₹$€%]') THEN 0.08::DOUBLE ELSE 0 END)
    * CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 80 THEN 0.70::DOUBLE ELSE 1 END, 4) AS rr
  FROM po JOIN t2 USING (query_id)),
r1 AS (SELECT *, max(CASE WHEN rr > 0.2 THEN t END) OVER (PARTITION BY query_id) AS last FROM r0),
r2 AS (SELECT *, CASE WHEN alone = 1 THEN score ELSE round(rr + CASE WHEN last > 0 AND t >= last - 3600 AND rr > 0.25 THEN 0.08::DOUBLE ELSE 0 END, 4) END AS rerank_score FROM r1),
re AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, t DESC, pos) AS rank FROM r2) WHERE rank <= 6)
"""
)
_RELEVANT = (
    _RERANK
    + rf""", fs AS (SELECT query_id, {filter_stems_sql('query')} AS f FROM ask),
v0 AS (SELECT re.*, len(list_filter(f, lambda s: contains(lower(concat_ws(' ', coalesce(source_name, ''), coalesce(section, ''))), s) OR (length(s) >= 4 AND contains(lower(concat_ws(' ', coalesce(source_name, ''), coalesce(section, ''))), left(s, 4))))) AS th,
  len(list_filter(f, lambda s: contains(lower(text), s) OR (length(s) >= 4 AND contains(lower(text), left(s, 4))))) AS xh FROM re JOIN fs USING (query_id)),
v1 AS (SELECT *, max(CASE WHEN rank = 1 THEN rerank_score END) OVER (PARTITION BY query_id) AS top, max(th) OVER (PARTITION BY query_id) AS mt, max(xh) OVER (PARTITION BY query_id) AS mx, count(*) OVER (PARTITION BY query_id) AS cn FROM v0),
v2 AS (SELECT *, cn = 1 OR NOT ((mt >= 1 AND th = 0 AND ((mx >= 3 AND xh < greatest(2, floor(mx * 0.45::DOUBLE))) OR (top > 0.4 AND rerank_score < top * 0.60::DOUBLE))) OR (top > 0.4 AND rerank_score < top * 0.50::DOUBLE AND th = 0)) AS keep FROM v1),
v3 AS (SELECT *, sum(keep::INT) OVER (PARTITION BY query_id) AS kept FROM v2),
rv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM v3 WHERE keep OR (kept = 0 AND rank = 1))
"""
)
_CASES = " ".join(
    "WHEN " + " OR ".join(f"contains(b, '{w}')" for w in words) + f" THEN '{name}'" for name, words in R.CATEGORIES
)
_PAGES = "pg AS (SELECT url, max(title) AS title, max(length) AS length FROM crawl_state GROUP BY 1)"
_REG5 = """(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, item_key ORDER BY delivered_at DESC, content_hash DESC NULLS LAST, status DESC NULLS LAST) AS rn
           FROM ingestion_registry WHERE snapshot_no = (SELECT max(snapshot_no) FROM ingestion_registry)) WHERE rn = 1)"""

_TITLE_OF = rf"""CASE WHEN lower(trim(coalesce(title, ''))) NOT IN ('', 'none', 'null', 'unknown', 'about us', 'about', 'home', 'welcome') THEN trim(coalesce(title, ''))
  WHEN {{seg}} <> '' THEN array_to_string(list_transform(string_split({{seg}}, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') ELSE 'Page' END"""
_SEGMENT = rf"regexp_replace(regexp_replace(regexp_extract(regexp_replace({_PATH}, '/+$', ''), '([^/]*)$', 1), '\.(php|html?)$', ''), '[-_]+', ' ', 'g')"
_PAGE_LIST = rf"""{_U},
tx AS (SELECT source_id, item_key, string_agg(text, chr(10) || chr(10) ORDER BY n, id) AS text FROM (SELECT DISTINCT source_id, item_key, id, text, coalesce(try_cast(regexp_extract(id, '::([0-9]{{1,9}})::[^:]*$', 1) AS INT), 0) AS n
  FROM vectors WHERE item_key IS NOT NULL AND text IS NOT NULL AND source_id = 'website') GROUP BY 1, 2),
al AS (SELECT item_key AS url, NULL::VARCHAR AS title, length(text) AS chars, 0 AS n, 0 AS origin FROM tx UNION ALL SELECT url, title, length, 0, 1 FROM crawl_state
  UNION ALL SELECT item_key, metadata['title'], length(text), 1, 2 FROM u WHERE source_id = 'website' UNION ALL SELECT item_key, NULL, 0, 1, 3 FROM vectors_prior WHERE source_id = 'website'),
ag AS (SELECT url, min({{'o': origin, 't': coalesce(title, '')}}) AS f, min(CASE WHEN chars > 0 THEN {{'o': origin, 'c': -chars}} END) AS l, sum(n) AS n FROM al WHERE url IS NOT NULL AND url <> '' GROUP BY 1),
p1 AS (SELECT url, f.t AS title, coalesce(-(l.c), 0)::BIGINT AS chars, n, f.o AS origin FROM ag),
pl AS (SELECT url, {_TITLE_OF.format(seg=_SEGMENT)} AS title, chars, CASE WHEN n > 0 THEN n WHEN chars > 0 THEN greatest(1, floor(chars / 500)) ELSE 0 END::BIGINT AS chunks, origin FROM p1)
"""
_LISTING = rf"""{_U}, o AS {_O}, n AS {_N},
s0 AS (SELECT source_id AS id, min(source_id) AS name FROM o WHERE status = 'indexed' GROUP BY 1), s1 AS (SELECT source_id AS id, min(source_id) AS name FROM n GROUP BY 1),
s2 AS (SELECT source_id AS id, min(source_name) AS name FROM u WHERE source_type = 'document' GROUP BY 1), s3 AS (SELECT source_id AS id, min(source_id) AS name FROM vectors_prior GROUP BY 1),
s4 AS (SELECT source_name AS id, min(source_name) AS name FROM vectors WHERE source_type = 'document' AND source_name IS NOT NULL GROUP BY 1)
""" + "".join(
    f""", k{i} AS (SELECT *, lower(trim(coalesce(id, ''))) AS a, lower(trim(name)) AS b FROM (SELECT id, coalesce(name, id) AS name FROM s{i})),
n{i} AS (SELECT * FROM k{i} WHERE (a <> '' OR b <> '') {"".join(f"AND a NOT IN (SELECT k FROM g{j}) AND b NOT IN (SELECT k FROM g{j}) " for j in range(i))}),
m{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY a, id, name) AS x FROM n{i}) WHERE a = '' OR x = 1),
r{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY a, id, name) AS y FROM m{i}) WHERE b = '' OR y = 1),
g{i} AS (SELECT a AS k FROM r{i} WHERE a <> '' UNION SELECT b FROM r{i} WHERE b <> '')"""
    for i in range(5)
)
_SINGULAR = "CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"
_ASKED_FOR = lambda words: rf"regexp_matches(q, '(^|[^a-z0-9_])({words})($|[^a-z0-9_])')"
_LABEL = A._LABEL.replace("\t", "\\t")
_NAME = rf"^(({A.TITLES})[.]?[ \t]+[A-Za-z .''’]+?)([ \t,:(–-].*)$"
_TITLED = """({t} <> '' AND {n} <> '' AND (contains({n}, {t}) OR contains({t}, {n}) OR {t} = array_to_string(list_transform({p}, lambda w: left(w, 1)), '')
  OR {t} = array_to_string(list_transform(list_filter({p}, lambda w: w NOT IN {small}), lambda w: left(w, 1)), '') OR (length({t}) >= 3 AND len(list_filter({p}, lambda w: starts_with(w, {t}))) > 0)))"""
_titled = lambda name: _TITLED.format(t="s", n=f"lower(trim({name}))", p=f"regexp_extract_all(lower(trim({name})), '[a-z]+')", small=A.SMALL_WORDS)
_MARKS = A.MARKS.replace("\t", "\\t")
_SYNTHESIS = (
    _RELEVANT
    + rf""", a0 AS (SELECT query_id, lower(query) AS q, regexp_extract_all(lower(query), '[a-z0-9_-]+') AS f FROM ask),
a1 AS (SELECT *, list_filter(f, lambda w: NOT regexp_full_match(w, '[0-9]+')) AS spoken FROM a0),
a2 AS (SELECT *, list_filter(spoken, lambda w: length(w) >= 2 AND w NOT IN {A.FILLERS}) AS topical,
  regexp_extract(q, '(^|[^a-z0-9_])([0-9]{{1,4}}) *(line|point|bullet|sentence|item|entry|detail)s?($|[^a-z0-9_])', 2) AS number,
  {_ASKED_FOR('one +line|single +(sentence|line|point)|in +(a +word|short|nutshell)')} AS one, {_ASKED_FOR('brief|briefly|summary|concise|overview')} AS brief,
  {_ASKED_FOR('all|every|entire|complete|whole|full|roster')} AS everything FROM a1),
qu AS (SELECT query_id, one, list_transform(CASE WHEN len(topical) > 0 THEN topical ELSE spoken END, lambda w: {_SINGULAR}) AS stems,
  CASE WHEN number <> '' THEN number::INT WHEN one THEN 1 WHEN brief THEN {A.BRIEF} WHEN everything THEN {A.COMPLETE} ELSE {A.USUAL} END AS n_lines,
  CASE WHEN everything AND NOT brief AND NOT one THEN {A.SOURCES} ELSE 1 END AS n_sources FROM a2),
ht AS (SELECT rv.query_id, row_number() OVER (PARTITION BY rv.query_id ORDER BY rank) AS nth, text, ts AS time, coalesce(nullif(source_name, ''), 'Records') AS source, coalesce(section, '') AS sect, qu.stems
  FROM rv JOIN qu ON qu.query_id = rv.query_id WHERE place <= 6),
l0 AS (SELECT *, len(list_filter(stems, lambda s: {_titled('source')} OR {_titled('sect')})) > 0 AS is_topic,
  list_filter(list_transform(string_split_regex(text, '\r\n|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM ht WHERE nth <= {A.HITS}),
l1 AS (SELECT * EXCLUDE (ls), flatten(list_transform(ls, lambda x: CASE WHEN length(x) <= {A.LONG_LINE} OR regexp_matches(x, '^[-*•0-9|]') THEN [x]
  ELSE list_filter(list_transform(string_split(regexp_replace(regexp_replace(x, '(^|[^A-Za-z.])({A.ABBREVIATIONS})[.][ \t]+', '\1\2.␟', 'g'), '([.!?])[ \t]+', '\1{A.CUT}', 'g'), '{A.CUT}'), lambda y: trim(replace(y, '␟', ' '))), lambda y: length(y) > 15) END)) AS ls FROM l0),
l2 AS (SELECT * EXCLUDE (ls), unnest(ls) AS line, unnest(range(len(ls))) AS place FROM l1),
l3 AS (SELECT query_id, source, time, line, nth * 1000000 + place AS pos, is_topic, lower(line) AS low, trim(regexp_replace(line, '{_MARKS}', '')) AS bare,
  regexp_matches(line, '(^|[^A-Za-z])({A.TITLES})[.]?[ \t]+[A-Z]') OR regexp_matches(line, '^{_LABEL}') AS is_named, nth <= {A.TOP} AS is_top, regexp_matches(line, '[0-9]') AS has_digit,
  regexp_matches(line, '^[-*•0-9.]') AS is_item, regexp_replace(lower(line), '[^a-z0-9]', '', 'g') AS letters, len(list_filter(stems, lambda s: contains(lower(line), s) OR (length(s) >= 4 AND contains(lower(line), left(s, 4))))) AS n_stems FROM l2),
l4 AS (SELECT *, 3.0 * n_stems + 3.0 * is_named::INT + 3.0 * is_topic::INT + 2.0 * is_top::INT + has_digit::INT + is_item::INT AS score FROM l3
  WHERE length(bare) >= {A.LEAST_CHARS} AND (len(string_split_regex(bare, '[ \t]+')) >= {A.LEAST_WORDS} OR has_digit OR is_named) AND (n_stems > 0 OR is_topic OR is_top)),
l5 AS (SELECT query_id, list([{{'pos': pos, 'letters': letters, 'line': line, 'source': source, 'time': time, 'score': score}}] ORDER BY pos) AS xs FROM l4 GROUP BY 1),
l6 AS (SELECT query_id, unnest(list_reduce(xs, lambda a, y: CASE WHEN len(list_filter(a, lambda z: z.letters = y[1].letters
  OR (length(y[1].letters) > {A.SAME_CHARS} AND (contains(z.letters, y[1].letters) OR contains(y[1].letters, z.letters))))) > 0 THEN a ELSE a || y END)) AS x FROM l5),
l7 AS (SELECT query_id, x.source AS source, x.score AS score, x.time AS time, x.pos AS pos, CASE WHEN len(string_split(x.line, '(')) > len(string_split(x.line, ')')) THEN x.line || ')' ELSE x.line END AS line FROM l6),
l8 AS (SELECT * REPLACE (CASE WHEN len(string_split(line, '[')) > len(string_split(line, ']')) THEN line || ']' ELSE line END AS line) FROM l7),
l9 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, time DESC NULLS LAST, pos) AS ord, coalesce(nullif(trim(regexp_replace(trim(line), '(?i)^(\Q' || replace(source, '\E', '') || '\E[ \t]*)+', '')), ''), trim(line)) AS said FROM l8),
m0 AS (SELECT query_id, source, said, min(ord) AS ord FROM l9 GROUP BY ALL),
m1 AS (SELECT *, min(ord) OVER (PARTITION BY query_id, source) AS first, row_number() OVER (PARTITION BY query_id, source ORDER BY ord) AS nth_line FROM m0),
m2 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS nth_source FROM m1),
m3 AS (SELECT m2.*, one, trim(regexp_replace(trim(said), '{_MARKS}', '')) AS item FROM m2 JOIN qu USING (query_id) WHERE nth_source <= n_sources AND nth_line <= CASE WHEN one THEN 1 ELSE n_lines END),
m4 AS (SELECT *, trim(regexp_extract(item, '{_NAME}', 3)) AS rest, trim(regexp_extract(item, '^{_LABEL}[ \t]*(.+)$', 1)) AS label FROM m3),
m5 AS (SELECT *, CASE WHEN item = '' THEN '' WHEN contains(item, '**') THEN '* ' || item
  WHEN regexp_matches(item, '{_NAME}') THEN '* **' || trim(regexp_extract(item, '{_NAME}', 1)) || '** ' || CASE WHEN regexp_matches(rest, '^[,:]') THEN ' -' || substr(rest, 2) ELSE rest END
  WHEN label <> '' AND NOT regexp_matches(lower(label), '^({"|".join(A.CLAUSES)})') THEN '* **' || label || '**: ' || trim(regexp_extract(item, '^{_LABEL}[ \t]*(.+)$', 2)) ELSE '* ' || item END AS md FROM m4),
m6 AS (SELECT query_id, nth_source, CASE WHEN any_value(one) THEN '**' || source || '**: ' || regexp_replace(arg_min(md, nth_line), '^[* ]+', '') ELSE '**' || source || ':**' || chr(10) || string_agg(md, chr(10) ORDER BY nth_line) END AS block FROM m5 GROUP BY query_id, source, nth_source)
"""
)
QUERIES = {
    "retrieve_dense_topk": retrieve_dense_topk, "retrieve_in_space": retrieve_in_space, "retrieve_dense_text": retrieve_dense_text, "hybrid_score": hybrid_score,
    "retrieve_capped": retrieve_capped, "rerank": rerank, "relevance_filter": relevance_filter, "citations": citations, "synthesis": synthesis, "vocabulary": vocabulary,
    "spell_correct": spell_correct, "space_stats": space_stats, "source_stats": source_stats, "registry_stats": registry_stats, "provider_counts": provider_counts,
    "knowledge_stats": knowledge_stats, "source_catalogue": source_catalogue, "grand_totals": grand_totals, "source_top_samples": source_top_samples,
    "page_categories": page_categories, "clean_titles": clean_titles, "union_page_sources": union_page_sources, "document_merge": document_merge, "page_listing": page_listing, "catalogue_search": catalogue_search,
    "document_listing": document_listing, "last_runs": last_runs, "last_runs_legacy": last_runs_legacy, "origin_counts": origin_counts, "pagination": pagination,
    "run_log": run_log, "status_repair": status_repair, "crawl_bfs": crawl_bfs, "session_ttl": session_ttl, "csv_sections": csv_sections, "regrouped_text": regrouped,
    "stream_dedupe": stream_dedupe, "stream_windows": stream_windows, "stream_batches": stream_batches, "stream_sessions": stream_sessions, "vector_fit": vector_fit,
}

ORACLE = {
    "retrieve_dense_topk": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, rank, round(score, 5) AS score FROM r WHERE rank <= 10""",
    "retrieve_in_space": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, rank, round(score, 5) AS score FROM r WHERE rank <= 5""",
    "retrieve_dense_text": f"WITH {_TEXT_SCORES} SELECT query_id, id, round(dense, 5) AS dense FROM dense",
    "hybrid_score": f"WITH {_HYBRID} SELECT query_id, id, kw, title_hits, score FROM hy",
    "retrieve_capped": f"WITH {_HYBRID} SELECT query_id, id, pos, score FROM po",
    "rerank": f"WITH {_RERANK} SELECT query_id, id, rank, rerank_score FROM re",
    "relevance_filter": f"WITH {_RELEVANT} SELECT query_id, id, place FROM rv WHERE place <= 6",
    "citations": f"WITH {_RELEVANT} SELECT query_id, source_name, coalesce(section, '') AS section, round(max(rerank_score), 3) AS score FROM rv WHERE place <= 6 GROUP BY 1, 2, 3",
    "clean_titles": f"WITH {_PAGES} SELECT url, {_TITLE_OF.format(seg=_SEGMENT)} AS title, greatest(1, floor(coalesce(length, 0) / 500))::INT AS estimate FROM pg",
    "page_listing": f"WITH {_PAGE_LIST}, q AS (SELECT *, lower(concat_ws(' ', coalesce(url, ''), coalesce(title, ''))) AS b FROM pl) SELECT url, title, chars, chunks, origin, CASE {_CASES} ELSE '{R.OTHER_CATEGORY}' END AS category FROM q",
    "catalogue_search": f"WITH {_PAGE_LIST} SELECT url, title FROM pl WHERE contains(lower(title), 'course') OR contains(lower(url), 'course')",
    "document_listing": f"WITH {_LISTING} " + " UNION ALL ".join(f"SELECT id, name, {i} AS origin, {i > 0} AS unlisted FROM r{i}" for i in range(5)),
    "last_runs": "SELECT snapshot_no::VARCHAR AS id, max(snapshot_at)::TIMESTAMP AS ts, count(*) AS n FROM ingestion_registry GROUP BY 1 ORDER BY ts DESC, id DESC LIMIT 5",
    "last_runs_legacy": "SELECT 'crawl-legacy' AS id, max(last_seen)::TIMESTAMP AS ts, count(*) AS n FROM crawl_state",
    "origin_counts": "SELECT coalesce(source_type, 'default') AS origin, count(*) AS n FROM vectors GROUP BY 1",
    "stream_sessions": """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600 THEN 1 ELSE 0 END AS nw FROM events),
      s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g)
      SELECT user_id, event_id, session_no, least(20, row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id)) AS held FROM s""",
    "synthesis": f"""WITH {_SYNTHESIS} SELECT h.query_id, coalesce(b.answer, '') AS answer FROM (SELECT DISTINCT query_id FROM ht) h
      LEFT JOIN (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY nth_source) AS answer FROM m6 GROUP BY 1) b USING (query_id)""",
    "vocabulary": "SELECT DISTINCT unnest(regexp_extract_all(lower(x), '[a-z]{4,}')) AS word FROM (SELECT text AS x FROM vectors UNION ALL SELECT source_name FROM vectors)",
    "space_stats": f"""SELECT count(*) AS chunks, count(DISTINCT source_id) AS sources, count(DISTINCT embed_provider) AS spaces, sum(coalesce(tokens, 0))::BIGINT AS tokens,
      count(*) FILTER (embed_provider IS DISTINCT FROM '{PROVIDER}') AS stale FROM vectors""",
    "source_stats": f"WITH {_U} SELECT source_id, count(*) AS chunks, count(DISTINCT item_key) AS items FROM u GROUP BY 1",
    "registry_stats": """SELECT snapshot_no, source_id, count(*) AS tracked, sum(coalesce(chunk_count, 0))::BIGINT AS chunks, sum(coalesce(token_count, 0))::BIGINT AS tokens,
      count(*) FILTER (status = 'failed') AS failed, max(last_embedded)::TIMESTAMP AS last_embedded FROM ingestion_registry GROUP BY 1, 2""",
    "provider_counts": f"SELECT coalesce(embed_provider, 'unknown') AS provider, count(*) AS n FROM {_REG5} GROUP BY 1",
    "knowledge_stats": "SELECT count(DISTINCT source) AS sources, count(*) AS items, sum(length(text))::BIGINT AS chars FROM documents",
    "source_catalogue": f"""WITH {_U}, k AS (SELECT coalesce(source_id, source_name, item_key) AS source, id, item_key, length(text) AS chars FROM u),
      f AS (SELECT source, list_sort(list(id)) AS sample_ids FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS n FROM k) WHERE n <= 5 GROUP BY 1)
      SELECT source, count(DISTINCT item_key) AS items, count(*) AS chunks, sum(chars)::BIGINT AS chars, any_value(f.sample_ids) AS sample_ids FROM k JOIN f USING (source) GROUP BY 1""",
    "grand_totals": f"""WITH {_U}, k AS (SELECT coalesce(embed_provider, 'unknown') AS provider, coalesce(source_type, 'unknown') AS source_type FROM u)
      SELECT provider, source_type, grouping(provider, source_type)::INT AS level, count(*) AS chunks FROM k GROUP BY ROLLUP (provider, source_type)""",
    "source_top_samples": "SELECT * FROM (SELECT source, doc_id, title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 5",
    "page_categories": f"""WITH {_PAGES}, k AS (SELECT lower(concat_ws(' ', coalesce(url, ''), coalesce(title, ''))) AS b, length FROM pg),
      c AS (SELECT CASE {_CASES} ELSE '{R.OTHER_CATEGORY}' END AS category, length FROM k)
      SELECT category, count(*) AS pages, sum(coalesce(length, 0))::BIGINT AS chars, list_position({[n for n, _ in R.CATEGORIES] + [R.OTHER_CATEGORY]}, category)::INT AS place FROM c GROUP BY 1""",
    "union_page_sources": f"""WITH {_U}, a AS (SELECT DISTINCT url, 'crawl' AS origin, 0 AS priority FROM crawl_state UNION SELECT DISTINCT item_key, 'registry', 1 FROM {_REG5} WHERE item_key LIKE 'http%'
      UNION SELECT DISTINCT item_key, 'store', 2 FROM u WHERE item_key LIKE 'http%')
      SELECT url, arg_min(origin, priority) AS origin, min(priority) AS priority FROM a GROUP BY 1""",
    "document_merge": f"""WITH {_U}, a AS (SELECT source_id AS id, min(source_name) AS name FROM u WHERE source_type = 'document' GROUP BY 1), b AS (SELECT DISTINCT source_id AS id, source_id AS name FROM ingestion_registry)
      SELECT id, name, 0 AS priority FROM a UNION ALL SELECT id, name, 1 FROM b WHERE id NOT IN (SELECT id FROM a) AND lower(name) NOT IN (SELECT lower(name) FROM a WHERE name IS NOT NULL)""",
    "pagination": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 20 AS position FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10 OFFSET 20)",
    "run_log": "SELECT snapshot_no AS id, max(snapshot_at)::TIMESTAMP AS ts, count(*) AS n FROM ingestion_registry GROUP BY 1 ORDER BY ts DESC, id DESC LIMIT 3",
    "status_repair": f"""SELECT source_id || '|' || item_key AS id, CASE WHEN status = 'failed' AND chunk_count <= 8 THEN CASE WHEN chunk_count > 0 THEN 'Indexed' ELSE 'Interrupted' END
      WHEN status = 'failed' THEN 'Processing' ELSE status END AS status, chunk_count FROM {_REG5}""",
    "crawl_bfs": r"""WITH RECURSIVE pg AS (SELECT DISTINCT regexp_replace(lower(trim(url)), '/$', '') AS dst FROM crawl_state),
      lv AS (SELECT dst, regexp_replace(dst, '/[^/]*$', '') AS src FROM pg), fo AS (SELECT DISTINCT src AS dst, regexp_replace(src, '/[^/]*$', '') AS src2 FROM lv),
      e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM lv UNION SELECT src2, dst FROM fo) WHERE src <> dst AND length(src) > 8),
      b AS (SELECT DISTINCT src AS url, 0 AS depth FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 4)
      SELECT url, min(depth) AS depth FROM b GROUP BY 1""",
    "session_ttl": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 21600 THEN 1 ELSE 0 END AS nw FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g)
      SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM s GROUP BY 1, 2""",
    "csv_sections": """WITH n AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, list_filter([CASE WHEN trim(c_name) <> '' THEN 'c_name: ' || trim(c_name) END, CASE WHEN trim(c_mktsegment) <> '' THEN 'c_mktsegment: ' || trim(c_mktsegment) END], lambda x: x IS NOT NULL) AS p FROM customer),
      r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY i) AS k FROM n WHERE len(p) > 0)
      SELECT c_nationkey, ((k - 1) // 20)::INT AS section, CASE WHEN count(*) = 20 THEN 'Rows ' || (max(i) - 19) || ' - ' || max(i) ELSE 'CSV Data Records' END AS section_title,
        string_agg('Row ' || i || ': ' || array_to_string(p, '; '), chr(10) ORDER BY i) AS content FROM r GROUP BY 1, 2""",
    "regrouped_text": """SELECT source_id, item_key, md5(string_agg(text, chr(10) || chr(10) ORDER BY n, id)) AS text_md5 FROM (
      SELECT DISTINCT source_id, item_key, id, text, coalesce(try_cast(regexp_extract(id, '::([0-9]{1,9})::[^:]*$', 1) AS INT), 0) AS n FROM vectors WHERE item_key IS NOT NULL AND text IS NOT NULL) GROUP BY 1, 2""",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_windows": """WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT start, event_type, n FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""",
    "stream_batches": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "vector_fit": "SELECT DISTINCT id, 32 AS n FROM vectors WHERE embedding IS NOT NULL",
}
