"""The engine as a set of functions: what a service calls.

State lies in versioned tables under one folder: ``chunks``, ``registry`` (both moved by ``DeltaIngest``),
``knowledge``, ``runs``, ``ledger`` and ``messages``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.guard import verdict
from quern.functions.text import stripped
from quern.operators import answers as A
from quern.operators import delta as D
from quern.operators import reports as R
from quern.operators import retrieval as Q
from quern.operators.embedding import Embedder, LocalHashEmbedder, embed_documents
from quern.operators.sessions import last_messages, rewritten
from quern.operators.store import VersionedStore, pending
from quern.sources.readers import read_files, section_items
from quern.session import materialise
from quern.streaming.ingest import DeltaIngest

#: Longest question taken.
MAX_QUESTION = 2_000
_MESSAGES = "session_id string, turn long, role string, message string, at timestamp"
_KNOWLEDGE = "source_id string, item_key string, title string, text string, hash string, first_seen timestamp, last_seen timestamp, updated timestamp"
DEFAULTS = {"chunk_method": "recursive", "mode": "append_only", "top_k": 6, "daily_token_budget": 0, "schedule_time": "07:00"}


class Busy(RuntimeError):
    """A run is under way."""


class Engine:
    """Ingestion, retrieval and administration of one knowledge base."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, settings: dict | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.embedder = embedder or LocalHashEmbedder()
        self.settings = DEFAULTS | (settings or {})
        self.ingest = DeltaIngest(spark, self.path, self.embedder, self.settings["mode"], self.settings["chunk_method"])
        self.knowledge_store = VersionedStore(spark, f"{self.path}/knowledge")
        self.runs = VersionedStore(spark, f"{self.path}/runs")
        self.message_store = VersionedStore(spark, f"{self.path}/messages")
        self._busy = False

    # -- ingestion ---------------------------------------------------------------------------------------------

    def ingest_pages(self, pages: DataFrame) -> dict:
        """A delta run over ``source_id, source_name, source_type, item_key, text``: what changed is embedded."""
        if self._busy:
            raise Busy("a run is under way")
        self._busy = True
        try:
            stored = self.knowledge_store.read()
            stored = self.spark.createDataFrame([], _KNOWLEDGE) if stored is None else stored
            incoming = pages.select("source_id", "item_key", F.col("source_name").alias("title"), "text").dropDuplicates(D.KEY)
            self.knowledge_store.write(D.upsert_items(stored, incoming, F.current_timestamp()).where("change <> 'removed'").drop("change"))
            reasons = self.ingest.run(pages, budget=self.settings["daily_token_budget"], spent=self.spent_today())
            self._log(reasons)
            return {"status": "success", "reasons": reasons, "embedded": sum(n for r, n in reasons.items() if r not in ("unchanged", "deferred")) - reasons.get("deferred", 0), "skipped": reasons.get("unchanged", 0)}
        finally:
            self._busy = False

    def ingest_documents(self, folder: str) -> dict:
        """Uploaded files to items to chunks; files that fail are reported and stop nothing."""
        sections = read_files(self.spark, folder)
        errors = {r["path"]: r["error"] for r in sections.where("error is not null").select("path", "error").collect()}
        return self.ingest_pages(section_items(sections)) | {"errors": errors}

    def sections(self, folder: str) -> DataFrame:
        return read_files(self.spark, folder).where("error is null").select("path", "ordinal", F.coalesce(F.concat(F.lit("Page "), "page"), "section_title").alias("title"), "content")

    def _log(self, reasons: dict) -> None:
        row = self.spark.createDataFrame([(datetime.now(timezone.utc), {k: int(v) for k, v in reasons.items()})], "ts timestamp, reasons map<string,long>").withColumn("id", F.expr("uuid()"))
        old = self.runs.read()
        self.runs.write(R.run_log(row if old is None else old.unionByName(row)))

    def reembed(self, limit: int | None = None) -> int:
        """Chunks of other spaces get vectors of the active one; returns how many."""
        chunks = self.chunks()
        old = pending(chunks, self.embedder.space, limit)
        n = old.count()
        if n:
            fresh = embed_documents(old, self.embedder)
            self.ingest.chunks.upsert(materialise(fresh, "reembedded"), ["id"])
        return n

    # -- questions ---------------------------------------------------------------------------------------------

    def search(self, question: str, k: int | None = None) -> DataFrame:
        """The relevant hits of a question, best first."""
        k = k or self.settings["top_k"]
        asked = self.spark.createDataFrame([(0, question)], "query_id long, query string")
        chunks = self.chunks().select("id", "source_id", "source_name", "item_key", "text", F.lit(None).cast("string").alias("title"), F.col("item_key").alias("section"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("timestamp").alias("time"), "embed_provider", "embedding")
        dense = Q.dense_scores(asked, chunks, self.embedder, max(40, Q.pool_size(k)))
        hits = Q.rerank(Q.pool(Q.hybrid_candidates(asked, chunks, dense), k), asked, chunks, k)
        return Q.relevant(hits, asked, k)

    def chat(self, question: str, session_id: str = "default") -> dict:
        """Guard, rewrite, search, answer; the turn is appended to the session."""
        bare = (question or "").strip()
        if not bare or len(bare) > MAX_QUESTION:
            raise ValueError("a question has 1 to 2,000 characters")
        found = self.spark.range(1).select(verdict(F.lit(bare)).alias("v")).first()["v"]
        if found != "allowed":
            return {"reply": "", "sources": [], "guardrail_triggered": found, "session_id": session_id}
        messages = self.messages(session_id)
        turn = messages.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0] + 1
        now = datetime.now(timezone.utc)
        both = messages.unionByName(self.spark.createDataFrame([(session_id, turn, "user", bare, now)], _MESSAGES))
        asked = rewritten(both).where(F.col("turn") == turn).first()["question"]
        hits = self.search(asked)
        queries = self.spark.createDataFrame([(0, asked)], "query_id long, query string")
        answer = F.when(F.lit(turn > 1), A.without_greeting(F.col("answer"))).otherwise(F.col("answer"))
        reply = next((r["reply"] for r in A.answers(hits, queries).select(answer.alias("reply")).collect()), "")
        sources = [r.asDict() for r in A.citations(hits).drop("query_id").orderBy(F.desc("score")).collect()]
        self._remember(session_id, [(session_id, turn, "user", bare, now), (session_id, turn + 1, "assistant", reply, now)])
        return {"reply": reply, "sources": sources, "guardrail_triggered": None, "session_id": session_id}

    def messages(self, session_id: str) -> DataFrame:
        rows = self.message_store.read()
        return (self.spark.createDataFrame([], _MESSAGES) if rows is None else rows).where(F.col("session_id") == session_id)

    def _remember(self, session_id: str, rows: list[tuple]) -> None:
        old = self.message_store.read()
        new = self.spark.createDataFrame(rows, _MESSAGES)
        self.message_store.write(last_messages(new if old is None else old.unionByName(new)))

    def clear(self, session_id: str) -> None:
        self.message_store.delete(F.col("session_id") == session_id)

    # -- administration ----------------------------------------------------------------------------------------

    def chunks(self) -> DataFrame:
        rows = self.ingest.chunks.read()
        if rows is None:
            schema = "id string, source_id string, source_name string, source_type string, item_key string, ordinal int, text string, tokens int, context_header string, embedding array<float>, embed_provider string"
            return self.spark.createDataFrame([], schema)
        return rows

    def registry_rows(self) -> DataFrame:
        rows = self.ingest.registry.read()
        return self.ingest._empty_registry() if rows is None else rows

    def health(self) -> dict:
        return R.store_stats(self.chunks(), self.embedder.space).first().asDict()

    def status(self) -> dict:
        knowledge = self.knowledge_store.read()
        return {
            "store": self.health(),
            "registry": R.registry_stats(self.registry_rows()).first().asDict(),
            "knowledge": None if knowledge is None else R.knowledge_stats(knowledge, "source_id", "text").first().asDict(),
            "runs": [r.asDict() for r in self.changes().collect()],
        }

    def spent_today(self) -> int:
        """Tokens of the items embedded today."""
        today = self.registry_rows().where(F.to_date("last_embedded") == F.current_date())
        return today.agg(F.coalesce(F.sum("token_count"), F.lit(0))).first()[0]

    def embedding_status(self) -> dict:
        spaces, budget, spent = R.provider_counts(self.chunks()).collect(), self.settings["daily_token_budget"], self.spent_today()
        return {
            "active": self.embedder.space, "spaces": {r["provider"]: r["n"] for r in spaces}, "pending": pending(self.chunks(), self.embedder.space).count(),
            "budget": budget, "spent": spent, "remaining": max(0, budget - spent) if budget else None,
        }

    def knowledge(self) -> DataFrame:
        return R.catalogue(self.chunks())

    def history(self) -> DataFrame:
        """Items with their chunks by category, the registry's rows first, then what only the store has."""
        registry = self.registry_rows().select(F.concat_ws("|", "source_id", "item_key").alias("url"), "title", "chunk_count")
        store = self.chunks().groupBy(F.concat_ws("|", "source_id", "item_key").alias("url")).agg(F.min("source_name").alias("title"), F.count("*").cast("int").alias("chunk_count"))
        return R.by_priority([registry, store], "url").withColumn("category", R.category(F.col("url"), F.col("title")))

    def pages(self, words: str = "") -> DataFrame:
        """The site's pages as one list, of knowledge and store; those whose title or address holds ``words``."""
        knowledge, of_site = self.knowledge_store.read(), F.col("source_type") == "website"
        store = self.chunks().where(of_site).select(F.col("item_key").alias("url"), F.col("source_name").alias("title"), F.length("text").alias("chars"), F.lit(1).alias("n_chunks"))
        sources = [store]
        if knowledge is not None:
            held = knowledge.join(self.chunks().where(of_site).select("source_id", "item_key").distinct(), D.KEY, "left_semi")
            sources.insert(0, held.select(F.col("item_key").alias("url"), "title", F.length("text").alias("chars"), F.lit(0).alias("n_chunks")))
        return R.found_pages(R.page_listing(sources), words)

    def documents(self) -> DataFrame:
        """Uploaded documents, of knowledge and store."""
        named = lambda rows, n: rows.groupBy(F.col("source_id").alias("id")).agg(F.min(n).alias("name"))
        sources = [named(self.chunks().where("source_type = 'document'"), "source_name")]
        if (knowledge := self.knowledge_store.read()) is not None:
            sources.append(named(knowledge.where("source_id like 'doc-%'"), "title"))
        return R.document_listing(sources)

    def dashboard(self) -> DataFrame:
        return self.history().groupBy("category").agg(F.count("*").alias("pages"), F.sum("chunk_count").alias("chunks"))

    def registry(self, source_id: str) -> DataFrame:
        rows = self.registry_rows().where(F.col("source_id") == source_id)
        return rows.select("item_key", "title", "content_hash", "status", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("token_count", F.lit(0)).alias("token_count"), F.coalesce("revision", F.lit(1)).alias("revision"), "first_seen", "last_embedded").orderBy("item_key")

    def source_chunks(self, source: str) -> DataFrame:
        return self.chunks().where(F.coalesce("source_id", "source_name", "item_key") == source)

    def preview(self, source: str, n: int = 15, chars: int = 350) -> DataFrame:
        """First chunks of a page, else of a source, else stored items; texts cut to ``chars``."""
        cut = lambda c: F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(F.col(c)).alias("text")
        pages = self.chunks().where(F.col("item_key") == source)
        if pages.isEmpty():
            pages = self.source_chunks(source)
        if pages.isEmpty() and (items := self.knowledge_store.read()) is not None:
            return items.where((F.col("source_id") == source) | (F.col("item_key") == source)).orderBy("item_key").limit(n).select(F.col("item_key").alias("id"), cut("text"))
        return pages.orderBy("item_key", "ordinal").limit(n).select("id", cut("text"))

    def delete_source(self, name: str) -> int:
        """Drops an item (by key) or a source (by id) from all stores; returns the chunks that went."""
        hit = (F.col("item_key") == name) | (F.col("source_id") == name)
        n = self.chunks().where(hit).count()
        for store in (self.ingest.chunks, self.ingest.registry, self.knowledge_store):
            store.delete(hit)
        return n

    def reset(self, confirm: str) -> None:
        if confirm != "RESET":
            raise ValueError("reset needs confirm='RESET'")
        if self._busy:
            raise Busy("a run is under way")
        for store in (self.ingest.chunks, self.ingest.registry, self.knowledge_store, self.runs, self.message_store):
            store.reset()

    def changes(self) -> DataFrame:
        rows = self.runs.read()
        return self.spark.createDataFrame([], "ts timestamp, reasons map<string,long>, id string") if rows is None else rows.orderBy(F.desc("ts"))

    def configure(self, **changes) -> dict:
        """Settings merged, the last value wins; unknown names are refused."""
        if unknown := set(changes) - set(DEFAULTS):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        self.settings |= changes
        self.ingest.mode, self.ingest.method = self.settings["mode"], self.settings["chunk_method"]
        return dict(self.settings)


def pages_as_items(pages: DataFrame, source_id: str = "website") -> DataFrame:
    """Crawled pages (``url, title, content``) in the form that ``ingest_pages`` takes."""
    return pages.select(F.lit(source_id).alias("source_id"), "title", "url", "content").select(
        "source_id", F.coalesce("title", "url").alias("source_name"), F.lit("website").alias("source_type"), F.col("url").alias("item_key"), stripped(F.coalesce("content", F.lit(""))).alias("text")
    )
