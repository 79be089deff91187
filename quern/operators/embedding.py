"""Embedding stage: backends, the vector cache, the token ledger, and the spaces of vectors."""

from __future__ import annotations

import hashlib
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import fingerprint
from quern.functions.vectors import LOCAL_SPACE
from quern.plans.slices import BATCH_TEXTS, BATCH_TOKENS, INPUT_TOKENS

#: Vectors a cache holds, days a ledger keeps.
CACHE_VECTORS, LEDGER_DAYS = 200_000, 60
_TOKEN = re.compile(r"\w+")


class EmbeddingUnavailable(RuntimeError):
    """No vectors can be had just now."""


class QuotaExhausted(EmbeddingUnavailable):
    """The backend's quota is used up."""


class BudgetExhausted(EmbeddingUnavailable):
    """The day's token budget doesn't pay for the work."""


class BackendUnreachable(EmbeddingUnavailable):
    """The backend doesn't answer."""


class Embedder(ABC):
    """A source of vectors. Instances are sent to the tasks, so they hold settings and no connections."""

    space: str
    remote = False

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """Vectors in float32, a row for each text."""

    def available(self) -> bool:
        return True


class LocalHashEmbedder(Embedder):
    """Hashed bag of words, dense: the same vectors as ``functions.vectors.hash_embedding`` gives in sparse form."""

    space = LOCAL_SPACE

    def __init__(self, dimensions: int = 768):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        return self.exact(texts).astype(np.float32)

    def exact(self, texts: list[str]) -> np.ndarray:
        """The vectors in float64."""
        out = np.zeros((len(texts), self.dimensions))
        places: dict[str, tuple[int, float]] = {}
        for row, text in zip(out, texts):
            for i, token in enumerate(_TOKEN.findall((text or "").lower()), 1):
                if token not in places:
                    digest = int(hashlib.md5(token.encode()).hexdigest(), 16)
                    places[token] = (digest % self.dimensions, -1.0 if digest & 16 else 1.0)
                bucket, sign = places[token]
                row[bucket] += sign / i**0.5
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths > 0, lengths, 1)


class RemoteEmbedder(Embedder):
    """Place of a networked backend: a subclass brings the transport."""

    remote = True

    def __init__(self, space: str):
        self.space = space

    def embed(self, texts: list[str]) -> np.ndarray:
        raise BackendUnreachable(f"no transport for {self.space}")

    def available(self) -> bool:
        return False


class PatientEmbedder(Embedder):
    """Another embedder with pauses between requests, and further attempts, each after twice the pause, while it doesn't answer.

    A used-up quota isn't asked again. Pauses hold within a task; how many tasks ask at once is for the cluster.
    """

    def __init__(self, inner: Embedder, attempts: int = 3, spacing: float = 0.5):
        self.inner, self.attempts, self.spacing = inner, max(1, attempts), spacing
        self.space, self.remote = inner.space, inner.remote

    def available(self) -> bool:
        return self.inner.available()

    def embed(self, texts: list[str]) -> np.ndarray:
        pause = self.spacing
        for attempt in range(self.attempts):
            time.sleep(pause if attempt or self.remote else 0)
            try:
                return self.inner.embed(texts)
            except BackendUnreachable:
                if attempt + 1 == self.attempts:
                    raise
                pause *= 2
        raise AssertionError("no attempt was made")


def embed_query(embedder: Embedder, text: str) -> np.ndarray:
    """The vector of a question in the embedder's space, of unit length; zero for a blank one."""
    v = np.asarray(embedder.embed([(text or "").strip()])[0], np.float64)
    length = np.linalg.norm(v)
    return v / length if length > 0 else v


def requests(texts: list[str], max_texts: int = BATCH_TEXTS, max_tokens: int = BATCH_TOKENS, max_input: int = INPUT_TOKENS) -> Iterator[list[str]]:
    """Texts in order, cut to what an input may hold, in requests of at most so many texts and tokens."""
    held: list[str] = []
    tokens = 0
    for text in texts:
        text = text[: 4 * max_input]
        n = min(max_input, token_count(text))
        if held and (len(held) >= max_texts or tokens + n > max_tokens):
            yield held
            held, tokens = [], 0
        held.append(text)
        tokens += n
    if held:
        yield held


def token_count(text: str) -> int:
    """Tokens by rule of thumb, as ``functions.text.count_tokens`` counts them."""
    bare = text.strip()
    return int(max(len(bare) / 4, len(bare.split()) * 1.3)) + 1 if bare else 0


def embed_column(embedder: Embedder):
    """An Arrow UDF from texts to vectors, request by request."""

    def run(texts: pd.Series) -> pd.Series:
        vectors = [v for part in requests(texts.fillna("").tolist()) for v in embedder.embed(part)]
        return pd.Series(vectors, index=texts.index)

    return F.pandas_udf(run, "array<float>")


def cache_lookup(texts: DataFrame, cache: DataFrame, space: str, text: str = "text") -> DataFrame:
    """``texts`` with ``fp`` and the cached ``vector``, null for a miss."""
    held = cache.where(F.col("space") == space).select("fp", "vector")
    return texts.withColumn("fp", fingerprint(F.col(text))).join(held, "fp", "left")


def cache_store(cache: DataFrame, rows: DataFrame, capacity: int = CACHE_VECTORS) -> DataFrame:
    """The cache with new ``space, fp, vector`` rows, in order of ``fp``, until it is full; known keys are skipped."""
    new = rows.dropDuplicates(["space", "fp"]).join(cache.select("space", "fp"), ["space", "fp"], "left_anti")
    room = max(0, capacity - cache.count())
    return cache.unionByName(new.orderBy("space", "fp").limit(room)) if room else cache


def embed_documents(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``chunks`` with ``embedding`` and ``embed_provider``. Each distinct text is embedded once: misses are made
    distinct before the UDF, and their vectors joined back by fingerprint."""
    rows = chunks.drop("embedding", "embed_provider").withColumn("fp", fingerprint(F.col(text)))
    known = None if cache is None else cache.where(F.col("space") == embedder.space).select("fp", F.col("vector").alias("embedding"))
    missing = rows.select("fp", F.col(text).alias("_text")).dropDuplicates(["fp"])
    if known is not None:
        missing = missing.join(known, "fp", "left_anti")
    fresh = missing.select("fp", embed_column(embedder)(F.col("_text")).alias("embedding"))
    vectors = fresh if known is None else fresh.unionByName(known)
    return rows.join(vectors, "fp").drop("fp").withColumn("embed_provider", F.lit(embedder.space))


def hit_rate(lookups: DataFrame) -> DataFrame:
    """``hits, total, rate``: the rate in three digits, null where there was no lookup."""
    return lookups.agg(F.count("vector").alias("hits"), F.count("*").alias("total")).withColumn("rate", F.round(F.try_divide("hits", "total"), 3))


def ledger_daily(entries: DataFrame, ts: Column, tokens: Column, cached: Column) -> DataFrame:
    """``day, tokens, requests, cached_tokens``, the most recent 60 days."""
    days = entries.groupBy(F.to_date(ts).alias("day")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("requests"), F.sum(cached).alias("cached_tokens"))
    return days.where("day is not null").orderBy(F.desc("day")).limit(LEDGER_DAYS)


def budget_status(ledger: DataFrame, budget: int) -> DataFrame:
    """``day, spent, remaining, exhausted`` of each day; without a budget (0) nothing is ever exhausted."""
    left = F.greatest(F.lit(0).cast("bigint"), F.lit(budget) - F.col("tokens"))
    return ledger.select("day", F.col("tokens").alias("spent"), F.when(F.lit(budget > 0), left).alias("remaining"), (F.lit(budget > 0) & (F.col("tokens") >= budget)).alias("exhausted"))


def space_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("embed_provider", F.lit("legacy:unknown")).alias("space")).agg(F.count("*").alias("n"))


def first_in_space(chunks: DataFrame) -> DataFrame:
    """The first chunk of each space, by id: a sample for inspection."""
    w = Window.partitionBy("embed_provider").orderBy("id")
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
