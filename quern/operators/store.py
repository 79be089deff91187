"""The vector store: a versioned Parquet table with merge, append, upsert, delete and re-embedding.

A version is a manifest: the list of the data folders it consists of. An append writes one folder and a manifest; an upsert or
a delete rewrites only the folders that hold rows concerned. Manifests appear by renaming, so that readers see the old or
the new version and never a mixture; the last ones are kept, and what they refer to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.text import dedupe_key


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``. Partial maxima would lose the row, hence a window with a
    rank filter, which Spark limits to one row a group before the shuffle."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def merge_stores(remote: DataFrame, local: DataFrame, key: str = "id") -> DataFrame:
    """Remote rows, and local ones that the remote store lacks."""
    return remote.unionByName(local.join(remote.select(key).distinct(), key, "left_anti"))


def upsert(store: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The store with ``rows`` in place of the rows of the same key, and added where there were none."""
    return store.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def unique_chunks(chunks: DataFrame, order: list[Column]) -> DataFrame:
    """The first chunk of each (item, normalised text), in ``order``; items without key are one."""
    keyed = chunks.withColumn("_digest", dedupe_key(F.col("text")))
    w = Window.partitionBy("source_id", "item_key", "_digest").orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_digest")


def appendable(live: DataFrame, chunks: DataFrame, order: list[Column]) -> DataFrame:
    """New chunks that the store takes: unique within their item, and neither their id nor their normalised text
    is live, in whatever source, before this slice."""
    unique = unique_chunks(chunks, order).withColumn("_digest", dedupe_key(F.col("text")))
    ids = live.select("id").distinct()
    digests = live.select(dedupe_key(F.col("text")).alias("_digest")).distinct()
    return unique.join(ids, "id", "left_anti").join(digests, "_digest", "left_anti").drop("_digest")


def append_update(live: DataFrame, chunks: DataFrame, order: list[Column], mode: str = "append_only", replaced: DataFrame | None = None) -> DataFrame:
    """The store after a slice. ``append_only`` leaves replaced chunks where they are; ``replace`` drops the rows
    of the items in ``replaced`` (``source_id, item_key``) first."""
    if mode not in ("append_only", "replace"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "replace" and replaced is not None:
        live = live.join(replaced.select("source_id", "item_key").distinct(), ["source_id", "item_key"], "left_anti")
    return live.unionByName(appendable(live, chunks, order), allowMissingColumns=True)


def remap_sources(chunks: DataFrame, mapping: DataFrame, key: str = "id") -> DataFrame:
    """Source ids rewritten by ``mapping`` (``old, new``), and the ids' prefixes with them; an id without the old
    prefix gets the new one in front."""
    m = mapping.select(F.col("old").alias("source_id"), "new")
    joined = chunks.join(m, "source_id", "left")
    old = F.concat(F.col("source_id"), F.lit("::"))
    renamed = F.when(F.col(key).startswith(old), F.concat(F.col("new"), F.lit("::"), F.substring(F.col(key), F.length(old) + 1, F.length(F.col(key))))).otherwise(F.concat_ws("::", "new", F.col(key)))
    return joined.withColumn(key, F.when(F.col("new").isNotNull(), renamed).otherwise(F.col(key))).withColumn("source_id", F.coalesce("new", "source_id")).drop("new")


def pending(chunks: DataFrame, active: str, limit: int | None = None) -> DataFrame:
    """Chunks that are not in the active space; at most ``limit``, by id, where a run is to be bounded."""
    rows = chunks.where(~F.col("embed_provider").eqNullSafe(F.lit(active)))
    return rows if limit is None else rows.orderBy("id").limit(limit)


class VersionedStore:
    """A Parquet table in ``path``: data folders, and a manifest for each version.

    ``batch``, where given, numbers the work of a stream or a run: work whose number isn't above the last one was done already
    and changes nothing. Two writers at once: the second to rename its manifest fails, and its data is not seen.
    """

    #: Folders of a version beyond which an append merges them.
    MOST_FOLDERS = 256

    def __init__(self, spark: SparkSession, path: str, keep: int = 5):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []

    def versions(self) -> list[int]:
        return sorted(int(n[9:]) for n in self._names() if n.startswith("manifest-") and n[9:].isdigit())

    def version(self) -> int:
        """The current version; 0 if nothing was written."""
        return max(self.versions(), default=0)

    def _manifest(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"manifest-{n}"))
        try:
            return json.loads(str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def batch(self) -> int | None:
        """Number of the work done last."""
        n = self.version()
        return self._manifest(n)["batch"] if n else None

    def _done(self, batch: int | None) -> bool:
        last = self.batch()
        return batch is not None and last is not None and batch <= last

    def _load(self, folders: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        n = self.version() if version is None else version
        if not n:
            return None
        held = self._manifest(n)
        return self._load(held["folders"], StructType.fromJson(held["schema"]))

    def _put(self, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, folders: list[str], schema: StructType, batch: int | None, after: int) -> int:
        n = after + 1
        last = self._manifest(after)["batch"] if after else None
        text = json.dumps({"folders": folders, "schema": schema.jsonValue(), "batch": last if batch is None else batch})
        draft = self._path(f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._path(f"manifest-{n}")) or not self._fs.rename(draft, self._path(f"manifest-{n}")):
            raise RuntimeError(f"version {n} of {self.path} was written by another")
        kept = [v for v in self.versions() if v > n - self.keep]
        used = {f for v in kept for f in self._manifest(v)["folders"]}
        for name in self._names():
            if name.startswith("manifest-") and int(name[9:]) not in kept or name.startswith("data-") and name not in used:
                self._fs.delete(self._path(name), True)
        return n

    def write(self, rows: DataFrame, batch: int | None = None) -> int:
        """The next version, of ``rows`` alone."""
        at = self.version()
        return at if self._done(batch) else self._commit([self._put(rows)], _nullable(rows.schema), batch, at)

    def append(self, rows: DataFrame, batch: int | None = None) -> int:
        """The next version: the rows there are and ``rows``. Columns either lacks are null."""
        at = self.version()
        if self._done(batch):
            return at
        if not at:
            return self.write(rows, batch)
        held = self._manifest(at)
        schema = StructType.fromJson(held["schema"])
        new = [f for f in _nullable(rows.schema).fields if f.name not in schema.names]
        schema = StructType(schema.fields + new)
        folders = [*held["folders"], self._put(rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields)))]
        if len(folders) > self.MOST_FOLDERS:
            folders = [self._put(self._load(folders, schema))]
        return self._commit(folders, schema, batch, at)

    def _placed(self, folders: list[str], schema: StructType) -> DataFrame:
        """The rows of some folders, with ``_folder``."""
        rows = self._load(folders, schema)
        return rows.withColumn("_folder", F.regexp_extract("_metadata.file_path", r"/(data-[0-9a-f]{32})/", 1) if folders else F.lit(None).cast("string"))

    @staticmethod
    def _holding(rows: DataFrame) -> list[str]:
        """The folders of rows; as many as a version has at most."""
        return sorted(r[0] for r in rows.select("_folder").distinct().collect())

    def upsert(self, rows: DataFrame, keys: list[str], batch: int | None = None, replaced: DataFrame | None = None) -> int:
        """``rows`` in place of the rows of the same keys – or of those of ``replaced``, where given – and added where there
        were none."""
        at = self.version()
        if not at or self._done(batch):
            return self.append(rows, batch)
        held = self._manifest(at)
        schema = StructType.fromJson(held["schema"])
        named = (rows if replaced is None else replaced).select(*keys).distinct()
        touched = self._holding(self._placed(held["folders"], schema).select(*keys, "_folder").join(named, keys, "left_semi"))
        kept = self._load(touched, schema).join(named, keys, "left_anti").unionByName(rows, allowMissingColumns=True)
        folders = [f for f in held["folders"] if f not in touched]
        return self._commit([*folders, self._put(kept)], _nullable(kept.schema), batch, at)

    def delete(self, condition: Column, batch: int | None = None) -> int:
        """Drops the rows for which ``condition`` holds; those for which it is null stay."""
        at = self.version()
        if not at or self._done(batch):
            return at
        held = self._manifest(at)
        schema = StructType.fromJson(held["schema"])
        touched = self._holding(self._placed(held["folders"], schema).where(condition))
        if not touched:
            return at
        folders = [f for f in held["folders"] if f not in touched]
        return self._commit([*folders, self._put(self._load(touched, schema).where(~F.coalesce(condition, F.lit(False))))], schema, batch, at)

    def reset(self) -> int:
        at = self.version()
        return self._commit([], StructType.fromJson(self._manifest(at)["schema"]), None, at) if at else 0


def _nullable(schema: StructType) -> StructType:
    return StructType([type(f)(f.name, f.dataType, True) for f in schema.fields])
