"""Vector arithmetic as Column expressions, and the hashed bag-of-words embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import WORD

LOCAL_SPACE = "local:hash-v1"
LEGACY_SPACE = "legacy:unknown"


def fitted(vector: Column, dimensions: int) -> Column:
    """A vector cut or filled with zeros to a length."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), dimensions)), 1, dimensions)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + F.coalesce(x, F.lit(0.0).cast("double")))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalised(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(vector)
    return F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def bucket_of(token: Column, dimensions: int) -> Column:
    """The md5 digest as an integer modulo ``dimensions``, folded over four 32-bit words, as 128 bits fit no type."""
    step = (1 << 32) % dimensions
    digest = F.md5(token)
    folded = F.lit(0).cast("long")
    for i in range(4):  # unrolled, so that it stays in generated code
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        folded = (folded * step + word) % dimensions
    return folded


def sign_of(token: Column) -> Column:
    """+1 if bit 4 of the digest is 0, else -1."""
    return F.when(F.substring(F.md5(token), 31, 1).isin(*"02468ace"), 1.0).otherwise(-1.0)


def hash_embedding(texts: DataFrame, key: str, text: str, dimensions: int = 768) -> DataFrame:
    """The local embedding in sparse form: ``key, bucket, weight``, each text scaled to unit length.

    A token adds plus or minus ``1 / sqrt(position)`` to its bucket. A text without tokens has no rows; buckets
    whose parts cancel out are left out. One shuffle, on the key, with the buckets summed before it.
    """
    tokens = texts.where(F.col(key).isNotNull()).select(
        F.col(key), F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))).alias("pos", "token")
    )
    # A repeated token is hashed once for its text.
    held = tokens.groupBy(key, "token").agg(F.sum(F.lit(1.0) / F.sqrt(F.col("pos") + 1.0)).alias("w"))
    parts = (
        held.select(F.col(key), bucket_of(F.col("token"), dimensions).cast("int").alias("bucket"), (sign_of(F.col("token")) * F.col("w")).alias("w"))
        .groupBy(key, "bucket")
        .agg(F.sum("w").alias("w"))
    )
    lengths = parts.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return parts.join(lengths, key).where((F.col("length") > 0) & (F.col("w") != 0)).select(key, "bucket", (F.col("w") / F.col("length")).alias("weight"))
