"""Written forms of keys, digests and providers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def written_key(key: Column) -> Column:
    """The form in which keys are compared: blanks trimmed, lower case, one final ``/`` dropped. Null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(key, r"(?U)^\s+|\s+$", "")), "/$", "")


def hex_digest(digest: Column) -> Column:
    """A content hash without algorithm prefix, in lower case; null where there is none."""
    bare = F.regexp_replace(F.lower(F.trim(digest)), r"^[^:]*:", "")
    return F.when(bare != "", bare)


def written_provider(provider: Column) -> Column:
    """An embedding provider in the form compared: trimmed, lower case; null where it is blank."""
    bare = F.lower(F.regexp_replace(provider, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)
