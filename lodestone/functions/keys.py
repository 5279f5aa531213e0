"""Keys as the tables write them: unevenly. One notation for comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_id(c: Column | str) -> Column:
    """An id for comparing: trimmed, lower case, null where blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def norm_name(c: Column | str) -> Column:
    """A name for comparing: trimmed, case kept, null where blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def norm_path(c: Column | str) -> Column:
    """A path with / and without leading ./, case kept, null where blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.translate(F.trim(c), "\\", "/"), r"^(\./+)+", ""), F.lit(""))


def norm_hash(c: Column | str) -> Column:
    """The hex digits of a content hash, lower case, without an algorithm name in front; null where blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"^[a-z0-9_-]+[:=]\s*", ""), F.lit(""))
