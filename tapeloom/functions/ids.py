"""Identifiers derived from the row they belong to.

A task that is run again after an executor loss must mint the same id, so new ids
are hashes of their inputs in UUID form, never random.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: canonical lower-case form of a UUID.
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def derived_uuid(purpose: str, *parts: Column | str) -> Column:
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\x00")) for p in parts]
    digest = F.md5(F.concat_ws("\x1f", F.lit(purpose), *texts))
    cut = [(1, 8), (9, 4), (14, 3), (18, 3), (21, 12)]
    a, b, c, d, e = [F.substring(digest, at, n) for at, n in cut]
    return F.concat(a, F.lit("-"), b, F.lit("-5"), c, F.lit("-8"), d, F.lit("-"), e)


def is_uuid(value: Column | str) -> Column:
    return F.lower(F.col(value) if isinstance(value, str) else value).rlike(UUID_PATTERN)
