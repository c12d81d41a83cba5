"""Content identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doc_id(path: Column) -> Column:
    """Sixteen hex digits of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 16)


def fingerprint(meta: Column, content: Column) -> Column:
    """SHA-256 of a document's canonical metadata and body."""
    return F.sha2(F.concat(meta, F.lit("\n"), content), 256)


def digest(*columns: Column) -> Column:
    """Order-free digest of a group's rows: SHA-256 over the sorted row hashes."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2(F.to_json(F.struct(*columns)), 256))), ""), 256)


def pseudo_vector(text: Column, dimension: int = 8) -> Column:
    """Deterministic vector in [0, 1] from a text's hash, for tests without a model."""
    h = F.sha2(text, 256)
    return F.array(*(F.conv(F.substring(h, 1 + 4 * (i % 16), 4), 16, 10).cast("double") / 65535 for i in range(dimension)))
