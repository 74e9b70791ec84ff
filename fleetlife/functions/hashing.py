"""Reproducible randomness from md5: the same value for a key whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts) -> Column:
    return F.concat_ws("|", *[
        (p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts
    ])


def digest(*parts) -> Column:
    """md5 hex text of the parts joined by ``|``."""
    return F.md5(_text(parts))


def hash32(*parts) -> Column:
    """Integer in [0, 2^32) from the first 8 hex digits of the digest."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Number in [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)


def normal(*parts) -> Column:
    """Standard normal draw: Box-Muller on two uniforms of the same key."""
    u1 = (hash32(*parts, "r") + 1) / F.lit(4294967296.0)
    u2 = uniform(*parts, "a")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def content_key(parts: Column) -> Column:
    """``config.content_hash`` of a struct whose fields are in name order, one key per row."""
    return F.substring(F.sha2(F.to_json(parts), 256), 1, 16)
