"""Set digests: a fixed-size fingerprint of a set that grows without bound.

Each member contributes two 60-bit halves of its SHA-256; the halves are added up.
Sums combine on the map side and do not depend on order, so the fingerprint of a
section with billions of facts costs one small aggregation buffer per task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.text import col


def member(value: Column | str, half: int) -> Column:
    """One half of a member's SHA-256 as a number (half 0 or 1)."""
    digits = F.substring(F.sha2(col(value).cast("string"), 256), 1 + 15 * half, 15)
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def digest_of(count: Column | str, *sums: Column | str) -> Column:
    """The fingerprint from a count and the sums of members' halves: `<count>:<sum>:<sum>`."""
    return F.concat_ws(":", *[col(c).cast("string") for c in (count, *sums)])


def set_digest(value: Column | str) -> Column:
    """Aggregate: the fingerprint of a set."""
    return digest_of(F.count(col(value)), *[F.coalesce(F.sum(member(value, half)), F.lit(0)) for half in (0, 1)])
