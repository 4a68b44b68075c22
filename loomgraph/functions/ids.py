"""Content-addressed ids of nodes and facts."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, functions as F

SEPARATOR = "\x1f"


def native_id(kind: str, *parts: Column) -> Column:
    """`kind:` and 24 hex digits of the MD5 of the parts, trimmed and lower-cased; stays in the JVM."""
    cleaned = [F.lower(F.trim(p.cast("string"))) for p in parts]
    return F.concat(F.lit(f"{kind}:"), F.substring(F.md5(F.concat_ws(SEPARATOR, F.lit(kind), *cleaned)), 1, 24))


def parity_id(kind: str, *parts: Column) -> Column:
    """`kind:` and 24 hex digits of BLAKE2b-96, which Spark lacks: an Arrow-batched UDF."""

    @F.pandas_udf("string")
    def digest(joined: pd.Series) -> pd.Series:
        return joined.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=12).hexdigest())

    cleaned = [F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]
    return F.concat(F.lit(f"{kind}:"), digest(F.concat_ws(SEPARATOR, F.lit(kind), *cleaned)))


def node_id(kind: str, *parts: Column, parity: bool = False) -> Column:
    return parity_id(kind, *parts) if parity else native_id(kind, *parts)


def surrogate(key: Column) -> Column:
    """A 62-bit integer for stores that need integer ids."""
    return F.xxhash64(key).bitwiseAND((1 << 62) - 1)


def opaque_id(kind: str) -> str:
    return f"{kind}:{uuid.uuid4().hex}"


def stable_opaque_id(kind: str, members: Column) -> Column:
    """An id for a set of members that reruns reproduce."""
    return F.concat(F.lit(f"{kind}:"), F.substring(F.md5(F.array_join(F.array_sort(members), SEPARATOR)), 1, 24))
