"""Vector and key functions as plain column expressions.

All arithmetic is in double precision. Vectors are array columns; a null vector
gives null. Unequal lengths raise, because Spark would pad the shorter with
nulls. A zero vector has cosine 0 to everything. NaN stays NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def floats(v: Column) -> Column:
    return v.cast("array<float>")


def literal(values) -> Column:
    """A vector constant."""
    return F.array(*[F.lit(float(x)) for x in values]) if len(values) else F.array().cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _paired(a: Column, b: Column, f) -> Column:
    total = _sum(F.zip_with(doubles(a), doubles(b), f))
    return F.when(F.size(a) == F.size(b), total).otherwise(F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.lit("vectors of unequal dimension")).cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def squared_l2(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: (x - y) * (x - y))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def clip(score: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.when(score.isNull() | F.isnan(score), score).otherwise(F.least(F.greatest(score, F.lit(low)), F.lit(high)))


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """In [-1, 1]; 0 if either vector is zero. Norms kept beside the vectors can be given."""
    na, nb = norm_a if norm_a is not None else l2_norm(a), norm_b if norm_b is not None else l2_norm(b)
    product, norms = dot(a, b), na * nb
    return F.when(norms == 0, F.when(product.isNotNull(), F.lit(0.0))).otherwise(clip(product / norms))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = l2_norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def distance(a: Column, b: Column, space: str) -> Column:
    """Graph index distances: ``l2`` is squared, ``ip`` is 1 - dot, ``cosine`` is 1 - cosine."""
    if space == "l2":
        return squared_l2(a, b)
    if space == "ip":
        return F.lit(1.0) - dot(a, b)
    if space == "cosine":
        return F.lit(1.0) - cosine_similarity(a, b)
    raise ValueError(f"unknown space {space}")


def score_of_distance(d: Column) -> Column:
    """1 - distance, in every space."""
    return F.lit(1.0) - d


def argmin(distances: Column) -> Column:
    """Index of the smallest, the first of equals."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def subvector(v: Column, m: int, width: int) -> Column:
    return F.slice(v, m * width + 1, width)


def joined(parts: Column) -> Column:
    """Sub-vectors, an array of arrays, as one vector."""
    return F.flatten(parts)


def is_sound(v: Column, dimension: int) -> Column:
    """Of that dimension, with finite components, not all zero; never null."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimension) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


# Keys and payloads.


def key_hash(key: Column) -> Column:
    """SHA-256 as lower-case hex of fixed width, which compares like the number it writes."""
    return F.sha2(key.cast("binary"), 256)


def modulo_shard(key: Column, shards: int) -> Column:
    """The hash's number modulo ``shards``, digit by digit."""
    if shards < 1:
        raise ValueError("shards must be positive")
    h = key_hash(key)
    # 13 hex digits at a time stay within a bigint as long as shards < 2**11; one at a time always does.
    step = 13 if shards < 1 << 11 else 1
    folded = F.lit(0).cast("bigint")
    for at in range(0, 64, step):
        width = min(step, 64 - at)
        digits = F.conv(F.substring(h, at + 1, width), 16, 10).cast("bigint")
        folded = (folded * F.lit((16**width) % shards) + digits) % F.lit(shards)
    return folded.cast("int")


def cache_key(v: Column, k: Column) -> Column:
    """Key of a search result: one for equal vectors and k."""
    return F.sha2(F.concat_ws("_", F.to_json(floats(v)), k.cast("string")), 256)


def encode_key(key: Column) -> Column:
    return F.base64(key.cast("binary"))


def decode_key(key: Column) -> Column:
    return F.unbase64(key).cast("string")
