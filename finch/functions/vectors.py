"""Vector column expressions: hashed token buckets, dot product, cosine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_DIM = 256
TOKEN_PATTERN = "[\\p{L}\\p{N}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def token_hash(tok: Column) -> Column:
    """First 32 bits of the token's MD5 as a non-negative integer."""
    return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")


def token_buckets(col, dim: int = HASH_DIM) -> Column:
    """Bucket id of every token: the sparse form of a hashed bag of words."""
    return F.transform(tokens(col), lambda t: F.pmod(token_hash(t), F.lit(dim)).cast("int"))


def run_lengths(values) -> Column:
    """array<struct<v, n>>: the distinct values of an array in order and how often
    each stands in it; the sorted values are read as runs. Null for a null array."""
    def runs(b: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: (i == 0) | (b[i] != b[F.greatest(i - 1, F.lit(0))]))
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: F.struct(
            b[i].alias("v"), (F.coalesce(F.get(at, k + 1), F.size(b)) - i).alias("n"))))[0]
    v = _c(values)
    full = F.transform(F.array(F.sort_array(v)), runs)[0]
    return F.when(F.size(v) > 0, full).when(v.isNotNull(), F.filter(F.transform(v, lambda x: F.struct(x.alias("v"), F.lit(0).alias("n"))), lambda _: F.lit(False)))


def sparse_string(buckets) -> Column:
    """"bucket:count" pairs in bucket order: the hashed vector in sparse form."""
    return F.array_join(F.transform(run_lengths(buckets), lambda r: F.concat(r["v"].cast("string"), F.lit(":"), r["n"].cast("string"))), ",")


def dense_to_sparse_string(vec) -> Column:
    """Same form from a dense count vector."""
    pairs = F.transform(_c(vec), lambda x, i: F.when(x > 0, F.concat(i.cast("string"), F.lit(":"),
                                                                        x.cast("int").cast("string"))))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), ",")


def dot(a, b) -> Column:
    """Sum of element products in DOUBLE, left to right."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when either vector has zero norm."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
