"""Transaction column expressions: description cleaning, row keys, categories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import CATEGORY_RULES, FIELD_SEP, STATE_CODES
from .text import py_split_words


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_description(col, n_words: int = 3, states=STATE_CODES, faithful_nulls: bool = False) -> Column:
    """Lower-case, collapse whitespace, keep only letters and spaces, keep the
    first ``n_words`` words, then delete state codes as whole words (this can
    leave a double space inside) and strip the ends. A missing description
    stays NULL, or becomes "nan" with ``faithful_nulls`` (what printing a
    missing CSV cell gives in the original)."""
    src = F.coalesce(_c(col), F.lit("nan")) if faithful_nulls else _c(col)
    # deleting everything but letters and whitespace, then splitting on
    # whitespace runs, yields the same words as collapse -> delete -> split
    s = F.regexp_replace(F.lower(src), f"(?U)[^a-z\\s\\x1c-\\x1f]", "")
    s = F.array_join(F.slice(py_split_words(s), 1, n_words), " ")
    s = F.regexp_replace(s, "\\b(?:" + "|".join(states) + ")\\b", "")
    return F.trim(F.replace(s, F.lit("-"), F.lit(" ")))


def row_key(*cols, sep: str = FIELD_SEP) -> Column:
    """``"Date - Description - Amount"``; a missing value prints as "nan"."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("nan")) for c in cols])


def canonical_category(col, rules=CATEGORY_RULES) -> Column:
    """First matching rule's category; unmatched values pass through."""
    c = _c(col)
    expr = None
    for words, target in rules:
        cond = None
        for w in words:
            cond = c.contains(w) if cond is None else (cond | c.contains(w))
        expr = F.when(cond, F.lit(target)) if expr is None else expr.when(cond, F.lit(target))
    return expr.otherwise(c)


def category_is_short(col, max_words: int = 3) -> Column:
    return F.size(py_split_words(col)) <= max_words
