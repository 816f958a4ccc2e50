"""Column helpers shared by every operator."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c) -> Column:
    """Number present and not zero: missing and 0 both count as absent."""
    c = col(c)
    return F.coalesce(c != 0, F.lit(False))


def filled(c) -> Column:
    """Text present and not empty."""
    c = col(c)
    return F.coalesce(c != "", F.lit(False))


def null_if_zero(c) -> Column:
    c = col(c)
    return F.when(c != 0, c)


def null_if_empty(c) -> Column:
    """NULL for the empty text; the text is worked out once."""
    return F.get(F.array_remove(F.array(col(c)), F.lit("")), F.lit(0))


def once(value, build: Callable[[Column], Column]) -> Column:
    """`build(value)` where the value is worked out once, however often `build` names it.

    Spark works out what the branches of a `CASE` share once for each of them.
    """
    return F.element_at(F.transform(F.array(col(value)), build), 1)


def round_even(c, digits: int = 0) -> Column:
    """Round half to even; negative digits round to tens, hundreds, ..."""
    c = col(c).cast("double")
    if digits >= 0:
        scale = float(10 ** digits)
        return F.rint(c * F.lit(scale)) / F.lit(scale)
    scale = float(10 ** -digits)
    return F.rint(c / F.lit(scale)) * F.lit(scale)


def lookup(mapping: Mapping, key) -> Column:
    """Value of a small fixed table as a `CASE` chain; NULL when the key is unknown."""
    key = col(key)
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def map_lookup(mapping: Mapping, key) -> Column:
    """Value of a larger fixed table held as one map literal."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(key))


def contains_any(text, words: Iterable[str]) -> Column:
    text = col(text)
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return F.coalesce(out, F.lit(False))


def first_match(text, table) -> Column:
    """First entry of an ordered (words, value) table whose word occurs in the text."""
    def choose(known):
        out = None
        for words, value in table:
            words = (words,) if isinstance(words, str) else words
            hit = contains_any(known, words)
            out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
        return out

    return choose(F.col(text)) if isinstance(text, str) else once(text, choose)


def number_at(text, pattern: str, group: int = 1) -> Column:
    """Captured text of a pattern, NULL when it does not match."""
    return null_if_empty(F.regexp_extract(col(text), pattern, group))


def col_or_null(df: DataFrame, name: str, dtype: str) -> Column:
    """The column, or a typed NULL where a source does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def days_between(later, earlier) -> Column:
    """Whole days, rounded down, between two timestamps."""
    seconds = (F.unix_timestamp(col(later).cast("timestamp"))
               - F.unix_timestamp(col(earlier).cast("timestamp")))
    return F.floor(seconds / F.lit(86400)).cast("int")
