"""Token columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in item texts.
STOP_WORDS = ("a", "an", "and", "by", "for", "from", "in", "item", "movie", "of", "on", "or", "the", "to", "with")


def tokens(column: str | Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, repeats included."""
    text = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def item_tokens(column: str | Column) -> Column:
    """Distinct tokens of two or more characters that hold a letter and are no stop word."""
    return F.array_distinct(F.filter(tokens(column), lambda t: (F.length(t) >= 2) & t.rlike("[a-z]") & ~t.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, both / every).otherwise(0.0)
