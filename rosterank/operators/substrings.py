"""Which texts hold which others, by equality of substrings instead of a comparison of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pieces(text: Column, sizes: list[int]) -> Column:
    """The different substrings of ``text`` that have one of the lengths ``sizes``."""

    def of_size(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.char_length(text) - size + 1)
        return F.transform(starts, lambda at: F.substring(text, at, size))

    fitting = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda size: size <= F.char_length(text))
    return F.array_distinct(F.flatten(F.transform(fitting, of_size)))


def _sizes(texts: DataFrame, column: str, most: int) -> list[int]:
    """The different lengths up to ``most``, so ``most`` numbers at most."""
    found = texts.select(F.char_length(column).alias("n")).filter((F.col("n") > 0) & (F.col("n") <= most)).distinct()
    return sorted(r["n"] for r in found.collect())


def mutual_substrings(names: DataFrame, terms: DataFrame) -> DataFrame:
    """(name, term) where one is part of the other, of ``names`` (name) and ``terms`` (term), both without repeats.

    Every substring of a name that is as long as some term is joined to the terms on equality, and the reverse. Work
    follows the texts' lengths and the matches, not the product of the tables. Empty texts match nothing here.
    """
    longest = terms.agg(F.max(F.char_length("term"))).first()[0] or 0
    term_sizes, name_sizes = _sizes(terms, "term", longest), _sizes(names, "name", longest)
    within_names = names.select("name", F.explode(_pieces(F.col("name"), term_sizes)).alias("term")) if term_sizes else None
    within_terms = terms.select("term", F.explode(_pieces(F.col("term"), name_sizes)).alias("name")) if name_sizes else None
    if within_names is None or within_terms is None:
        return names.join(terms, F.col("name") == F.col("term")).filter(F.char_length("name") > 0).select("name", "term")
    held = within_names.join(terms, "term").select("name", "term")
    return held.union(within_terms.join(names, "name").select("name", "term")).distinct()
