"""Searches for many words in one pass over a text, by automata in Arrow-batched functions.

A built-in expression would search a text once per word, so its cost would follow the number of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maximal runs of the characters that plain words consist of: no word lies across two of them.
RUN = re.compile("[a-z0-9-]+")
#: Texts of a batch that are Python objects at a time.
ROWS_AT_ONCE = 64


def held_terms(low_text: Column, terms: Sequence[str]) -> Column:
    """Positions in ``terms`` of those that are part of the text, ascending; one automaton per task finds all of them."""
    listed = list(terms)

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for place, term in enumerate(listed):
            automaton.add_word(term, place)
        automaton.make_automaton()
        for texts in batches:
            parts = []
            for at in range(0, max(len(texts), 1), ROWS_AT_ONCE):
                found = [sorted({place for _, place in automaton.iter(t)}) if t else [] for t in texts[at : at + ROWS_AT_ONCE].to_pylist()]
                parts.append(pa.array(found, pa.list_(pa.int32())))
            yield pa.concat_arrays(parts)

    return F.arrow_udf(search, "array<int>")(low_text)


def count_in(text: str, words: Sequence[str]) -> list[float]:
    """Occurrences of each word (of RUN's characters) in the text, not overlapping each other.

    Each different run is searched once, for all words at once, and counts as often as it stands there.
    """
    if not len(words):
        return []
    automaton = ahocorasick.Automaton()
    for place, word in enumerate(words):
        automaton.add_word(word, (place, len(word)))
    automaton.make_automaton()
    found = [0.0] * len(words)
    for run, times in Counter(RUN.findall(text)).items():
        ends: dict[int, int] = {}
        for last, (place, size) in automaton.iter(run):
            if last + 1 - size >= ends.get(place, 0):
                ends[place] = last + 1
                found[place] += times
    return found


def occurrences(low_text: Column, words: Column) -> Column:
    """array<double>: how often each of ``words`` is part of the text; NULL where the words are."""

    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, sought in batches:
            parts = []  # of each batch some texts at a time are Python objects
            for at in range(0, max(len(texts), 1), ROWS_AT_ONCE):
                some = zip(texts[at : at + ROWS_AT_ONCE].to_pylist(), sought[at : at + ROWS_AT_ONCE].to_pylist(), strict=True)
                parts.append(pa.array([None if w is None else count_in(t or "", w) for t, w in some], pa.list_(pa.float64())))
            yield pa.concat_arrays(parts)

    return F.arrow_udf(count, "array<double>")(F.when(words.isNotNull(), low_text), words)
