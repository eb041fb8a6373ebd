"""Feature expressions over the lower-cased text of a job description. All of them are row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterank import vocab
from rosterank.functions.basics import BLANK, WORD, exact_round, literal, once, strings
from rosterank.functions.scores import LEVEL_BREAK
from rosterank.functions.search import held_terms, occurrences

YEARS = r"(?:years?|yrs?)"
# --- fixed values: the experience phrases, in order of priority; the first is a range ----------------
RANGE_PATTERN = rf"([0-9]+){BLANK}*[-–to]+{BLANK}*([0-9]+){BLANK}*{YEARS}"
SINGLE_PATTERNS = (
    rf"([0-9]+)\+{BLANK}*{YEARS}",
    rf"minimum{BLANK}+([0-9]+){BLANK}*{YEARS}",
    rf"at least{BLANK}+([0-9]+){BLANK}*{YEARS}",
    rf"([0-9]+){BLANK}*{YEARS}{BLANK}+(?:of{BLANK}+)?experience",
)
# --- fixed values: shapes of technical tokens and of plain words ------------------------------------
SHAPED_TERM = rf"(?<!{WORD})([a-z][a-z0-9]*(?:[-\.][a-z0-9]+)+|[a-z]{{2,6}}[0-9]+[a-z0-9]*)(?!{WORD})"
PLAIN_WORD = rf"(?<!{WORD})[a-z][a-z0-9\-]{{2,29}}(?:(?<=[a-z0-9])(?!{WORD})|(?<=-)(?={WORD}))"

MANY_YEARS = 10**15  # stands in for a number of years too long for a bigint
TERM = "array<struct<term:string,weight:double>>"


def _number(match: Column) -> Column:
    return F.when(match != "", F.coalesce(match.try_cast("bigint"), F.lit(MANY_YEARS)))


def experience_range(low_text: Column) -> Column:
    """struct(exp_min, exp_max): the first phrase kind present decides, at its first occurrence."""
    low = _number(F.regexp_extract(low_text, RANGE_PATTERN, 1))
    high = _number(F.regexp_extract(low_text, RANGE_PATTERN, 2))
    single = F.coalesce(*[_number(F.regexp_extract(low_text, p, 1)) for p in SINGLE_PATTERNS])
    stated = F.coalesce(low, single)
    return F.struct(
        F.when(stated.isNull(), 3).otherwise(F.greatest(stated - 1, F.lit(0))).cast("bigint").alias("exp_min"),
        F.coalesce(high + 2, single + 6, F.lit(12)).cast("bigint").alias("exp_max"),
    )


def _vocabulary_rows() -> list[dict]:
    return [
        {"term": term, "weight": vocab.TIER_WEIGHTS[tier][0]}
        for tier, term in vocab.tiered_terms()
    ]


def _vocabulary() -> Column:
    return literal(_vocabulary_rows(), "array<struct<term:string,weight:double>>")


def held(low_text: Column) -> Column:
    """Positions of the vocabulary's terms, then of the cities, that the text holds."""
    return held_terms(low_text, [*(v["term"] for v in _vocabulary_rows()), *vocab.CITIES])


def locations(found: Column) -> Column:
    """The cities among ``held`` positions, with the whole metropolis if they hold one of its parts."""
    first = len(_vocabulary_rows())
    cities = strings(vocab.CITIES)
    named = F.transform(F.filter(found, lambda i: i >= first), lambda i: F.get(cities, i - first))
    return F.sort_array(
        once(
            named,
            lambda some: F.when(
                F.arrays_overlap(some, strings(vocab.METRO_TRIGGERS)), F.array_union(some, strings(vocab.METRO_AREA))
            ).otherwise(some),
        )
    )


def vocabulary_hits(found: Column) -> Column:
    """The terms among ``held`` positions with their weights, in the vocabulary's order."""
    terms, first = _vocabulary(), len(_vocabulary_rows())
    return F.transform(
        F.filter(found, lambda i: i < first),
        lambda i: F.struct(F.get(terms, i)["term"].alias("term"), F.get(terms, i)["weight"].alias("weight")),
    )


def shaped_terms(low_text: Column) -> Column:
    """Hyphenated, dotted or numbered tokens in order of first occurrence, generic words excluded."""
    found = F.array_distinct(F.regexp_extract_all(low_text, F.lit(SHAPED_TERM), F.lit(1)))
    return F.array_except(found, strings(vocab.GENERIC_WORDS))


def plain_words(low_text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(low_text, F.lit(PLAIN_WORD), F.lit(0)))
    return F.array_except(found, strings(vocab.GENERIC_WORDS))


def counted_words(low_text: Column, words: Column) -> Column:
    """Every word with its non-overlapping substring occurrences in the whole text."""
    return F.zip_with(words, occurrences(low_text, words), lambda w, n: F.struct(w.alias("term"), n.alias("n")))


def frequency_weights(counted: Column, top: Column) -> Column:
    """1 to 1.5 by relative frequency. ``top`` travels as an array so that it is not recomputed per word."""
    return F.zip_with(
        counted,
        F.array_repeat(top, F.size(counted)),
        lambda c, most: F.struct(
            c["term"].alias("term"), exact_round(F.lit(1.0) + c["n"] / most * F.lit(0.5), 2).alias("weight")
        ),
    )


def without_terms(entries: Column, known: Column) -> Column:
    return F.filter(entries, lambda e: ~F.array_contains(known, e["term"]))


def by_weight(entries: Column) -> Column:
    """Stable order by weight, heaviest first."""
    keyed = F.transform(
        entries, lambda e, i: F.struct((-e["weight"]).alias("k"), i.alias("i"), e["term"].alias("term"), e["weight"].alias("weight"))
    )
    return F.transform(
        F.sort_array(keyed), lambda e: F.struct(e["term"].alias("term"), e["weight"].alias("weight"))
    ).cast(TERM)


def combined_weights(skill_weights: Column) -> Column:
    """The description's terms plus the rest of the vocabulary at its reduced weight.

    Each term of the vocabulary is there once, tier after tier, so the rest of a tier is a difference of sets.
    """
    named = F.transform(skill_weights, lambda e: e["term"])

    def rest(tier: int) -> Column:
        left = F.array_except(strings([term for at, term in vocab.tiered_terms() if at == tier]), named)
        return F.transform(left, lambda t: F.struct(t.alias("term"), F.lit(vocab.TIER_WEIGHTS[tier][1]).alias("weight")))

    tiers = dict.fromkeys(tier for tier, _ in vocab.tiered_terms())
    return F.concat(skill_weights, *[rest(tier) for tier in tiers]).cast(TERM)


def weight_levels(terms: Column) -> Column:
    """Group terms by weight, heaviest first (the shape ``best_weight`` reads)."""
    weights = F.reverse(F.sort_array(F.array_distinct(F.transform(terms, lambda e: e["weight"]))))

    def level(weight: Column) -> Column:
        members = F.transform(F.filter(terms, lambda e: e["weight"] == weight), lambda e: e["term"])
        return F.struct(
            weight.alias("weight"), members.alias("terms"), F.array_join(members, LEVEL_BREAK).alias("glued")
        )

    return F.transform(weights, level)
