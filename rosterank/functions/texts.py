"""Profile text and word terms."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterank.functions.basics import WORD, strings


def profile_text(profile: Column, career: Column, skills: Column) -> Column:
    """Headline, summary, every job's title and description, skill names; empty parts are left out."""
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(profile["headline"], profile["summary"]),
        F.coalesce(F.flatten(F.transform(career, lambda j: F.array(j["title"], j["description"]))), none),
        F.coalesce(F.transform(skills, lambda s: s["name"]), none),
    )
    return F.concat_ws(" ", F.filter(parts, lambda p: p != ""))


HANGUL = (0xAC00, 0xD7A3)
#: Leading consonants, vowels and final consonants of a syllable (none first), from which the standard composes Hangul.
JAMO = tuple([chr(first + i) for i in range(n)] for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


@functools.lru_cache(maxsize=1)
def _folds() -> tuple[str, str, list[str], list[str], str]:
    """Compatibility decomposition without marks, from the character database.

    (characters, their one-character forms, characters with a longer form, those forms, a pattern of the latter and all
    Hangul syllables). Characters that fold to nothing come last in the first string, which is how ``translate`` deletes.
    """
    single, removed, longer = [], [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        # Hangul is decomposed by rule, so the database lists nothing for it
        if HANGUL[0] <= code <= HANGUL[1] or not (unicodedata.decomposition(char) or unicodedata.combining(char)):
            continue
        folded = strip_marks(char)
        if folded == char:
            continue
        if len(folded) == 1:
            single.append((char, folded))
        elif not folded:
            removed.append(char)
        else:
            longer.append((char, folded))
    return (
        "".join(c for c, _ in single) + "".join(removed),
        "".join(f for _, f in single),
        [c for c, _ in longer],
        [f for _, f in longer],
        _character_class([*(ord(c) for c, _ in longer), *range(HANGUL[0], HANGUL[1] + 1)]),
    )


def _character_class(codes: list[int]) -> str:
    spans: list[list[int]] = []
    for code in sorted(codes):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


def strip_marks(value: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


# Every character up to U+0131 folds to at most one character, the three fractions excepted. The long class of
# ``_folds`` is slow per character, so it is only tried on texts that hold something else.
BEYOND_LATIN = r"[^\x00-\xbb\xbf-\x{131}]"


def _long_form(char: Column) -> Column:
    """The fold of one character whose fold has several."""
    _, _, chars, forms, _ = _folds()
    syllable = F.ascii(char) - HANGUL[0]
    leads, vowels, finals = (strings(j) for j in (JAMO[0], JAMO[1], ["", *JAMO[2]]))
    per_vowel = 1 + len(JAMO[2])
    per_lead = per_vowel * len(JAMO[1])
    hangul = F.concat(
        F.get(leads, F.floor(syllable / per_lead).cast("int")),
        F.get(vowels, F.floor(syllable % per_lead / per_vowel).cast("int")),
        F.get(finals, (syllable % per_vowel).cast("int")),
    )
    listed = F.get(strings(forms), (F.array_position(strings(chars), char) - 1).cast("int"))
    return F.when(F.ascii(char).between(*HANGUL), hangul).otherwise(listed)


def fold_accents(column: Column) -> Column:
    """Accents and compatibility forms folded inside the JVM; ASCII texts are passed through.

    Characters with a longer fold (ligatures, fractions, Hangul) are replaced one kind after the other, those that the
    text holds only; then all others are translated at once.
    """
    chars, forms, _, _, longer = _folds()
    held = F.array_distinct(F.regexp_extract_all(column, F.lit(f"({longer})"), F.lit(1)))
    spelled = F.aggregate(held, column, lambda text, char: F.replace(text, char, _long_form(char)))
    several = column.rlike(BEYOND_LATIN) & column.rlike(longer)
    whole = F.when(several, spelled).otherwise(column)
    return F.when(column.rlike(r"[^\x00-\x7f]"), F.translate(whole, chars, forms)).otherwise(column)


NO_WORD = WORD.replace("[", "[^", 1) + "+"


def words(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(WORD + "{2,}"), F.lit(0))


def spaced_words(folded: Column) -> Column:
    """The text with one space instead of everything between its runs of word characters."""
    return F.regexp_replace(folded, NO_WORD, " ")


def with_pairs(tokens: Column) -> Column:
    """Single words followed by the pairs of neighbouring words."""
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), rest), F.slice(tokens, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.concat(tokens, pairs)
