"""Stage-1 predicates as column expressions. None of them needs a join, a shuffle or a UDF."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterank import vocab
from rosterank.functions.basics import contains_any, literal, lowered, once, text


def in_home_country(country: Column) -> Column:
    return lowered(country).isin(*vocab.HOME_COUNTRIES)


def location_hits(location: Column, targets: Column) -> Column:
    """The targets that are substrings of the location."""
    place = lowered(location)
    return F.filter(targets, lambda t: F.contains(place, t))


def whereabouts(location: Column, country: Column, relocate: Column) -> Column:
    """What the location gate sees of a profile, as one struct, so that many gates can share it."""
    return F.struct(
        lowered(location).alias("place"),
        in_home_country(country).alias("home"),
        F.coalesce(relocate, F.lit(False)).alias("moves"),
    )


def within_reach(where: Column, targets: Column) -> Column:
    """Relocators pass before any other test; a description without targets accepts every place."""
    hit = F.exists(targets, lambda t: F.contains(where["place"], t))
    return where["moves"] | (F.size(targets) == 0) | (where["home"] & hit)


def passes_location(location: Column, country: Column, relocate: Column, targets: Column) -> Column:
    return once(whereabouts(location, country, relocate), lambda where: within_reach(where, targets))


def passes_experience(yoe: Column, exp_min: Column, exp_max: Column) -> Column:
    return F.coalesce(yoe, F.lit(0.0)).between(exp_min, exp_max)


def is_disqualified_title(title: Column) -> Column:
    return contains_any(lowered(title), vocab.DISQUALIFIED_TITLES)


def total_months(career: Column) -> Column:
    months = F.transform(career, lambda job: F.coalesce(job["duration_months"], F.lit(0).cast("bigint")))
    return F.aggregate(
        F.coalesce(months, F.array().cast("array<bigint>")),
        F.lit(0).cast("bigint"),
        lambda total, month_count: total + month_count,
    )


def tenure_overflow(career: Column, yoe: Column) -> Column:
    years = F.coalesce(yoe, F.lit(0.0))
    allowed = years * F.lit(12.0) * F.lit(1.4) + F.lit(6.0)
    return (years > 0) & (total_months(career) > allowed)


def _ages(as_of: dt.date) -> Column:
    rows = [
        {"tech": tech, "born": born, "ceiling": (as_of.year - born - 1) * 12} for tech, born in vocab.TECH_BIRTH_YEARS
    ]
    return literal(rows, "array<struct<tech:string,born:int,ceiling:bigint>>")


def _dated(skills: Column) -> Column:
    """Skills whose name holds a listed technology: one pattern test keeps the 27 comparisons to these."""
    return F.filter(skills, lambda s: contains_any(lowered(s["name"]), [t for t, _ in vocab.TECH_BIRTH_YEARS]))


def _claimed(skill: Column) -> Column:
    return F.coalesce(skill["duration_months"], F.lit(0).cast("bigint"))


def _outlives(skill: Column, age: Column) -> Column:
    return (_claimed(skill) > age["ceiling"]) & F.contains(lowered(skill["name"]), age["tech"])


def has_too_old_skill(skills: Column, as_of: dt.date) -> Column:
    ages = _ages(as_of)
    return F.coalesce(F.exists(_dated(skills), lambda s: F.exists(ages, lambda a: _outlives(s, a))), F.lit(False))


def too_old_skill(skills: Column, as_of: dt.date) -> Column:
    """Message about the first (skill, technology) pair used for longer than the technology exists."""
    ages = _ages(as_of)

    def message(skill: Column) -> Column:
        hits = F.filter(ages, lambda a: _outlives(skill, a))
        return F.concat(
            F.lit("'"), text(skill["name"]), F.lit("' claimed "), _claimed(skill).cast("string"),
            F.lit("mo but only exists since "), F.get(hits, F.lit(0))["born"].cast("string"),
        )

    return F.get(F.filter(F.transform(_dated(skills), message), lambda m: m.isNotNull()), F.lit(0))


def unused_expertise(skills: Column) -> Column:
    """Number of skills claimed at expert level without a single month of use."""
    idle = F.filter(
        skills,
        lambda s: (s["proficiency"] == "expert") & (F.coalesce(s["duration_months"], F.lit(0).cast("bigint")) == 0),
    )
    return F.coalesce(F.size(idle), F.lit(0))


def starts_before_1990(career: Column) -> Column:
    return F.coalesce(
        F.exists(
            career,
            lambda j: F.coalesce(
                F.substring(F.coalesce(j["start_date"], F.lit("2000")), 1, 4).try_cast("int") < 1990, F.lit(False)
            ),
        ),
        F.lit(False),
    )


def inflated_endorsements(skills: Column) -> Column:
    """The months default is 12 here (0 everywhere else), so a skill without months is never inflated."""
    return F.coalesce(
        F.exists(
            skills,
            lambda s: (F.coalesce(s["endorsements"], F.lit(0).cast("bigint")) > 500)
            & (F.coalesce(s["duration_months"], F.lit(12).cast("bigint")) < 6),
        ),
        F.lit(False),
    )


def is_honeypot(skills: Column, career: Column, yoe: Column, as_of: dt.date) -> Column:
    """Whether a profile breaks a rule: ``honeypot_reason`` without its texts."""
    return (
        tenure_overflow(career, yoe)
        | starts_before_1990(career)
        | inflated_endorsements(skills)
        | (unused_expertise(skills) >= 3)
        | has_too_old_skill(skills, as_of)
    )


def honeypot_reason(skills: Column, career: Column, yoe: Column, as_of: dt.date) -> Column:
    """Reason of the first rule a profile breaks; NULL for a plausible profile."""
    idle = unused_expertise(skills)
    years = F.coalesce(yoe, F.lit(0.0))
    return F.coalesce(
        F.when(
            tenure_overflow(career, yoe),
            F.concat(
                F.lit("Career history ("), total_months(career).cast("string"), F.lit("mo) exceeds stated experience ("),
                years.cast("string"), F.lit("yr)"),
            ),
        ),
        too_old_skill(skills, as_of),
        F.when(idle >= 3, F.concat(F.lit("Expert on "), idle.cast("string"), F.lit(" skills with 0 months each"))),
        F.when(starts_before_1990(career), F.lit("Career start date before 1990")),
        F.when(inflated_endorsements(skills), F.lit("Endorsement count inconsistent with usage duration")),
    )


def drop_reason(location_ok: Column, experience_ok: Column, bad_title: Column, honeypot: Column) -> Column:
    """First failing gate in the fixed order location, experience, title, honeypot; NULL for a survivor."""
    return (
        F.when(~location_ok, "location")
        .when(~experience_ok, "experience")
        .when(bad_title, "title")
        .when(honeypot, "honeypot")
    )
