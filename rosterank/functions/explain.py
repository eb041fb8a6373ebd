"""The explanation sentence, built from columns of a ranked profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterank import vocab
from rosterank.functions.basics import BLANK, contains_any, lowered, text

STRONG, RELEVANT = 0.6, 0.35
QUOTED_TERMS = 50


def strongest_skills(skills: Column, skill_weights: Column) -> Column:
    """Names of up to three matching skills, by (proficiency, months) descending, input order on ties."""
    level = lambda s: (
        F.when(s["proficiency"] == "expert", 4)
        .when(s["proficiency"] == "advanced", 3)
        .when(s["proficiency"] == "intermediate", 2)
        .when(s["proficiency"] == "beginner", 1)
        .otherwise(0)
    )
    keyed = F.transform(
        skills,
        lambda s, i: F.struct(
            (-level(s)).alias("level"),
            (-F.coalesce(s["duration_months"], F.lit(0).cast("bigint"))).alias("months"),
            i.alias("position"),
            text(s["name"]).alias("name"),
            lowered(s["name"]).alias("low"),
        ),
    )
    matching = F.filter(
        keyed,
        lambda s: F.exists(
            skill_weights, lambda e: F.contains(s["low"], e["term"]) | F.contains(e["term"], s["low"])
        ),
    )
    best = F.slice(F.sort_array(matching), 1, 3)
    return F.coalesce(F.transform(best, lambda s: s["name"]), F.array().cast("array<string>"))


def first_relevant_job(career: Column, skill_weights: Column) -> Column:
    """The first relevant one of the three latest jobs; NULL when there is none.

    Titles and descriptions are lowered once per job, before the term lambda sees them.
    """
    prepared = F.transform(
        F.slice(career, 1, 3),
        lambda j: F.struct(
            j["title"].alias("title"),
            j["company"].alias("company"),
            contains_any(lowered(j["title"]), vocab.NON_TECH_ROLES).alias("other_role"),
            lowered(j["description"]).alias("low"),
        ),
    )
    terms = F.slice(skill_weights, 1, QUOTED_TERMS)
    fits = F.filter(
        prepared, lambda j: ~j["other_role"] & F.exists(terms, lambda e: F.contains(j["low"], e["term"]))
    )
    return F.get(fits, F.lit(0))


def whole(number: Column) -> Column:
    """A number without decimals, half to even."""
    return F.rint(number).cast("bigint").cast("string")


def percent(rate: Column) -> Column:
    return F.concat(whole(rate * F.lit(100.0)), F.lit("%"))


def skill_clause(yoe: Column, skill: Column, names: Column, company: Column, exp_min: Column, exp_max: Column) -> Column:
    years = F.coalesce(yoe, F.lit(0.0))
    lead = F.concat(whole(years), F.lit("yr exp"))
    listed = F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, 2), ", ")).otherwise("strong skill match")
    hint = F.when(F.size(names) > 0, F.concat(F.lit(" ("), F.get(names, F.lit(0)), F.lit(")"))).otherwise("")
    employer = F.when(text(company) != "", company).otherwise("current company")
    return (
        F.when(skill >= STRONG, F.concat(lead, F.lit(", strong skill match ("), listed, F.lit(")")))
        .when(skill >= RELEVANT, F.concat(lead, F.lit(" with relevant background"), hint))
        .when(years < exp_min + 1, F.concat(lead, F.lit(" — below JD target range")))
        .when(years > exp_max - 1, F.concat(lead, F.lit(" — above JD target range")))
        .otherwise(F.concat(lead, F.lit(" at "), employer, F.lit(", limited skill overlap")))
    )


def career_clause(job: Column) -> Column:
    return F.when(
        job.isNotNull(),
        F.concat(
            F.lit("shipped "), F.coalesce(job["title"], F.lit("relevant system")),
            F.lit(" at "), F.coalesce(job["company"], F.lit("prior company")),
        ),
    )


def engagement_clause(behavior: Column, response_rate: Column) -> Column:
    rate = F.coalesce(response_rate, F.lit(0.0))
    return F.when(
        behavior >= 1.1, F.concat(F.lit("active on platform, "), percent(rate), F.lit(" response rate"))
    ).when(
        (behavior < 0.7) & (rate < 0.20),
        F.concat(F.lit("concern: low recruiter response rate ("), percent(rate), F.lit(")")),
    )


def notice_clause(notice_days: Column) -> Column:
    days = F.coalesce(notice_days, F.lit(90).cast("bigint"))
    shown = days.cast("string")
    return F.when(days <= 30, F.concat(F.lit("available in "), shown, F.lit("d"))).when(
        days > 90, F.concat(F.lit("long notice period ("), shown, F.lit("d) is a risk"))
    )


def location_clause(location: Column, relocate: Column, targets: Column) -> Column:
    place = text(location)
    low = F.lower(place)
    return F.when(
        F.exists(targets, lambda t: F.contains(low, t)), F.concat(F.lit("based in "), place)
    ).when(F.coalesce(relocate, F.lit(False)), F.concat(F.lit("open to relocating from "), place))


def fit_label(rank: Column) -> Column:
    return F.when(rank <= 10, "Strong fit").when(rank <= 30, "Good fit").when(rank <= 60, "Moderate fit").otherwise("Partial fit")


def sentences(rank: Column, clauses: list[Column]) -> Column:
    """Label and first two clauses, then the rest with only its first letter in upper case; 500 characters."""
    parts = F.filter(F.array(*clauses), lambda c: c.isNotNull())
    rest = F.array_join(F.slice(parts, F.lit(3), F.lit(len(clauses))), "; ")
    first = F.concat(fit_label(rank), F.lit(": "), F.array_join(F.slice(parts, 1, 2), "; "), F.lit("."))
    second = F.when(
        F.size(parts) > 2,
        F.concat(F.lit(" "), F.upper(F.substring(rest, 1, 1)), F.lower(F.substr(rest, F.lit(2))), F.lit(".")),
    ).otherwise("")
    return F.substring(F.regexp_replace(F.concat(first, second), BLANK + "+", " "), 1, 500)
