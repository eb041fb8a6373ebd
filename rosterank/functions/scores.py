"""Row-level scores: behaviour, experience, seniority, skills and their composite."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterank.functions.basics import clamp, contains_any, exact_round, lowered, steps, text


def experience_fit(yoe: Column, exp_min: Column, exp_max: Column) -> Column:
    years = F.coalesce(yoe, F.lit(0.0))
    low, high = exp_min + 1, exp_max - 2
    return (
        F.when(years.between(low, high), 1.0)
        .when((years >= exp_min) & (years < low), 0.65)
        .when((years > high) & (years <= exp_max), 0.80)
        .otherwise(0.40)
    )


def seniority(title: Column) -> Column:
    name = lowered(title)
    return (
        F.when(contains_any(name, ("junior", "intern")), 0.80)
        .when(contains_any(name, ("staff", "principal", "distinguished")), 1.10)
        .when(contains_any(name, ("lead", "head", "director", "vp")), 1.05)
        .when(F.contains(name, F.lit("senior")), 1.0)
        .otherwise(0.95)
    )


def recency_points(last_active: Column, as_of: dt.date) -> Column:
    """ISO dates only; anything else scores 0, a future date scores as active today."""
    day = F.when(last_active.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(last_active, "yyyy-MM-dd"))
    age = F.datediff(F.lit(as_of), day)
    return steps(age, ((14, 20), (30, 17), (60, 12), (90, 7), (180, 3)), at_most=True)


def behavior_points(signals: Column, as_of: dt.date) -> dict[str, Column]:
    """The nine behaviour components, 100 points in total."""

    def rate(field: str, default: float) -> Column:
        return F.coalesce(signals[field], F.lit(default))

    def flag(test: Column, points: float) -> Column:
        return F.when(test, F.lit(points)).otherwise(F.lit(0.0))

    return {
        "recency": recency_points(text(signals["last_active_date"]), as_of),
        "open_to_work": flag(signals["open_to_work_flag"], 15.0),
        "response_rate": steps(
            rate("recruiter_response_rate", 0.0), ((0.80, 20), (0.60, 16), (0.40, 11), (0.20, 6)), at_most=False
        ),
        "response_time": steps(rate("avg_response_time_hours", 999.0), ((4, 8), (12, 6), (24, 4), (72, 2)), at_most=True),
        "notice": steps(rate("notice_period_days", 90), ((0, 12), (15, 11), (30, 10), (60, 6), (90, 2)), at_most=True),
        "code_activity": steps(rate("github_activity_score", -1.0), ((70, 10), (40, 7), (15, 4), (0, 1)), at_most=False),
        "interviews": steps(rate("interview_completion_rate", 0.0), ((0.80, 8), (0.60, 5), (0.40, 2)), at_most=False),
        "verification": flag(signals["verified_email"], 2.0) + flag(signals["verified_phone"], 2.0),
        "activity": flag(signals["applications_submitted_30d"] > 0, 2.0)
        + flag(signals["saved_by_recruiters_30d"] > 0, 1.0),
    }


def behavior_multiplier(points: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for part in points.values():
        total = total + part
    return exact_round(clamp(F.lit(0.2) + total / F.lit(100.0), 0.2, 1.2), 4)


def proficiency_multiplier(proficiency: Column) -> Column:
    return (
        F.when(proficiency == "beginner", 0.4)
        .when(proficiency == "intermediate", 0.7)
        .when(proficiency == "advanced", 1.0)
        .when(proficiency == "expert", 1.2)
        .otherwise(0.6)
    )


def duration_trust(months: Column) -> Column:
    used = F.coalesce(months, F.lit(0).cast("bigint"))
    return F.when(used > 3, F.least(used / F.lit(24.0), F.lit(1.0))).otherwise(F.lit(0.3))


LEVEL_BREAK = "\x01"


def best_weight(name: Column, levels: Column) -> Column:
    """Highest weight of a term that contains the name or is contained in it; NULL when no term matches.

    ``levels`` holds the terms grouped by weight, heaviest first. "Name inside some term" is a single
    substring test against all terms of a level glued with a break character that no term contains.
    """
    hit = F.filter(
        levels,
        lambda level: (F.contains(level["glued"], name) & ~F.contains(name, F.lit(LEVEL_BREAK)))
        | F.exists(level["terms"], lambda term: F.contains(name, term)),
    )
    return F.get(hit, F.lit(0))["weight"]


def skill_total(skills: Column, levels: Column) -> Column:
    """Sum over the skills in array order, so the double result does not depend on the plan.

    Names are lowered in a pass of their own: a lambda would lower them again for every term.
    """
    prepared = F.transform(
        skills,
        lambda s: F.struct(
            lowered(s["name"]).alias("name"),
            proficiency_multiplier(s["proficiency"]).alias("proficiency"),
            duration_trust(s["duration_months"]).alias("trust"),
        ),
    )
    shares = F.transform(
        prepared,
        lambda s: F.coalesce(best_weight(s["name"], levels) * s["proficiency"] * s["trust"], F.lit(0.0)),
    )
    return F.aggregate(F.coalesce(shares, F.array().cast("array<double>")), F.lit(0.0), lambda acc, x: acc + x)


def skill_score(total: Column) -> Column:
    return exact_round(F.least(total / F.lit(25.0), F.lit(1.0)), 4)


def composite(semantic: Column, skill: Column, behavior: Column, experience: Column, title: Column) -> Column:
    base = F.lit(0.45) * semantic + F.lit(0.55) * skill
    return exact_round(clamp(base * behavior * experience * title, 0.0, 1.0), 6)
