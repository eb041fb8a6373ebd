"""The registered queries once more, as plain SQL for DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Sequence

from catalog import phrases
from rosterank import vocab

# Thresholds, points, weights, patterns, rule names and wordings below are those that results have to equal.
AS_OF = "DATE '2024-01-31'"


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def listed(values: Sequence[str | None]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def pick(values: Sequence[str | None], index: str) -> str:
    return f"({listed(values)})[CAST(({index}) % {len(values)} AS BIGINT) + 1]"


def any_in(text: str, needles: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(n)})" for n in needles) + ")"


def rounded(x: str, digits: int) -> str:
    """Half-to-even on the exact binary value of a non-negative double column."""
    s = f"1e{digits}"
    p = f"({x} * {s})"
    hi = f"(({x} * 1.34217729e8) - (({x} * 1.34217729e8) - {x}))"
    rest = f"(({hi} * {s} - {p}) + ({x} - {hi}) * {s})"
    half = f"(({p} - floor({p})) - 5e-1)"
    up = f"({half} > 0 OR ({half} = 0 AND ({rest} > 0 OR ({rest} = 0 AND floor({p}) % 2 = 1))))"
    return f"((floor({p}) + CASE WHEN {up} THEN 1e0 ELSE 0e0 END) / {s})"


def points(value: str, steps: Sequence[tuple[float, int]], op: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} {op} {b} THEN {v}e0" for b, v in steps) + " ELSE 0e0 END"


# ---------------------------------------------------------------------------------------------------
# profiles
# ---------------------------------------------------------------------------------------------------
BASE = f"""
ev AS (
  SELECT user_id,
    CAST(sum(CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rrr,
    CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS apps,
    CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS saves
  FROM events GROUP BY user_id),
numbers AS (SELECT max(user_id) + 1 + (max(user_id) + 1) // 8 AS m FROM events),
base AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p,
    CAST(o_orderdate AS DATE) AS d, o_orderstatus, o_orderpriority, rrr, apps, saves
  FROM orders CROSS JOIN numbers LEFT JOIN ev ON o_orderkey % m = user_id),
cand AS (
  SELECT k, printf('CAND_%07d', k) AS candidate_id,
    CASE WHEN k % 59 <> 0 THEN CAST(p % 131 AS DOUBLE) / 1e1 END AS yoe,
    {pick(phrases.TITLES, "c")} AS title,
    {pick(phrases.COMPANIES, "c")} AS company,
    {pick(phrases.PLACES, "k * 7 + c")} AS location,
    {pick(phrases.COUNTRIES, "c")} AS country,
    {pick(phrases.TITLES, "c")} || ' ' || o_orderpriority AS headline,
    CASE WHEN k % 37 <> 0 AND k % 5 <> 1 THEN k % 5 = 0 END AS relocate,
    CASE WHEN k % 37 <> 0 THEN CASE WHEN k % 83 = 0 THEN 'unknown' WHEN k % 79 = 0 THEN '2024-03-01'
      WHEN k % 71 <> 0 THEN CAST({AS_OF} - CAST(p % 220 AS INTEGER) AS VARCHAR) END END AS last_active,
    k % 37 <> 0 AND o_orderstatus = 'O' AS open_to_work,
    CASE WHEN k % 37 <> 0 THEN rrr END AS rrr,
    CASE WHEN k % 37 <> 0 AND k % 31 <> 0 THEN CAST(p % 100 AS DOUBLE) END AS hours,
    CASE WHEN k % 37 <> 0 AND k % 29 <> 0 THEN k * 37 % 6 * 30 END AS notice,
    CASE WHEN k % 37 <> 0 AND k % 23 <> 0 THEN CAST(p % 103 - 1 AS DOUBLE) END AS code,
    CASE WHEN k % 37 <> 0 THEN CAST(c % 11 AS DOUBLE) / 1e1 END AS interviews,
    k % 37 <> 0 AND k % 2 = 0 AS email, k % 37 <> 0 AND k % 3 = 0 AS phone,
    CASE WHEN k % 37 <> 0 THEN apps END AS apps, CASE WHEN k % 37 <> 0 THEN saves END AS saves
  FROM base),
career AS (
  SELECT k, i, {pick(phrases.ROLES, "c + i * 3")} AS title, {pick(phrases.COMPANIES, "k + i")} AS company,
    {pick(phrases.DUTIES, "k + i * 3")} AS description,
    CASE WHEN k % 997 = 0 THEN '1985-01-01' WHEN k % 991 = 0 THEN 'n/a' WHEN k % 89 = 0 THEN NULL
      ELSE CAST(d - CAST(i * 400 AS INTEGER) AS VARCHAR) END AS start_date,
    CASE WHEN (k + i) % 41 <> 0 THEN (p + i * 17) % 30 + 6 END AS months
  FROM (SELECT *, unnest(range(0, c % 5 + 1)) AS i FROM base WHERE c % 13 NOT IN (0, 1))),
skills AS (
  SELECT k, i, {pick(phrases.SKILLS, "k + i * 5 + c")} AS name, CASE WHEN k % 101 = 0 THEN 'expert' ELSE {pick(phrases.LEVELS, "k + i")} END AS level,
    CASE WHEN k % 101 = 0 THEN 0 WHEN k % 7 = 0 THEN CASE WHEN (k + i) % 2 = 0 THEN 0 END ELSE (p + i * 11) % 60 END AS months,
    (k * 13 + i * 101) % 620 AS endorsements
  FROM (SELECT *, unnest(range(0, c % 9 + 1)) AS i FROM base WHERE c % 17 <> 0))"""

TECH = ", ".join(f"({i}, {quoted(t)}, {y})" for i, (t, y) in enumerate(vocab.TECH_BIRTH_YEARS))

TRAPS = f"""
trap_career AS (
  SELECT k, CAST(sum(coalesce(months, 0)) AS BIGINT) AS total,
    coalesce(bool_or(TRY_CAST(substr(coalesce(start_date, '2000'), 1, 4) AS INTEGER) < 1990), false) AS ancient
  FROM career GROUP BY k),
trap_tech AS (
  SELECT k, arg_min('''' || name || ''' claimed ' || coalesce(months, 0) || 'mo but only exists since ' || born,
    i * 100 + ord) AS reason
  FROM skills JOIN (VALUES {TECH}) AS t(ord, tech, born)
    ON contains(lower(name), tech) AND coalesce(months, 0) > (2024 - born - 1) * 12
  GROUP BY k),
trap_skill AS (
  SELECT k, CAST(count(*) FILTER (WHERE level = 'expert' AND coalesce(months, 0) = 0) AS BIGINT) AS idle,
    bool_or(endorsements > 500 AND coalesce(months, 12) < 6) AS inflated
  FROM skills GROUP BY k),
traps AS (
  SELECT k, CASE
    WHEN coalesce(yoe, 0) > 0 AND coalesce(total, 0) > coalesce(yoe, 0) * 12e0 * 1.4e0 + 6e0
      THEN 'Career history (' || coalesce(total, 0) || 'mo) exceeds stated experience ('
        || CAST(coalesce(yoe, 0e0) AS VARCHAR) || 'yr)'
    WHEN reason IS NOT NULL THEN reason
    WHEN idle >= 3 THEN 'Expert on ' || idle || ' skills with 0 months each'
    WHEN ancient THEN 'Career start date before 1990'
    WHEN inflated THEN 'Endorsement count inconsistent with usage duration' END AS trap
  FROM cand LEFT JOIN trap_career USING (k) LEFT JOIN trap_tech USING (k) LEFT JOIN trap_skill USING (k))"""

# ---------------------------------------------------------------------------------------------------
# descriptions: every CTE below reads jd(jd_id, text)
# ---------------------------------------------------------------------------------------------------
REGION_JD = f"""
jd AS (SELECT 'JD_' || r_name AS jd_id, {pick(phrases.REGION_JDS, "r_regionkey")} AS text FROM region)"""
NATION_JD = f"""
jd AS (SELECT 'JD_' || n_name AS jd_id, {pick(phrases.NATION_YEARS, "n_nationkey")} || ' ' ||
  {pick(phrases.NATION_PLACES, "n_nationkey // 5")} || ' ' || {pick(phrases.NATION_TERMS, "n_nationkey")} AS text FROM nation)"""
DOCUMENT_JD = f"""
jd AS (SELECT CAST(doc_id AS VARCHAR) AS jd_id, {pick(phrases.JD_OPENINGS, "doc_id")} || chr(10) || text || chr(10)
  || {pick(phrases.JD_CLOSINGS, "doc_id // 3")} AS text FROM documents)"""

YEARS = "(?:years?|yrs?)"
SINGLES = (
    rf"([0-9]+)\+\s*{YEARS}",
    rf"minimum\s+([0-9]+)\s*{YEARS}",
    rf"at least\s+([0-9]+)\s*{YEARS}",
    rf"([0-9]+)\s*{YEARS}\s+(?:of\s+)?experience",
)
RANGE = rf"([0-9]+)\s*[-–to]+\s*([0-9]+)\s*{YEARS}"


def _number(pattern: str, group: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract(low, {quoted(pattern)}, {group}), '') AS BIGINT)"


VOCAB = ", ".join(
    f"({4 - tier}, {quoted(term)}, {vocab.TIER_WEIGHTS[tier][0]}e0, {vocab.TIER_WEIGHTS[tier][1]}e0)"
    for tier, term in vocab.tiered_terms()
)
SINGLE_SQL = ", ".join(_number(p, 1) for p in SINGLES)

# In ``shapes`` letters outside ASCII are underscores, so that ASCII word boundaries fall where they should.
JD_FEATURES = rf"""
low AS (
  SELECT jd_id, text, lower(text) AS low,
    regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g') AS shapes
  FROM jd),
jd_range AS (
  SELECT jd_id, CASE WHEN coalesce(lo, one) IS NULL THEN 3 ELSE greatest(coalesce(lo, one) - 1, 0) END AS exp_min,
    coalesce(hi + 2, one + 6, 12) AS exp_max
  FROM (SELECT jd_id, {_number(RANGE, 1)} AS lo, {_number(RANGE, 2)} AS hi, coalesce({SINGLE_SQL}) AS one FROM low)),
found_place AS (
  SELECT jd_id, list_filter({listed(vocab.CITIES)}, lambda x: contains(low, x)) AS found FROM low),
jd_place AS (
  SELECT DISTINCT jd_id, unnest(CASE WHEN list_has_any(found, {listed(vocab.METRO_TRIGGERS)})
    THEN list_concat(found, {listed(vocab.METRO_AREA)}) ELSE found END) AS place FROM found_place),
vocabulary(grp, term, w, w_rest) AS (VALUES {VOCAB}),
generic(term) AS (SELECT unnest({listed(vocab.GENERIC_WORDS)})),
hits AS (SELECT jd_id, grp, term, w FROM low JOIN vocabulary ON contains(low, term)),
shaped AS (
  SELECT jd_id, term, min(pos) AS pos FROM (
    SELECT jd_id, unnest(m) AS term, generate_subscripts(m, 1) AS pos FROM (
      SELECT jd_id, regexp_extract_all(shapes,
        '\b([a-z][a-z0-9]*(?:[-\.][a-z0-9]+)+|[a-z]{{2,6}}[0-9]+[a-z0-9]*)\b', 1) AS m FROM low))
  WHERE term NOT IN (SELECT term FROM generic) GROUP BY jd_id, term),
named AS (
  SELECT jd_id, grp, term, w, 0 AS pos FROM hits
  UNION ALL
  SELECT jd_id, 4, term, 1e0, pos FROM shaped ANTI JOIN hits USING (jd_id, term)),
sparse AS (
  SELECT jd_id, low, shapes FROM low LEFT JOIN (SELECT jd_id, count(*) AS n FROM named GROUP BY jd_id) USING (jd_id)
  WHERE coalesce(n, 0) < 5),
word AS (
  SELECT jd_id, term, min(pos) AS pos FROM (
    SELECT jd_id, unnest(m) AS term, generate_subscripts(m, 1) AS pos FROM (
      SELECT jd_id, regexp_extract_all(shapes, '\b[a-z][a-z0-9\-]{{2,29}}\b') AS m FROM sparse))
  WHERE term NOT IN (SELECT term FROM generic) GROUP BY jd_id, term),
word_count AS (
  SELECT jd_id, term, pos, CAST(length(low) - length(replace(low, term, '')) AS DOUBLE) / length(term) AS n
  FROM word JOIN sparse USING (jd_id)),
word_share AS (
  SELECT jd_id, term, pos, 1e0 + n / max(n) OVER (PARTITION BY jd_id) * 5e-1 AS share FROM word_count),
by_frequency AS (
  SELECT jd_id, 5, term, {rounded("share", 2)} AS w, pos FROM word_share ANTI JOIN named USING (jd_id, term)),
jd_weight AS (
  SELECT jd_id, term, w AS weight,
    row_number() OVER (PARTITION BY jd_id ORDER BY w DESC, grp, CASE WHEN grp < 4 THEN term END, pos) - 1 AS position
  FROM (SELECT * FROM named UNION ALL SELECT * FROM by_frequency)),
jd_combined AS (
  SELECT jd_id, term, weight FROM jd_weight
  UNION ALL
  SELECT jd_id, term, w_rest FROM (SELECT DISTINCT jd_id FROM jd) CROSS JOIN vocabulary
    ANTI JOIN jd_weight USING (jd_id, term))"""

# ---------------------------------------------------------------------------------------------------
# stage 1
# ---------------------------------------------------------------------------------------------------
GATED = f"""
loc AS (
  SELECT location, jd_id, bool_or(contains(lower(location), place)) AS hit
  FROM (SELECT DISTINCT coalesce(location, '') AS location FROM cand) CROSS JOIN jd_place GROUP BY ALL),
gated AS (
  SELECT jd_range.jd_id, cand.*, exp_min, exp_max, trap,
    coalesce(relocate, false) OR hit IS NULL
      OR (lower(coalesce(country, '')) IN ('india', 'in', '') AND hit) AS loc_ok,
    coalesce(yoe, 0) BETWEEN exp_min AND exp_max AS exp_ok,
    {any_in("lower(title)", vocab.DISQUALIFIED_TITLES)} AS bad_title
  FROM cand CROSS JOIN jd_range JOIN traps USING (k)
  LEFT JOIN loc ON loc.jd_id = jd_range.jd_id AND loc.location = coalesce(cand.location, '')),
fit AS (
  SELECT *, count(*) FILTER (WHERE loc_ok) OVER (PARTITION BY jd_id) AS n_strict
  FROM gated WHERE exp_ok AND NOT bad_title AND trap IS NULL),
pool AS (SELECT *, n_strict < 100 AS relaxed FROM fit WHERE loc_ok OR n_strict < 100)"""

BEHAVIOR_PARTS = {
    "recency": points(
        f"date_diff('day', TRY_CAST(CASE WHEN regexp_full_match(last_active, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"
        f" THEN last_active END AS DATE), {AS_OF})",
        ((14, 20), (30, 17), (60, 12), (90, 7), (180, 3)),
        "<=",
    ),
    "open_to_work": "CASE WHEN open_to_work THEN 15e0 ELSE 0e0 END",
    "response_rate": points("coalesce(rrr, 0)", ((0.80, 20), (0.60, 16), (0.40, 11), (0.20, 6)), ">="),
    "response_time": points("coalesce(hours, 999)", ((4, 8), (12, 6), (24, 4), (72, 2)), "<="),
    "notice": points("coalesce(notice, 90)", ((0, 12), (15, 11), (30, 10), (60, 6), (90, 2)), "<="),
    "code_activity": points("coalesce(code, -1)", ((70, 10), (40, 7), (15, 4), (0, 1)), ">="),
    "interviews": points("coalesce(interviews, 0)", ((0.80, 8), (0.60, 5), (0.40, 2)), ">="),
    "verification": "(CASE WHEN email THEN 2e0 ELSE 0e0 END + CASE WHEN phone THEN 2e0 ELSE 0e0 END)",
    "activity": "(CASE WHEN apps > 0 THEN 2e0 ELSE 0e0 END + CASE WHEN saves > 0 THEN 1e0 ELSE 0e0 END)",
}
BEHAVIOR = f"""
behavior_points AS (SELECT k, {", ".join(f"{v} AS {n}" for n, v in BEHAVIOR_PARTS.items())} FROM cand),
behavior_raw AS (
  SELECT *, least(greatest(2e-1 + ({" + ".join(BEHAVIOR_PARTS)}) / 1e2, 2e-1), 1.2e0) AS raw FROM behavior_points),
behaviors AS (SELECT * EXCLUDE (raw), {rounded("raw", 4)} AS behavior FROM behavior_raw)"""

EXPERIENCE = """CASE WHEN coalesce(yoe, 0) BETWEEN exp_min + 1 AND exp_max - 2 THEN 1e0
    WHEN coalesce(yoe, 0) >= exp_min AND coalesce(yoe, 0) < exp_min + 1 THEN 0.65e0
    WHEN coalesce(yoe, 0) > exp_max - 2 AND coalesce(yoe, 0) <= exp_max THEN 0.8e0 ELSE 0.4e0 END"""
SENIORITY = f"""CASE WHEN {any_in("lower(title)", ("junior", "intern"))} THEN 0.8e0
    WHEN {any_in("lower(title)", ("staff", "principal", "distinguished"))} THEN 1.1e0
    WHEN {any_in("lower(title)", ("lead", "head", "director", "vp"))} THEN 1.05e0
    WHEN contains(lower(title), 'senior') THEN 1e0 ELSE 0.95e0 END"""

SKILL = f"""
best AS (
  SELECT jd_id, name, max(weight) AS best FROM (SELECT DISTINCT lower(coalesce(name, '')) AS name FROM skills)
  JOIN jd_combined ON contains(name, term) OR contains(term, name) GROUP BY jd_id, name),
skill_share AS (
  SELECT pool.jd_id, k, i, coalesce(best, 0)
    * CASE level WHEN 'beginner' THEN 0.4e0 WHEN 'intermediate' THEN 0.7e0 WHEN 'advanced' THEN 1e0
        WHEN 'expert' THEN 1.2e0 ELSE 0.6e0 END
    * CASE WHEN coalesce(months, 0) > 3 THEN least(months / 24e0, 1e0) ELSE 0.3e0 END AS share
  FROM pool JOIN skills USING (k)
  LEFT JOIN best ON best.jd_id = pool.jd_id AND best.name = lower(coalesce(skills.name, ''))),
skill_raw AS (
  SELECT jd_id, k, least(list_reduce(list_prepend(0e0, list(share ORDER BY i)), lambda a, b: a + b) / 25e0, 1e0) AS raw
  FROM skill_share GROUP BY jd_id, k),
skill_scores AS (
  SELECT jd_id, k, coalesce(s, 0e0) AS skill
  FROM pool LEFT JOIN (SELECT jd_id, k, {rounded("raw", 4)} AS s FROM skill_raw) USING (jd_id, k))"""

# ---------------------------------------------------------------------------------------------------
# text similarity: reads text_pool(jd_id, text_id, text) and jd(jd_id, text)
# ---------------------------------------------------------------------------------------------------
SUMMARY = """
  UNION ALL SELECT k, 1, text FROM base JOIN documents ON k % (SELECT count(*) FROM documents) = doc_id"""


def _pool_text(summary: str) -> str:
    return f"""
profile_part AS (
  SELECT k, 0 AS ord, headline AS part FROM cand{summary}
  UNION ALL SELECT k, 10 + 2 * i, title FROM career
  UNION ALL SELECT k, 11 + 2 * i, description FROM career
  UNION ALL SELECT k, 1000 + i, name FROM skills),
text_pool AS (
  SELECT jd_id, k AS text_id, coalesce(text, '') AS text FROM pool LEFT JOIN (
    SELECT k, string_agg(part, ' ' ORDER BY ord) AS text FROM profile_part
    WHERE part <> '' AND k IN (SELECT k FROM pool) GROUP BY k) USING (k))"""


POOL_TEXT = _pool_text(SUMMARY)
COSINES = r"""
text_token AS (
  SELECT text_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS t
  FROM (SELECT DISTINCT text_id, text FROM text_pool)),
jd_token AS (SELECT jd_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS t FROM jd),
text_tf AS MATERIALIZED (
  SELECT text_id, term, count(*) AS tf FROM (
    SELECT text_id, unnest(t) AS term FROM text_token
    UNION ALL SELECT text_id, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda x: x[1] || ' ' || x[2]))
      FROM text_token WHERE len(t) > 1) GROUP BY ALL),
jd_tf AS (
  SELECT jd_id, term, count(*) AS tf FROM (
    SELECT jd_id, unnest(t) AS term FROM jd_token
    UNION ALL SELECT jd_id, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda x: x[1] || ' ' || x[2]))
      FROM jd_token WHERE len(t) > 1) GROUP BY ALL),
corpus_size AS (
  SELECT jd_id, 1 + count(text_id) AS n FROM jd LEFT JOIN text_pool USING (jd_id) GROUP BY jd_id),
stats AS (
  SELECT jd_id, term, sum(tf) AS cf, count(*) AS df, sum(own) AS own FROM (
    SELECT jd_id, term, tf, 0 AS own FROM text_pool JOIN text_tf USING (text_id)
    UNION ALL SELECT jd_id, term, tf, tf FROM jd_tf) GROUP BY jd_id, term),
terms AS MATERIALIZED (
  SELECT jd_id, term, idf, CASE WHEN own > 0 THEN (1e0 + ln(CAST(own AS DOUBLE))) * idf ELSE 0e0 END AS jw FROM (
    SELECT jd_id, term, own, ln((1e0 + n) / (1e0 + df)) + 1e0 AS idf,
      row_number() OVER (PARTITION BY jd_id ORDER BY cf DESC, term) AS place
    FROM stats JOIN corpus_size USING (jd_id)) WHERE place <= 30000),
jd_norm AS (SELECT jd_id, sqrt(sum(jw * jw)) AS jn FROM terms GROUP BY jd_id),
dots AS (
  SELECT jd_id, text_id, sum(w * jw) AS dot, sqrt(sum(w * w)) AS tn FROM (
    SELECT jd_id, text_id, (1e0 + ln(CAST(tf AS DOUBLE))) * idf AS w, jw
    FROM text_pool JOIN text_tf USING (text_id) JOIN terms USING (jd_id, term)) GROUP BY jd_id, text_id),
sims AS (
  SELECT jd_id, text_id, coalesce(CASE WHEN tn * jn > 0 THEN dot / (tn * jn) END, 0e0) AS sim
  FROM text_pool LEFT JOIN dots USING (jd_id, text_id) LEFT JOIN jd_norm USING (jd_id))"""

# divided by the pool's best, and as they are under a fixed vocabulary
TFIDF = f"""{COSINES},
shares AS (
  SELECT jd_id, text_id, sim, least(greatest(sim / CASE WHEN mx > 0 THEN mx ELSE 1e0 END, 0e0), 1e0) AS share
  FROM (SELECT *, max(sim) OVER (PARTITION BY jd_id) AS mx FROM sims)),
semantics AS (SELECT jd_id, text_id, {rounded("share", 4)} AS semantic FROM shares)"""

FIXED = f"""{COSINES},
shares AS (SELECT jd_id, text_id, least(greatest(sim, 0e0), 1e0) AS share FROM sims),
semantics AS (SELECT jd_id, text_id, {rounded("share", 4)} AS semantic FROM shares)"""

COMPOSITE = f"""
score_raw AS (
  SELECT jd_id, k, candidate_id, skill, behavior, semantic, experience, seniority, least(greatest(
    (0.45e0 * semantic + 0.55e0 * skill) * behavior * experience * seniority, 0e0), 1e0) AS raw
  FROM (SELECT *, {EXPERIENCE} AS experience, {SENIORITY} AS seniority FROM pool)
  JOIN skill_scores USING (jd_id, k) JOIN behaviors USING (k)
  JOIN (SELECT jd_id, text_id AS k, semantic FROM semantics) USING (jd_id, k)),
scored AS (SELECT * EXCLUDE (raw), {rounded("raw", 6)} AS score FROM score_raw),
selected AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY jd_id ORDER BY score DESC, candidate_id) AS INTEGER) AS rank
    FROM scored) WHERE rank <= 150)"""

STRONGEST = """
strongest AS (
  SELECT jd_id, k, name, row_number() OVER (PARTITION BY jd_id, k ORDER BY
    CASE level WHEN 'expert' THEN 4 WHEN 'advanced' THEN 3 WHEN 'intermediate' THEN 2 WHEN 'beginner' THEN 1 ELSE 0 END DESC,
    coalesce(months, 0) DESC, i) - 1 AS position
  FROM pool JOIN skills USING (k)
  WHERE EXISTS (SELECT 1 FROM jd_weight WHERE jd_weight.jd_id = pool.jd_id
    AND (contains(lower(name), term) OR contains(term, lower(name))))),
top_skill AS (SELECT * FROM strongest WHERE position < 3)"""

RELEVANT = f"""
duty AS (
  SELECT jd_id, description FROM (SELECT DISTINCT coalesce(description, '') AS description FROM career)
  JOIN jd_weight ON position < 50 AND contains(lower(description), term) GROUP BY ALL),
relevant AS (
  SELECT jd_id, k, arg_min(struct_pack(title := coalesce(career.title, '~none'), company := coalesce(career.company, '~none')), i) AS job
  FROM (SELECT jd_id, k FROM pool) JOIN career USING (k)
  JOIN duty USING (jd_id)
  WHERE i < 3 AND duty.description = coalesce(career.description, '')
    AND NOT {any_in("lower(coalesce(career.title, ''))", vocab.NON_TECH_ROLES)}
  GROUP BY jd_id, k)"""


def _percent(x: str) -> str:
    return f"CAST(CAST(round_even({x} * 1e2, 0) AS BIGINT) AS VARCHAR) || '%'"


def _reasoned(ranked: str) -> str:
    """CTE reasoned: the explanation of every row of ``ranked`` (jd_id, k, rank, skill, behavior, ...)."""
    years = "CAST(CAST(round_even(coalesce(yoe, 0e0), 0) AS BIGINT) AS VARCHAR) || 'yr exp'"
    return f"""
names AS (SELECT jd_id, k, list(name ORDER BY position) AS names FROM top_skill GROUP BY jd_id, k),
clause AS (
  SELECT r.*,
    CASE WHEN skill >= 0.6 THEN {years} || ', strong skill match (' ||
        CASE WHEN len(names) > 0 THEN array_to_string(names[1:2], ', ') ELSE 'strong skill match' END || ')'
      WHEN skill >= 0.35 THEN {years} || ' with relevant background' ||
        CASE WHEN len(names) > 0 THEN ' (' || names[1] || ')' ELSE '' END
      WHEN coalesce(yoe, 0) < exp_min + 1 THEN {years} || ' — below JD target range'
      WHEN coalesce(yoe, 0) > exp_max - 1 THEN {years} || ' — above JD target range'
      ELSE {years} || ' at ' || coalesce(nullif(company, ''), 'current company') || ', limited skill overlap' END AS c1,
    CASE WHEN job IS NOT NULL THEN 'shipped ' || CASE WHEN job.title = '~none' THEN 'relevant system' ELSE job.title END
      || ' at ' || CASE WHEN job.company = '~none' THEN 'prior company' ELSE job.company END END AS c2,
    CASE WHEN behavior >= 1.1 THEN 'active on platform, ' || {_percent("coalesce(rrr, 0)")} || ' response rate'
      WHEN behavior < 0.7 AND coalesce(rrr, 0) < 0.2
        THEN 'concern: low recruiter response rate (' || {_percent("coalesce(rrr, 0)")} || ')' END AS c3,
    CASE WHEN coalesce(notice, 90) <= 30 THEN 'available in ' || coalesce(notice, 90) || 'd'
      WHEN coalesce(notice, 90) > 90 THEN 'long notice period (' || notice || 'd) is a risk' END AS c4,
    CASE WHEN coalesce(hit, false) THEN 'based in ' || coalesce(pool.location, '')
      WHEN coalesce(relocate, false) THEN 'open to relocating from ' || coalesce(pool.location, '') END AS c5
  FROM {ranked} r JOIN (SELECT * EXCLUDE (candidate_id) FROM pool) pool USING (jd_id, k)
  LEFT JOIN names USING (jd_id, k) LEFT JOIN relevant USING (jd_id, k)
  LEFT JOIN loc ON loc.jd_id = r.jd_id AND loc.location = coalesce(pool.location, '')),
parted AS (SELECT *, list_filter([c1, c2, c3, c4, c5], lambda x: x IS NOT NULL) AS parts FROM clause),
rest AS (SELECT *, array_to_string(parts[3:], '; ') AS tail FROM parted),
reasoned AS (
  SELECT * EXCLUDE (parts, tail, c1, c2, c3, c4, c5), substr(regexp_replace(
    CASE WHEN rank <= 10 THEN 'Strong fit' WHEN rank <= 30 THEN 'Good fit' WHEN rank <= 60 THEN 'Moderate fit'
      ELSE 'Partial fit' END || ': ' || array_to_string(parts[1:2], '; ') || '.'
    || CASE WHEN len(parts) > 2 THEN ' ' || upper(tail[1]) || lower(tail[2:]) || '.' ELSE '' END,
    '\\s+', ' ', 'g'), 1, 500) AS reasoning FROM rest)"""


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


PROFILE = (BASE, TRAPS)
REGION = (REGION_JD, JD_FEATURES)
DOCUMENT = (DOCUMENT_JD, JD_FEATURES)
STAGE1 = (*PROFILE, *REGION, GATED)
NATIONS = (*PROFILE, NATION_JD, JD_FEATURES, GATED)
STAGE2 = (*STAGE1, SKILL, BEHAVIOR, POOL_TEXT, TFIDF, COMPOSITE)

PAIRED_JD = "jd AS (SELECT CAST(item_id AS VARCHAR) AS jd_id, text FROM benchmark)"
PAIRED_TEXT = """
text_pool AS (SELECT CAST(item_id AS VARCHAR) AS jd_id, doc_id AS text_id, documents.text AS text
  FROM documents JOIN benchmark ON doc_id % (SELECT count(*) FROM benchmark) = item_id)"""

VECTOR_COSINE = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"



def _dense_pool(table: str, name: str, key: str) -> str:
    return f"""
vec_pool AS (
  SELECT pool.jd_id, k, greatest({VECTOR_COSINE.format(a="a.embedding", b="b.embedding")}, 0e0) AS share FROM pool
  JOIN embeddings a ON k % (SELECT count(*) FROM embeddings) = a.vec_id
  JOIN {table} ON pool.jd_id = 'JD_' || {name} JOIN embeddings b ON b.vec_id = {key}),
semantics AS (SELECT jd_id, k AS text_id, {rounded("share", 4)} AS semantic FROM vec_pool)"""


DENSE_POOL = _dense_pool("region", "r_name", "r_regionkey")

RANKING_ROWS = """
raw_rows AS (
  SELECT 'file_' || (o_orderkey // 100) AS file, o_orderkey % 100 + 2 AS row_num,
    CASE WHEN o_orderkey % 113 = 0 THEN 5 ELSE 4 END AS n_cells,
    trim(CASE WHEN o_orderkey % 127 = 0 THEN ' ' WHEN o_orderkey % 131 = 0 THEN 'CAND_' || o_orderkey
      WHEN o_orderkey % 137 = 0 THEN printf('CAND_%07d', o_orderkey // 100 * 100 + 1)
      ELSE printf('CAND_%07d', o_orderkey) END) AS cid,
    CASE WHEN o_orderkey % 139 = 0 THEN '0' || (o_orderkey % 100 + 1) WHEN o_orderkey % 149 = 0 THEN '101'
      WHEN o_orderkey % 151 = 0 THEN '7' ELSE CAST(o_orderkey % 100 + 1 AS VARCHAR) END AS rank_text,
    CASE WHEN o_orderkey % 157 = 0 THEN 'high' WHEN o_orderkey % 163 = 0 THEN 'nan'
      WHEN CAST(floor(o_totalprice) AS BIGINT) % 29 = 0 THEN '0.5'
      WHEN o_orderkey % 3 = 1 THEN CAST(CAST(round(99e-2 - (o_orderkey % 100) * 5e-3 + 5e-3, 3) AS DECIMAL(10,3)) AS VARCHAR)
      ELSE CAST(CAST(round(99e-2 - (o_orderkey % 100) * 5e-3, 3) AS DECIMAL(10,3)) AS VARCHAR) END AS score_text
  FROM orders),
parsed AS (
  SELECT *, CASE WHEN regexp_full_match(rank_text, '0|-?[1-9][0-9]*') THEN CAST(rank_text AS BIGINT) END AS rank,
    TRY_CAST(score_text AS DOUBLE) AS score, regexp_full_match(cid, 'CAND_[0-9]{7}') AS id_ok
  FROM raw_rows WHERE n_cells = 4),
first_id AS (SELECT file, cid, min(row_num) AS first_row FROM parsed WHERE id_ok GROUP BY ALL),
first_rank AS (SELECT file, rank, min(row_num) AS first_row FROM parsed WHERE rank BETWEEN 1 AND 100 GROUP BY ALL),
led AS (
  SELECT *, lead(rank) OVER w AS next_rank, lead(score) OVER w AS next_score, lead(cid) OVER w AS next_cid
  FROM parsed WHERE rank IS NOT NULL AND score IS NOT NULL AND cid <> ''
  WINDOW w AS (PARTITION BY file ORDER BY rank, row_num)),
num AS (SELECT * FROM led WHERE NOT isnan(score) AND NOT isnan(next_score)),
found AS (
  SELECT file, 'row_count' AS rule, NULL AS row_num, CAST(count(*) AS VARCHAR) AS detail FROM raw_rows
    GROUP BY file HAVING count(*) <> 100
  UNION ALL SELECT file, 'cell_count', row_num, CAST(n_cells AS VARCHAR) FROM raw_rows WHERE n_cells <> 4
  UNION ALL SELECT file, 'id_missing', row_num, '' FROM parsed WHERE cid = ''
  UNION ALL SELECT file, 'id_format', row_num, cid FROM parsed WHERE cid <> '' AND NOT id_ok
  UNION ALL SELECT file, 'id_repeated', row_num, cid FROM parsed JOIN first_id USING (file, cid) WHERE row_num > first_row
  UNION ALL SELECT file, 'rank_not_integer', row_num, rank_text FROM parsed WHERE rank IS NULL
  UNION ALL SELECT file, 'rank_range', row_num, rank_text FROM parsed WHERE rank NOT BETWEEN 1 AND 100
  UNION ALL SELECT file, 'rank_repeated', row_num, rank_text FROM parsed JOIN first_rank USING (file, rank) WHERE row_num > first_row
  UNION ALL SELECT file, 'score_not_number', row_num, score_text FROM parsed WHERE score IS NULL
  UNION ALL SELECT file, 'rank_missing', NULL, CAST(rank AS VARCHAR) FROM (
    SELECT file, unnest(range(1, 101)) AS rank FROM (SELECT DISTINCT file FROM raw_rows)) ANTI JOIN first_rank USING (file, rank)
  UNION ALL SELECT file, 'score_order', row_num, rank || ' and ' || next_rank FROM num WHERE score < next_score
  UNION ALL SELECT file, 'tie_order', row_num, rank || ' and ' || next_rank FROM num WHERE score = next_score AND cid > next_cid)"""

LISTS = """
lists AS (
  SELECT 'list_' || (o_orderkey // 100) AS jd_id, printf('CAND_%07d', (o_orderkey * 37) % 100 + o_orderkey // 100 * 100) AS candidate_id,
    CAST(o_orderkey % 100 + 1 AS INTEGER) AS rank, (CAST(floor(o_totalprice) AS BIGINT) % 50) / 1e2 AS score FROM orders),
repaired AS (SELECT * EXCLUDE (score), min(score) OVER (PARTITION BY jd_id ORDER BY rank) AS score FROM lists)"""


def all_oracles() -> dict[str, str]:
    counts = ", ".join(
        f"CAST(count(*) FILTER (WHERE reason = '{r}') AS BIGINT) AS dropped_{r}"
        for r in ("location", "experience", "title", "honeypot")
    )
    drops = f"""SELECT jd_id, CAST(count(*) AS BIGINT) AS processed, {counts},
  CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS surviving
FROM (SELECT jd_id, CASE WHEN NOT loc_ok THEN 'location' WHEN NOT exp_ok THEN 'experience' WHEN bad_title THEN 'title'
  WHEN trap IS NOT NULL THEN 'honeypot' END AS reason FROM gated) GROUP BY jd_id"""
    oracles = {
        "gate_drop_counts": sql(drops, *STAGE1),
        "pool_drop_counts": sql(drops, *NATIONS),
        "honeypot_reasons": sql(
            "SELECT candidate_id, trap AS honeypot_reason FROM cand JOIN traps USING (k) WHERE trap IS NOT NULL", *PROFILE
        ),
        "honeypot_sample": sql(
            """SELECT jd_id, candidate_id, trap AS honeypot_reason, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY candidate_id) AS rank
  FROM gated WHERE loc_ok AND exp_ok AND NOT bad_title AND trap IS NOT NULL) WHERE rank <= 5""",
            *STAGE1,
        ),
        "relaxed_pool": sql("SELECT jd_id, candidate_id, relaxed FROM pool", *STAGE1),
        "experience_title_fit": sql(
            f"SELECT jd_id, candidate_id, {EXPERIENCE} AS experience, {SENIORITY} AS seniority FROM pool", *STAGE1
        ),
        "behavioral_multiplier": sql(
            f"SELECT candidate_id, {', '.join('b.' + n for n in BEHAVIOR_PARTS)}, behavior FROM cand JOIN behaviors b USING (k)", BASE, BEHAVIOR
        ),
        "skill_score": sql(
            "SELECT jd_id, candidate_id, skill FROM pool JOIN skill_scores USING (jd_id, k)", *STAGE1, SKILL
        ),
        "jd_experience": sql("SELECT jd_id, CAST(exp_min AS BIGINT) AS exp_min, CAST(exp_max AS BIGINT) AS exp_max FROM jd_range", *DOCUMENT),
        "jd_locations": sql("SELECT jd_id, place FROM jd_place", *DOCUMENT),
        "jd_skill_weights": sql("SELECT jd_id, CAST(position AS INTEGER) AS position, term, weight FROM jd_weight", *DOCUMENT),
        "jd_combined_weights": sql("SELECT jd_id, term, weight FROM jd_combined", *DOCUMENT),
        "tfidf_similarity": sql(
            "SELECT jd_id, text_id AS doc_id, semantic FROM semantics", PAIRED_JD, PAIRED_TEXT, TFIDF
        ),
        "dense_similarity_topk": sql(
            f"""SELECT label, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank
  FROM (SELECT label, vec_id, {rounded("share", 4)} AS similarity FROM share)) WHERE rank <= 20""",
            "anchor AS (SELECT label, arg_min(embedding, vec_id) AS jd_embedding FROM embeddings GROUP BY label)",
            f"""share AS (SELECT label, vec_id, greatest({VECTOR_COSINE.format(a="embedding", b="jd_embedding")}, 0e0) AS share
  FROM embeddings JOIN anchor USING (label))""",
        ),
        "composite_topn": sql(
            "SELECT jd_id, candidate_id, rank, experience, seniority, behavior, skill, semantic, score FROM selected", *STAGE2
        ),
        "score_range": sql(
            """SELECT jd_id, CAST(count(*) AS BIGINT) AS selected, min(score) AS low_score, max(score) AS high_score
FROM selected GROUP BY jd_id""",
            *STAGE2,
        ),
        "final_ranking": sql(
            "SELECT jd_id, candidate_id, rank, score, reasoning FROM reasoned",
            *STAGE2,
            STRONGEST,
            RELEVANT,
            "final AS (SELECT * FROM selected WHERE rank <= 100)",
            _reasoned("final"),
        ),
        "dense_ranking": sql(
            "SELECT jd_id, candidate_id, rank, score, reasoning FROM reasoned",
            *STAGE1,
            SKILL,
            BEHAVIOR,
            DENSE_POOL,
            COMPOSITE,
            STRONGEST,
            RELEVANT,
            "final AS (SELECT * FROM selected WHERE rank <= 100)",
            _reasoned("final"),
        ),
        "strongest_skills": sql(
            "SELECT jd_id, candidate_id, CAST(position AS INTEGER) AS position, name FROM top_skill JOIN cand USING (k)", *STAGE1, STRONGEST
        ),
        "first_relevant_job": sql(
            """SELECT jd_id, candidate_id, CASE WHEN job.title = '~none' THEN '' ELSE job.title END AS title,
  CASE WHEN job.company = '~none' THEN '' ELSE job.company END AS company FROM relevant JOIN cand USING (k)""",
            *STAGE1,
            RELEVANT,
        ),
        "reasoning_text": sql(
            "SELECT jd_id, candidate_id, reasoning FROM reasoned",
            *STAGE1,
            SKILL,
            BEHAVIOR,
            STRONGEST,
            RELEVANT,
            """every AS (SELECT jd_id, k, candidate_id, skill, behavior, CAST(k % 100 + 1 AS INTEGER) AS rank FROM
  (SELECT jd_id, k, candidate_id FROM pool) JOIN skill_scores USING (jd_id, k) JOIN behaviors USING (k))""",
            _reasoned("every"),
        ),
        "tie_rerank": sql(
            """SELECT jd_id, candidate_id, rank AS listed_rank, score,
  CAST(row_number() OVER (PARTITION BY jd_id ORDER BY score DESC, candidate_id) AS INTEGER) AS rank FROM repaired""",
            LISTS,
        ),
        "output_violations": sql("SELECT * FROM found", RANKING_ROWS),
    }
    words = "SELECT {id} AS id, word, CAST('0x' || md5(word)[1:8] AS BIGINT) AS code FROM (SELECT {id}, unnest(string_split_regex(lower(text), '[ \\t\\n\\x0b\\x0c\\r]+')) AS word FROM {table}) WHERE word <> ''"
    coded = "{name} AS (SELECT id, code % 64 AS at, CAST(sum(CASE WHEN code & 64 <> 0 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM ({words}) GROUP BY ALL)"
    oracles["encoded_similarity"] = sql(
        f"""SELECT item_id, doc_id, {rounded("share", 4)} AS similarity FROM encoded_share""",
        coded.format(name="coded_item", words=words.format(id="item_id", table="benchmark")),
        coded.format(name="coded_doc", words=words.format(id="doc_id", table="documents")),
        "lengths AS (SELECT 'i' AS kind, id, sqrt(sum(v * v)) AS n FROM coded_item GROUP BY id UNION ALL SELECT 'd', id, sqrt(sum(v * v)) FROM coded_doc GROUP BY id)",
        """encoded_share AS (
  SELECT item_id, doc_id, greatest(coalesce(CASE WHEN i.n > 0 AND d.n > 0 THEN dot / (d.n * i.n) END, 0e0), 0e0) AS share
  FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents) SEMI JOIN benchmark USING (item_id)
  LEFT JOIN (SELECT a.id AS doc_id, sum(a.v * b.v) AS dot FROM coded_doc a
    JOIN coded_item b ON a.at = b.at AND b.id = a.id % (SELECT count(*) FROM benchmark) GROUP BY a.id) USING (doc_id)
  LEFT JOIN lengths d ON d.kind = 'd' AND d.id = doc_id LEFT JOIN lengths i ON i.kind = 'i' AND i.id = item_id)""",
    )
    oracles["json_arrays"] = sql(
        """SELECT format, candidate_id, yoe, title, CAST(CASE WHEN c % 17 = 0 THEN -1 ELSE c % 9 + 1 END AS INTEGER) AS n_skills,
  notice FROM cand JOIN base USING (k) CROSS JOIN (VALUES ('lines'), ('array')) f(format)""",
        BASE,
    )
    oracles["malformed_lines"] = sql(
        """SELECT candidate_id, title, CAST(1 AS BIGINT) AS n FROM kinds WHERE kind = 'sound'
UNION ALL SELECT NULL, kind, count(*) FROM kinds WHERE kind NOT IN ('sound', 'blank') GROUP BY kind""",
        BASE,
        """kinds AS (SELECT *, CASE WHEN k % 11 = 3 THEN 'cut off' WHEN k % 13 = 5 THEN 'words' WHEN k % 17 = 7 THEN 'blank'
  WHEN k % 19 = 2 THEN 'no id' ELSE 'sound' END AS kind FROM cand)""",
    )
    oracles["text_files"] = sql(
        """SELECT jd_id, CAST(exp_min AS BIGINT) AS exp_min, CAST(exp_max AS BIGINT) AS exp_max, coalesce(places, '') AS places,
  CAST(length(text) AS INTEGER) AS n_chars FROM jd JOIN jd_range USING (jd_id)
LEFT JOIN (SELECT jd_id, string_agg(place, ',' ORDER BY place) AS places FROM jd_place GROUP BY jd_id) USING (jd_id)""",
        f"""
jd AS (SELECT CAST(item_id AS VARCHAR) AS jd_id, concat_ws(chr(10), {pick(phrases.JD_OPENINGS, "item_id")}, text,
  {pick(phrases.JD_CLOSINGS, "item_id // 3")}) || chr(10) AS text FROM benchmark)""",
        JD_FEATURES,
    )
    oracles["nation_status"] = sql(
        """SELECT jd_id, count(k) AS pooled, coalesce(bool_or(relaxed), true) AS relaxed, count(k) >= 100 AS enough
FROM jd LEFT JOIN pool USING (jd_id) GROUP BY jd_id""",
        *NATIONS,
    )
    oracles["nation_pool"] = sql("SELECT jd_id, candidate_id, relaxed FROM pool", *NATIONS)
    oracles["stream_stage1"] = sql(
        f"""SELECT jd_id, candidate_id, {EXPERIENCE} AS experience, {SENIORITY} AS seniority, behavior, skill, relaxed
FROM pool JOIN skill_scores USING (jd_id, k) JOIN behaviors USING (k)""",
        *NATIONS,
        SKILL,
        BEHAVIOR,
    )
    streamed = "SELECT jd_id, candidate_id, rank, score, relaxed FROM selected JOIN (SELECT jd_id, k, relaxed FROM pool) USING (jd_id, k)"
    oracles["stream_ranking"] = sql(
        streamed, *NATIONS, SKILL, BEHAVIOR, _dense_pool("nation", "n_name", "n_nationkey"), COMPOSITE
    )
    oracles["stream_tfidf_ranking"] = sql(streamed, *NATIONS, SKILL, BEHAVIOR, _pool_text(""), FIXED, COMPOSITE)
    oracles["json_roundtrip"] = sql(
        """SELECT format, candidate_id, yoe, title, CAST(CASE WHEN c % 17 = 0 THEN -1 ELSE c % 9 + 1 END AS INTEGER) AS n_skills,
  notice FROM cand JOIN base USING (k) CROSS JOIN (VALUES ('lines'), ('gzip')) f(format)""",
        BASE,
    )
    oracles["file_violations"] = """
WITH f AS (SELECT o_orderkey // 100 AS file, count(*) AS n FROM orders GROUP BY 1),
g AS (SELECT *, file % 9 AS fault, n + CASE file % 9 WHEN 1 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN 1 ELSE 0 END AS found FROM f)
SELECT file, 'header' AS rule, CAST(NULL AS VARCHAR) AS detail FROM g WHERE fault IN (1, 2)
UNION ALL SELECT file, 'row_count', CAST(found AS VARCHAR) FROM g WHERE fault <> 5 AND found <> 100
UNION ALL SELECT file, 'not_utf8', NULL FROM g WHERE fault = 5
UNION ALL SELECT file, 'file_name', NULL FROM g WHERE fault IN (1, 5, 6)"""
    oracles["csv_roundtrip"] = (
        "SELECT jd_id, count(*) AS rows, CAST(4 AS INTEGER) AS cells, CAST(0 AS BIGINT) AS violations "
        f"FROM ({oracles['dense_ranking']}) GROUP BY jd_id"
    )
    return oracles
