"""Secret scans behind a trigram inverted index, in DataFrame operations only.

* Each rule's regular expression gives a Boolean query over trigrams (lower case) that every match must contain.
* One scan makes the postings of the trigrams that any query names: (trigram, block of documents) with the keys of the
  documents that hold it. Blocks bound a posting, however common its trigram is.
* Within a block the postings are intersected and united as each query says; what is left are candidates, and only
  their texts are searched with the expression. A rule without mandatory trigrams is searched in every text.

A document's key is its id and a hash of its text, so rows that are alike share a key and a result.

Offsets count code points, the end is exclusive. Matches are leftmost and do not overlap within a rule; a match whose
measured part is shorter than the rule's minimum is dropped after it has taken its place.

Defined cases: a null text is empty; an empty text has no spans; a null id is kept; repeated rows each get the result.
"""

from __future__ import annotations

import re._parser as regex_parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterank.llm.common import stage

#: Documents whose keys one posting holds at most, on average.
BLOCK_DOCS = 4096
#: Strings that a literal part of an expression may stand for before it is cut there.
MOST_STRINGS = 64
#: Matches whose offsets are summed in one go.
CHUNK = 512


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  #: characters of the measured group
    group: int = 0
    head: int = 0  #: characters before the closing repeated class, where the whole match is measured


#: The rules that callers compare results by.
ASSIGN = Rule(
    "assign",
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    6,
    2,
)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 20, head=4)
HEX = Rule("hex", r"[0-9a-f]+", 24)
RULES = (ASSIGN, ACCESS, HEX)

#: A query in disjunctive form: any of these sets of trigrams. The empty set is a query that everything meets.
Query = frozenset[frozenset[str]]
EVERYTHING: Query = frozenset([frozenset()])


def _least_terms(terms) -> Query:
    terms = set(terms)
    return frozenset(t for t in terms if not any(o < t for o in terms))


def _both(a: Query, b: Query) -> Query:
    return _least_terms(x | y for x, y in product(a, b))


def _of_strings(strings: set[str]) -> Query:
    return _least_terms(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _literal(node) -> set[str] | None:
    """The few strings a node can match, in lower case, or None."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 4:
        return {chr(v).lower() for _, v in value}
    if kind is op.SUBPATTERN:
        return _strings(value[3])
    if kind is op.BRANCH:
        parts = [_strings(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and value[:2] == (0, 1):
        inner = _strings(value[2])
        return None if inner is None else inner | {""}
    return None


def _strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        some = _literal(node)
        if some is None or len(out) * len(some) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, some)}
    return out


def _query(nodes) -> Query:
    out, run = EVERYTHING, {""}
    for node in nodes:
        some = _literal(node)
        if some is not None and len(run) * len(some) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, some)}
            continue
        out, run = _both(out, _of_strings(run)), {""}
        kind, value = node
        if some is not None:
            run = some
        elif kind is op.SUBPATTERN:
            out = _both(out, _query(value[3]))
        elif kind is op.BRANCH:
            out = _both(out, _least_terms(t for x in value[1] for t in _query(x)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
            out = _both(out, _query(value[2]))
    return _both(out, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """What trigrams the lower-cased text of any match contains. Only positive parts count; the rest demands nothing."""
    return _query(regex_parser.parse(pattern))


def _index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings (trigram, block, keys) of the named trigrams."""
    low = F.lower("text")
    present = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    rows = docs.select("block", F.struct("id", "hash").alias("key"), F.explode(present).alias("trigram"))
    return rows.groupBy("trigram", "block").agg(F.collect_set("key").alias("keys"))


def _named(kind: str):
    return lambda key: F.struct(key.alias("key"), F.lit(kind).alias("kind"))


def _candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, hash, kinds): the documents whose trigrams meet a rule's query, block by block."""
    block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("of"))
    none = F.array().cast(index.schema["keys"].dataType)
    posting = lambda t: F.coalesce(F.element_at("of", F.lit(t)), none)
    met = []
    for kind, query in queries.items():
        terms = [reduce(F.array_intersect, map(posting, sorted(term))) for term in sorted(query, key=sorted)]
        keys = reduce(F.array_union, terms)
        met.append(F.transform(keys, _named(kind)))
    return (
        block.select(F.explode(F.concat(*met)).alias("hit"))
        .groupBy(F.col("hit.key.id").alias("id"), F.col("hit.key.hash").alias("hash"))
        .agg(F.collect_set("hit.kind").alias("kinds"))
    )


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans as array<struct<start, rank, end, kind>>; null-free for a non-null text.

    The texts between matches and the matches themselves come from the same search, so their lengths add up to offsets.
    """
    regex = F.lit(rule.pattern)
    gap = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    size = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.char_length)
    measured = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.char_length) if rule.group else size
    kind = "array<struct<start:int,end:int,measured:int>>"
    found = F.arrays_zip(F.slice(gap, 1, F.size(size)).alias("gap"), size.alias("size"), measured.alias("measured"))

    def chunk(rows: Column, at: Column) -> Column:
        """Offsets of some matches, counted from where the chunk begins, and the chunk's whole length."""
        return F.aggregate(
            F.slice(rows, at, CHUNK),
            F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["size"]).alias("at"),
                F.array_append(
                    acc["out"],
                    F.struct(
                        (acc["at"] + x["gap"]).alias("start"),
                        (acc["at"] + x["gap"] + x["size"]).alias("end"),
                        x["measured"].alias("measured"),
                    ),
                ).alias("out"),
            ),
        )

    def chunks(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(CHUNK)), lambda at: chunk(rows, at))

    def shifted(parts: Column) -> Column:
        summed = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda acc, c: F.struct(
                (acc["at"] + c["at"]).alias("at"),
                F.array_append(
                    acc["out"],
                    F.transform(
                        c["out"],
                        lambda s: F.struct(
                            (s["start"] + acc["at"]).alias("start"),
                            (s["end"] + acc["at"]).alias("end"),
                            s["measured"].alias("measured"),
                        ),
                    ),
                ).alias("out"),
            ),
        )
        kept = F.filter(F.flatten(summed["out"]), lambda s: s["measured"] >= rule.least)
        return F.transform(
            kept,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(order).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")
            ),
        )

    # transform over one-element arrays names a value once, so that no search is written (and run) twice
    one = F.transform(F.array(found), chunks)
    spans = F.flatten(F.transform(one, shifted))
    return F.when(F.rlike(text, F.lit(_worth_searching(rule))), spans).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _worth_searching(rule: Rule) -> str:
    """A quick test before the search: a text without a long enough run of the rule's last class has no span."""
    return rule.pattern if rule.group else rule.pattern.removesuffix("+") + "{%d,}" % max(1, rule.least - rule.head)


def find_secrets(documents: DataFrame, rules: Sequence[Rule] = RULES, *, whole_rows: bool = False) -> DataFrame:
    """(doc_id, found), and ``row``, the whole document, on request: ``found`` are the spans of all rules by start, then by rule."""
    row = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if whole_rows else []
    kept = ["row"] if whole_rows else []
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *row)
    blocks = max(1, docs.count() // BLOCK_DOCS)
    keyed = docs.select(
        "doc_id",
        "text",
        *kept,
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("hash"),
    ).withColumn("block", F.pmod(F.xxhash64("id", "hash"), F.lit(blocks)))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    scanned = [(n, r) for n, r in enumerate(rules) if r.kind not in indexed]
    empty = F.array().cast(SPANS)
    out = keyed.select(
        "doc_id", *kept, "id", "hash", F.concat(empty, *[spans_of(F.col("text"), r, n) for n, r in scanned]).alias("everywhere")
    )
    if indexed:
        trigrams = sorted({t for q in indexed.values() for term in q for t in term})
        candidates = _candidates(stage(_index(keyed, trigrams), "postings"), indexed)
        found = [
            F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r, n)).otherwise(empty)
            for n, r in enumerate(rules)
            if r.kind in indexed
        ]
        verified = (
            keyed.join(candidates, ["id", "hash"])
            .select("id", "hash", F.concat(*found).alias("verified"))
            .where(F.size("verified") > 0)
            .dropDuplicates(["id", "hash"])
        )
        out = out.join(verified, ["id", "hash"], "left")
    else:
        out = out.withColumn("verified", empty)
    return out.select("doc_id", *kept, F.array_sort(F.concat("everywhere", F.coalesce("verified", empty))).alias("found"))


def redact(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``documents`` with every found span replaced by its kind in brackets; ``n_chars`` follows the text."""
    found = find_secrets(documents, rules, whole_rows=True)
    text = F.col("row.text")

    def step(acc: Column, span: Column) -> Column:
        inside = span["start"] < acc["at"]  # overlaps a span before it, whose name stands for both
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), span["start"] - acc["at"]))
        name = F.when(inside, F.lit("")).otherwise(F.concat(F.lit("["), span["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.concat(acc["out"], gap, name).alias("out"))

    whole = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    one = F.transform(F.array(whole), lambda w: F.concat(w["out"], F.substring(text, w["at"] + 1, F.char_length(text))))
    cleaned = F.when(F.size("found") > 0, F.element_at(one, 1)).otherwise(text).alias("text")
    rows = found.select("row", cleaned)
    length = F.when(F.col("row.n_chars").isNotNull(), F.char_length("text").cast("long")) if "n_chars" in documents.columns else None
    values = {"text": F.col("text"), "n_chars": length}
    return rows.select(*[values[c].alias(c) if c in values else F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of the base rules in every document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    told = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(told, 256).alias("base_sha256"),
        told.alias("spans"),
    )


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""(SELECT r, '{kind}' AS kind, {rank} AS rank, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      'start': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
      'size': length(m[i]), 'part': length(g[i])}}), lambda s: s.part >= {least})) AS s
    FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g,
      regexp_split_to_array(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}')))"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS (
  {_sql_spans("assign", 0, f"({_WORDS})[" + chr(34) + "']?\\x20*[:=]\\x20*[" + chr(34) + "']?([A-Za-z0-9+/_.=-]+)", 2, 6)}
  UNION ALL {_sql_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)}
  UNION ALL {_sql_spans("hex", 2, "[0-9a-f]+", 0, 24)}
), a AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', s.start, ':', s.start + s.size), ',' ORDER BY s.start, rank) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
