"""The registered queries: every one reads whole driver tables through the adapter."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import adapter
from catalog.adapter import AS_OF
from rosterank.functions import scores
from rosterank.operators.dense import dense_score, encode_texts, with_cosine
from rosterank.operators.lookup import join_lookup
from rosterank.operators.tfidf import fit_vocabulary, load_vocabulary, save_vocabulary, tfidf_similarity
from rosterank.operators.topk import top_per_group
from rosterank.plans import jobs, pool, quality, ranking
from rosterank.sources.candidates import load_candidates, split_malformed
from rosterank.sources.job_texts import load_job_texts
from rosterank.sources.ranking_csv import read_ranking_rows, write_ranking_csv
from rosterank.staging import stage, staging_root
from rosterank.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
FILE_ROWS = 50_000  # profiles of one compressed file, which no reader can split


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.extract_jd_features(adapter.region_jds(spark, sf_dir))


def _pool(spark: SparkSession, sf_dir: str, *, summaries: bool = False) -> tuple[DataFrame, DataFrame]:
    features = _features(spark, sf_dir)
    return pool.build_pool(adapter.candidates(spark, sf_dir, summaries=summaries), features, AS_OF), features


def gate_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.drop_counts(adapter.candidates(spark, sf_dir), _features(spark, sf_dir), AS_OF)


def pool_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' drop counts that come with their pools, from the scan that writes these."""
    return pool.pool_with_counts(adapter.candidates(spark, sf_dir), _nation_features(spark, sf_dir), AS_OF)[1]


def honeypot_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.honeypot_reasons(adapter.candidates(spark, sf_dir), AS_OF)


def honeypot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.honeypot_sample(adapter.candidates(spark, sf_dir), _features(spark, sf_dir), AS_OF)


def relaxed_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.pool_pairs(_pool(spark, sf_dir)[0])


def experience_title_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    survivors, features = _pool(spark, sf_dir)
    return ranking.profile_scores(survivors, features, AS_OF).drop("behavior")


def skill_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    survivors, features = _pool(spark, sf_dir)
    pairs = pool.pool_pairs(survivors).drop("relaxed")
    return ranking.pool_scores(survivors, jobs.with_weight_levels(features), pairs)


def behavioral_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ranking.behavior_columns(F.col("signals"), AS_OF)
    rows = adapter.candidates(spark, sf_dir).select("candidate_id", *[c.alias(n) for n, c in parts.items()])
    return rows.withColumn("behavior", scores.behavior_multiplier({n: F.col(n) for n in parts}))


def _document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.extract_jd_features(adapter.document_jds(spark, sf_dir))


def jd_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.feature_columns(adapter.document_jds(spark, sf_dir)).select("jd_id", "exp_min", "exp_max")


def jd_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = jobs.feature_columns(adapter.document_jds(spark, sf_dir))
    return features.select("jd_id", F.explode("locations").alias("place"))


def jd_skill_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _document_features(spark, sf_dir).select("jd_id", F.posexplode("skill_weights").alias("position", "e"))
    return rows.select("jd_id", "position", "e.term", "e.weight")


def jd_combined_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.combined_weight_rows(_document_features(spark, sf_dir))


def tfidf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the benchmark passage its id falls on; the corpus of a passage is its documents."""
    items = adapter.table(spark, sf_dir, "benchmark")
    n_items = items.agg(F.count(F.lit(1))).scalar()
    documents = adapter.spread(adapter.table(spark, sf_dir, "documents"))
    texts = documents.select(
        F.col("doc_id").alias("text_id"), F.array((F.col("doc_id") % n_items).cast("string")).alias("jd_ids"), "text"
    )
    similar = tfidf_similarity(texts, items.select(F.col("item_id").cast("string").alias("jd_id"), "text"))
    return similar.select("jd_id", F.col("text_id").alias("doc_id"), "semantic")


def dense_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: the vectors closest to the label's first vector."""
    vectors = adapter.table(spark, sf_dir, "embeddings")
    anchors = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("jd_embedding"))
    paired = join_lookup(vectors.select("label", "vec_id", "embedding"), stage(anchors, "anchors"), ["label"], spread_by="vec_id")
    cosines = with_cosine(paired, "embedding", "jd_embedding", "cosine")
    scored = cosines.select("label", "vec_id", dense_score(F.col("cosine")).alias("similarity"))
    order = [F.desc("similarity"), F.asc("vec_id")]
    return top_per_group(scored, ["label"], order, 20, spread_by=["vec_id"])


def make_hash_encoder() -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic stand-in for a sentence encoder: signed word hashing into 64 dimensions."""
    import hashlib
    import re

    def code(word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)

    def encode(texts: np.ndarray) -> np.ndarray:
        words = [re.split("[ \t\n\x0b\x0c\r]+", str(t).lower()) for t in texts]
        known, place = np.unique(np.array([w for some in words for w in some], object), return_inverse=True)
        codes = np.array([code(w) if w else 0 for w in known], np.int64)[place]
        sign = np.where(codes & 64, 1.0, -1.0) * np.array([w != "" for w in known], float)[place]
        rows = np.repeat(np.arange(len(words)), [len(some) for some in words])
        flat = np.bincount(rows * 64 + codes % 64, sign, len(words) * 64)
        return flat.reshape(len(words), 64).astype(np.float32)

    return encode


def encoded_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark passages through the encoder hook, compared pair by pair as in ``tfidf_pairs``."""
    items = adapter.table(spark, sf_dir, "benchmark")
    n_items = items.agg(F.count(F.lit(1))).scalar()
    coded_items = encode_texts(items, "text", make_hash_encoder, output="item_vector").select("item_id", "item_vector")
    texts = adapter.spread(adapter.table(spark, sf_dir, "documents")).select("doc_id", "text")
    documents = encode_texts(texts, "text", make_hash_encoder).withColumn("item_id", F.col("doc_id") % n_items)
    pairs = join_lookup(documents.select("item_id", "doc_id", "embedding"), stage(coded_items, "items"), ["item_id"], spread_by="doc_id")
    cosines = with_cosine(pairs, "embedding", "item_vector", "cosine")
    return cosines.select("item_id", "doc_id", dense_score(F.col("cosine")).alias("similarity"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    survivors, features = _pool(spark, sf_dir, summaries=True)
    scored = ranking.score_pool(survivors, jobs.with_weight_levels(features), AS_OF)
    return ranking.select_top(scored)


def composite_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select(
        "jd_id", "candidate_id", "rank", "experience", "seniority", "behavior", "skill", "semantic", "score"
    )


def score_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score_range(_selected(spark, sf_dir))


def final_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_candidates(
        adapter.candidates(spark, sf_dir, summaries=True), adapter.region_jds(spark, sf_dir), AS_OF
    )


def dense_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_candidates(
        adapter.candidates(spark, sf_dir, embeddings=True),
        adapter.region_jds_with_vectors(spark, sf_dir),
        AS_OF,
        semantic="dense",
    )


def strongest_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_skills(*_pool(spark, sf_dir))


def first_relevant_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.relevant_jobs(*_pool(spark, sf_dir))


def reasoning_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explanation of every pooled pair, with a rank taken from the candidate's number."""
    survivors, features = _pool(spark, sf_dir)
    number = F.substring("candidate_id", 6, 20).cast("bigint")
    rows = ranking.profile_scores(survivors, features, AS_OF)
    ranked = ranking.pool_scores(survivors, jobs.with_weight_levels(features), rows).select(
        "jd_id", "candidate_id", "skill", "behavior", (number % 100 + 1).cast("int").alias("rank")
    )
    return ranking.explain_pairs(survivors, ranked, features).select("jd_id", "candidate_id", "reasoning")


def tie_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score repair and tie order over lists of 100 orders each."""
    k = F.col("o_orderkey")
    lists = adapter.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("list_"), F.floor(k / 100).cast("string")).alias("jd_id"),
        F.format_string("CAND_%07d", k * 37 % 100 + F.floor(k / 100) * 100).alias("candidate_id"),
        (k % 100 + 1).cast("int").alias("rank"),
        (F.floor("o_totalprice") % 50 / F.lit(100.0)).alias("score"),
    )
    return ranking.rerank_ties(ranking.repair_scores(lists))


def output_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(adapter.ranking_rows(spark, sf_dir))


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles written as JSON lines and as gzip JSON lines, read back through the loader.

    Gzip files are bounded, so they are read by many tasks as they are: no profile is shuffled.
    """
    rows = adapter.candidates(spark, sf_dir)
    plain, packed = _fresh(spark, "lines"), _fresh(spark, "gzip")
    rows.write.json(plain)
    rows.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").json(packed)
    lines = load_candidates(spark, f"{plain}/*.json", json_lines=True)
    gzipped = load_candidates(spark, f"{packed}/*.gz", spread=False)
    read = lines.withColumn("format", F.lit("lines")).unionByName(gzipped.withColumn("format", F.lit("gzip")))
    return read.select(
        "format",
        "candidate_id",
        F.col("profile.years_of_experience").alias("yoe"),
        F.col("profile.current_title").alias("title"),
        F.coalesce(F.size("skills"), F.lit(-1)).alias("n_skills"),
        F.col("signals.notice_period_days").alias("notice"),
    )


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles in JSON arrays, one per 100 orders, and in JSON lines; each is read by what its path ends with.

    Both are written compressed. Profiles are made where their array is: it is the orders that are shuffled.
    """
    rows = adapter.candidates(spark, sf_dir)
    whole = F.struct(*[c for c in rows.columns])
    grouped = adapter.candidates(spark, sf_dir, together=100)
    packed = grouped.groupBy("file").agg(F.collect_list(F.to_json(whole)).alias("l"))  # 100 at most
    arrays, lines = _fresh(spark, "arrays"), _fresh(spark, "lines") + ".jsonl"
    packed.select("file", F.concat(F.lit("["), F.array_join("l", ",\n"), F.lit("]")).alias("value")).write.partitionBy("file").option("compression", "gzip").text(arrays)
    rows.select(F.to_json(whole).alias("value")).write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").text(lines)
    read = load_candidates(spark, f"{arrays}/*").withColumn("format", F.lit("array"))
    read = read.unionByName(load_candidates(spark, lines).withColumn("format", F.lit("lines")))
    return read.select(
        "format", "candidate_id", F.col("profile.years_of_experience").alias("yoe"), F.col("profile.current_title").alias("title"),
        F.coalesce(F.size("skills"), F.lit(-1)).alias("n_skills"), F.col("signals.notice_period_days").alias("notice"),
    )


def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which some are cut off, no JSON, blank, or without an id: sound profiles, and how many others."""
    rows = adapter.candidates(spark, sf_dir)
    number = F.substring("candidate_id", 6, 20).cast("bigint")
    line = F.to_json(F.struct(*[c for c in rows.columns]))
    nameless = F.to_json(F.struct(*[c for c in rows.columns if c != "candidate_id"]))
    spoilt = (
        F.when(number % 11 == 3, F.substring(line, 1, 40)).when(number % 13 == 5, F.lit("no JSON at all"))
        .when(number % 17 == 7, F.lit("  ")).when(number % 19 == 2, nameless).otherwise(line)
    )
    path = _fresh(spark, "spoilt") + ".ndjson"
    rows.select(spoilt.alias("value")).write.text(path)
    sound, others = split_malformed(load_candidates(spark, path, keep_malformed=True))
    told = sound.select("candidate_id", F.col("profile.current_title").alias("title"), F.lit(1).cast("bigint").alias("n"))
    kind = F.when(F.col("raw") == "no JSON at all", "words").when(F.col("raw").startswith('{"candidate_id"'), "cut off").otherwise("no id")
    count = others.groupBy(kind.alias("title")).agg(F.count(F.lit(1)).alias("n"))
    return told.unionByName(count.select(F.lit(None).cast("string").alias("candidate_id"), "title", "n"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as text files between an opening and a closing line, read as descriptions: their years and places."""
    items = adapter.table(spark, sf_dir, "benchmark")
    folder = _fresh(spark, "texts")
    adapter.item_jds(items).write.partitionBy("item_id").text(folder)
    jds = load_job_texts(spark, f"{folder}/*/*.txt", name_pattern="/item_id=([0-9]+)/")
    found = jobs.feature_columns(jds)
    return found.select("jd_id", "exp_min", "exp_max", F.concat_ws(",", "locations").alias("places"), F.char_length("text").alias("n_chars"))


def nation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the nations' descriptions are relaxed, and which stay short."""
    features = _nation_features(spark, sf_dir)
    return pool.pool_status(pool.build_pool(adapter.candidates(spark, sf_dir), features, AS_OF), features)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense ranking written as one CSV per description, read back and checked: no violation is expected."""
    out = _fresh(spark, "ranking")
    write_ranking_csv(dense_ranking(spark, sf_dir), out, by_description=True)
    jd = F.regexp_extract("file", "jd_id=([^/]*)/", 1).alias("jd_id")
    rows = read_ranking_rows(spark, f"{out}/*/*.csv").groupBy(jd)
    faults = quality.check_files(spark, f"{out}/*/*.csv").groupBy(jd).agg(F.count(F.lit(1)).alias("faults"))
    counted = rows.agg(F.count_if(F.col("row_num") > 1).alias("rows"), F.max("n_cells").alias("cells"))
    return counted.join(faults, "jd_id", "left").select("jd_id", "rows", "cells", F.coalesce("faults", F.lit(0)).alias("violations"))


def file_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files derived from the orders, with faults of whole files, written and checked: name, header, encoding, rows."""
    lines = adapter.ranking_lines(spark, sf_dir).repartition("file").sortWithinPartitions("file", "place")
    named, unnamed = _fresh(spark, "files"), _fresh(spark, "files")
    bare = {"quote": "\u0000", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "sep": "\u0001"}
    kept = ~F.col("fault").isin(1, 5, 6)  # a CSV writer leaves no blank line and no broken byte: these are text files
    lines.filter(kept).select("file", "line").write.partitionBy("file").options(**bare).csv(named)
    lines.filter(~kept).select("file", "line").write.partitionBy("file").text(unnamed)
    found = quality.check_files(spark, f"{named}/*/*.csv").unionByName(quality.check_files(spark, f"{unnamed}/*/*.txt"))
    number = F.regexp_extract("file", "file=([0-9]+)/", 1).cast("bigint")
    whole = found.filter(F.col("rule").isin("file_name", "not_utf8", "header", "row_count"))
    detail = F.when(F.col("rule") == "row_count", F.col("detail"))
    return whole.select(number.alias("file"), "rule", detail.alias("detail"))


def _nation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.extract_jd_features(adapter.nation_jds(spark, sf_dir))


def nation_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pools of the nations' descriptions; those with few located profiles are relaxed."""
    people = adapter.candidates(spark, sf_dir)
    return pool.pool_pairs(pool.build_pool(people, _nation_features(spark, sf_dir), AS_OF))


def _arriving(spark: SparkSession, people: DataFrame, *, embeddings: bool = False) -> DataFrame:
    """The profiles as a stream of files, a third of them per batch, so that pools grow from batch to batch.

    There are 12 files at least. They are written where the profiles are made, and compressed: profiles are never shuffled.
    """
    inbox = _fresh(spark, "inbox")
    each = min(FILE_ROWS, max(1, -(-people.count() // 12)))
    people.write.option("maxRecordsPerFile", each).option("compression", "gzip").json(inbox)
    files = len(spark.read.text(inbox).inputFiles())
    return arrivals.read_arrivals(spark, inbox, embeddings=embeddings, files_per_batch=max(1, -(-files // 3)))


def stream_stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles arriving as JSON files, gated and scored as a stream; pools are settled when the scores are read."""
    out = _fresh(spark, "scores")
    features = stage(jobs.with_weight_levels(_nation_features(spark, sf_dir)), "jd-levels")
    scored = arrivals.score_arrivals(_arriving(spark, adapter.candidates(spark, sf_dir)), features, AS_OF)
    arrivals.append_scores(scored, out, _fresh(spark, "stream-log")).awaitTermination()
    return arrivals.settle(spark.read.schema(scored.schema).parquet(out))


def stream_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense ranking kept up to date over arriving files, a few files per batch."""
    vectors = stage(adapter.nation_vectors(spark, sf_dir), "jd-vectors")
    features = stage(jobs.with_weight_levels(_nation_features(spark, sf_dir)).join(vectors, "jd_id"), "jd-levels")
    store = _fresh(spark, "best")
    stream = _arriving(spark, adapter.candidates(spark, sf_dir, embeddings=True), embeddings=True)
    arrivals.refresh_ranking(stream, features, AS_OF, store, _fresh(spark, "stream-log")).awaitTermination()
    return arrivals.latest_ranking(spark, store).select("jd_id", "candidate_id", "rank", "score", "relaxed")


def stream_tfidf_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking by text over arriving files, under a vocabulary fitted on the pool and saved before."""
    features = stage(jobs.with_weight_levels(_nation_features(spark, sf_dir)), "jd-levels")
    people = adapter.candidates(spark, sf_dir)
    texts = ranking.pool_texts(pool.build_pool(people, features, AS_OF))
    saved, store = _fresh(spark, "vocabularies"), _fresh(spark, "best")
    version = save_vocabulary(fit_vocabulary(texts, features.select("jd_id", "text")), saved)
    scorer = arrivals.tfidf_scorer(features, load_vocabulary(spark, saved, version), AS_OF)
    query = arrivals.refresh_ranking(
        _arriving(spark, people), features, AS_OF, store, _fresh(spark, "stream-log"), scorer=scorer, basis=f"vocabulary {version}"
    )
    query.awaitTermination()
    return arrivals.latest_ranking(spark, store).select("jd_id", "candidate_id", "rank", "score", "relaxed")


def all_queries() -> dict[str, Query]:
    return {
        "gate_drop_counts": gate_drop_counts,
        "pool_drop_counts": pool_drop_counts,
        "honeypot_reasons": honeypot_reasons,
        "honeypot_sample": honeypot_sample,
        "relaxed_pool": relaxed_pool,
        "experience_title_fit": experience_title_fit,
        "behavioral_multiplier": behavioral_multiplier,
        "skill_score": skill_score,
        "jd_experience": jd_experience,
        "jd_locations": jd_locations,
        "jd_skill_weights": jd_skill_weights,
        "jd_combined_weights": jd_combined_weights,
        "tfidf_similarity": tfidf_pairs,
        "dense_similarity_topk": dense_similarity_topk,
        "encoded_similarity": encoded_similarity,
        "composite_topn": composite_topn,
        "score_range": score_range,
        "final_ranking": final_ranking,
        "dense_ranking": dense_ranking,
        "strongest_skills": strongest_skills,
        "first_relevant_job": first_relevant_job,
        "reasoning_text": reasoning_text,
        "tie_rerank": tie_rerank,
        "output_violations": output_violations,
        "json_roundtrip": json_roundtrip,
        "json_arrays": json_arrays,
        "malformed_lines": malformed_lines,
        "text_files": text_files,
        "nation_status": nation_status,
        "csv_roundtrip": csv_roundtrip,
        "file_violations": file_violations,
        "stream_stage1": stream_stage1,
        "stream_ranking": stream_ranking,
        "stream_tfidf_ranking": stream_tfidf_ranking,
        "nation_pool": nation_pool,
    }
