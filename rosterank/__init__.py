"""Candidate ranking on Spark: gates, scores, text similarity, top-k and explanations as DataFrame plans."""

import sys

from pyspark import cloudpickle

from rosterank.plans.jobs import extract_jd_features
from rosterank.plans.pool import ShortPoolError, build_pool, drop_counts, honeypot_sample, pool_status
from rosterank.plans.quality import check_files, violations
from rosterank.plans.ranking import (
    explain_ranked,
    rank_candidates,
    score_pool,
    select_top,
)
from rosterank.sources.candidates import load_candidates, split_malformed
from rosterank.sources.job_texts import load_job_texts
from rosterank.sources.ranking_csv import read_ranking_rows, write_ranking_csv

__all__ = [
    "ShortPoolError",
    "build_pool",
    "check_files",
    "drop_counts",
    "explain_ranked",
    "extract_jd_features",
    "honeypot_sample",
    "load_candidates",
    "load_job_texts",
    "pool_status",
    "rank_candidates",
    "read_ranking_rows",
    "score_pool",
    "select_top",
    "split_malformed",
    "violations",
    "write_ranking_csv",
]

# Functions of the library travel to the workers by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
