"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterank.llm import (
    blocks,
    decontaminate,
    forest,
    interactions,
    jaccard,
    langid,
    packing,
    rotation,
    runs,
    secrets,
    suffixes,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_secrets": secrets.op4_secrets,
    "op5_forest": forest.op5_forest,
    "op6_langid": langid.op6_langid,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_blocks": blocks.op8_blocks,
    "op9_packing": packing.op9_packing,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_rotation": rotation.op11_rotation,
    "op12_interactions": interactions.op12_interactions,
    "op13_runs": runs.op13_runs,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op4_secrets": secrets.SQL,
    "op7_suffixes": suffixes.SQL,
    "op8_blocks": blocks.SQL,
    "op10_jaccard": jaccard.SQL,
    "op11_rotation": rotation.SQL,
    "op12_interactions": interactions.SQL,
    "op13_runs": runs.SQL,
}
