"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barlight.llm import fingerprints, jaccard, langid, manifest, media, metric, mixing, packing, quality, runs, substrings, toxicity, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_wavelet_shards": wavelet.op2_wavelet_shards,
    "op3_language": langid.op3_language,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_substrings": substrings.op6_substrings,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_media": media.op10_media,
    "op11_runs": runs.op11_runs,
    "op12_range_join": metric.op12_range_join,
    "op13_manifest": manifest.op13_manifest,
}

ORACLES: dict[str, str] = {
    "op8_mixing": mixing.oracle_sql(),
    "op11_runs": runs.oracle_sql(),
    "op12_range_join": metric.oracle_sql(),
    "op13_manifest": manifest.oracle_sql(),
}
