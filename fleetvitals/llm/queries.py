"""The registered queries: each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetvitals.llm.bloom import language_model_query
from fleetvitals.llm.boosting import quality_query
from fleetvitals.llm.bpe import bpe_query
from fleetvitals.llm.counts import token_counts_query
from fleetvitals.llm.divergence import DIVERGENCE_SQL, divergence_query
from fleetvitals.llm.exact import EXACT_SQL, exact_dedup_query
from fleetvitals.llm.forest import nearest_query
from fleetvitals.llm.manifest import MANIFEST_SQL, manifest_query
from fleetvitals.llm.minhash import near_dedup_query
from fleetvitals.llm.mixing import MIXING_SQL, mixing_query
from fleetvitals.llm.sharding import sharding_query
from fleetvitals.llm.suffixes import suffix_query
from fleetvitals.llm.toxicity import toxicity_query
from fleetvitals.plans import tune


def _over(build: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return build(*(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables))

    return run


QUERIES = {
    "op1_quality": _over(quality_query, "documents", "labels"),
    "op2_sharding": _over(sharding_query, "documents"),
    "op3_nearest": _over(nearest_query, "embeddings"),
    "op4_mixing": _over(mixing_query, "documents"),
    "op5_token_counts": _over(token_counts_query, "documents"),
    "op6_near_dedup": _over(near_dedup_query, "documents"),
    "op7_toxicity": _over(toxicity_query, "documents", "labels"),
    "op8_repeated_spans": _over(suffix_query, "documents"),
    "op9_bpe": _over(bpe_query, "documents"),
    "op10_exact_dedup": _over(exact_dedup_query, "documents"),
    "op11_divergence": _over(divergence_query, "documents"),
    "op12_manifest": _over(manifest_query, "documents"),
    "op13_language_model": _over(language_model_query, "documents"),
}

ORACLE = {"op4_mixing": MIXING_SQL, "op10_exact_dedup": EXACT_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_manifest": MANIFEST_SQL}
