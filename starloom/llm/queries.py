"""The registered queries of the document operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from starloom.llm.dart_minhash import op5_dart_minhash
from starloom.llm.decontaminate import op4_benchmark_containment
from starloom.llm.importance import op2_ngram_importance
from starloom.llm.language import op3_nearest_centroid
from starloom.llm.licenses import op6_license_windows
from starloom.llm.line_edits import op1_line_edits
from starloom.llm.packing import op10_length_buckets
from starloom.llm.lm_score import op8_attention_lm
from starloom.llm.phrases import ORACLE_SQL as PHRASES_SQL
from starloom.llm.phrases import op13_partitioned_phrases
from starloom.llm.pseudonyms import op9_feistel_pseudonyms
from starloom.llm.shipping import ship
from starloom.llm.suffixes import ORACLE_SQL as SUFFIXES_SQL
from starloom.llm.suffixes import op12_deep_shallow
from starloom.llm.token_files import op7_token_files
from starloom.llm.vector_codes import ORACLE_SQL as VECTOR_CODES_SQL
from starloom.llm.vector_codes import op11_cover_tree_codes


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_edits": op1_line_edits,
    "op2_ngram_importance": op2_ngram_importance,
    "op3_nearest_centroid": op3_nearest_centroid,
    "op4_benchmark_containment": op4_benchmark_containment,
    "op5_dart_minhash": op5_dart_minhash,
    "op6_license_windows": op6_license_windows,
    "op7_token_files": op7_token_files,
    "op8_attention_lm": op8_attention_lm,
    "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
    "op10_length_buckets": op10_length_buckets,
    "op11_cover_tree_codes": op11_cover_tree_codes,
    "op12_deep_shallow": op12_deep_shallow,
    "op13_partitioned_phrases": op13_partitioned_phrases,
    "pipeline": corpus_pipeline.run,
}
QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}

# The other operators can't be written in SQL: they need fingerprints, the tokenizer or a trained model.
ORACLES: dict[str, str] = {
    "op11_cover_tree_codes": VECTOR_CODES_SQL, "op12_deep_shallow": SUFFIXES_SQL, "op13_partitioned_phrases": PHRASES_SQL,
}
