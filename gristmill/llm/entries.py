"""Registered queries of this subpackage and the SQL that checks some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.ann import op3_nearest_neighbours
from gristmill.llm.bpe import op7_bpe_encode_decode
from gristmill.llm.iblt import op10_document_fingerprints
from gristmill.llm import lexical, phrases, rlz
from gristmill.llm.langid import op1_language_id
from gristmill.llm.licenses import op2_license_scan, oracle
from gristmill.llm.lexical import op12_lexical_search
from gristmill.llm.packing import op6_lexical_packing
from gristmill.llm.phrases import op13_phrase_collocations
from gristmill.llm.quality import op9_quality_classifier
from gristmill.llm.rlz import op11_substring_dedup
from gristmill.llm.secrets import op8_secret_scan
from gristmill.llm.sharding import op5_consistent_hash_sharding
from gristmill.llm.simhash import op4_simhash_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_consistent_hash_sharding": op5_consistent_hash_sharding,
    "op6_lexical_packing": op6_lexical_packing,
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL: dict[str, str] = {"op2_license_scan": oracle(), "op11_substring_dedup": rlz.oracle(), "op12_lexical_search": lexical.oracle(), "op13_phrase_collocations": phrases.oracle()}
