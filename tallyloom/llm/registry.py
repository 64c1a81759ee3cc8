"""The queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.alignment import op12_alignment
from tallyloom.llm.decontaminate import op8_decontamination
from tallyloom.llm.divergence import OP13_SQL, op13_divergence
from tallyloom.llm.html_extract import op5_html_extraction
from tallyloom.llm.languages import op11_language_id
from tallyloom.llm.packing import op6_packing
from tallyloom.llm.quality import op2_quality_rules
from tallyloom.llm.secrets_scan import op9_secret_scans
from tallyloom.llm.sharding import op1_sharding
from tallyloom.llm.simhash import op10_simhash
from tallyloom.llm.token_counts import op7_token_counts
from tallyloom.llm.token_store import op4_token_store
from tallyloom.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_quality_rules, op3_toxicity, op4_token_store, op5_html_extraction, op6_packing, op7_token_counts, op8_decontamination, op9_secret_scans, op10_simhash, op11_language_id, op12_alignment, op13_divergence)
}

#: No checksum, tokenizer, trained model or fingerprint can be written in SQL: the others are tested by brute force.
ORACLE_SQL: dict[str, str] = {"op13_divergence": OP13_SQL}
