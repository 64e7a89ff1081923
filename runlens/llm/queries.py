"""All named queries of the text operators."""

from runlens.llm import (  # noqa: F401
    alignment,
    decontamination,
    exact_dedup,
    hard_negatives,
    html_text,
    jaccard_join,
    lm,
    mixing,
    quality,
    sharding,
    suffix_dedup,
    toxicity,
    warc,
)
from runlens.llm.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
