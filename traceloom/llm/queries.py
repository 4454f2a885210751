"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import op6_embedding_near_dedup
from .flac import op3_flac_media
from .html_text import op4_html_extraction
from .mixing import OP2_SQL, op2_source_mixing
from .packing import op9_best_fit_packing
from .quality import op5_quality_classifier
from .repeats import op7_suffix_array_dedup
from .secrets import op8_secret_scans
from .simhash import op1_simhash_near_dedup
from .token_files import op10_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_source_mixing": op2_source_mixing,
        "op3_flac_media": op3_flac_media,
        "op4_html_extraction": op4_html_extraction,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_secret_scans": op8_secret_scans,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2_SQL}
