"""Queries of this subpackage, by name, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from .centroids import ORACLE_SQL as CENTROID_SQL
from .centroids import op11_centroid_clusters
from .chat_format import op7_chat_formatting
from .decontaminate import op1_decontamination
from .exact_dedup import ORACLE_SQL as DEDUP_SQL
from .exact_dedup import op12_exact_dedup
from .html_extract import op3_html_extraction
from .jaccard_join import ORACLE_SQL as JACCARD_SQL
from .jaccard_join import op5_ngram_jaccard_join
from .lang_id import op2_language_id
from .license_scan import op10_license_scans
from .media import op6_media_columns
from .mixing import op4_mix_sources
from .quality import op8_quality_classifier
from .token_alignment import op13_token_alignment
from .toxicity import op9_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_html_extraction": op3_html_extraction,
    "op4_mix_sources": op4_mix_sources,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_media_columns": op6_media_columns,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_license_scans": op10_license_scans,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {"op5_ngram_jaccard_join": JACCARD_SQL, "op11_centroid_clusters": CENTROID_SQL, "op12_exact_dedup": DEDUP_SQL}
