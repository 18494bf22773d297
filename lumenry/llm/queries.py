"""Registered queries of this subpackage and the SQL that some are held against."""

from __future__ import annotations

from . import (
    cap_filters,
    jaccard_join,
    language_id,
    license_scan,
    lm_score,
    mixing,
    packing,
    periodic_runs,
    prefix_trie,
    projection_search,
    quality_outliers,
    url_filter,
    warc,
)

QUERIES = {
    "op1_bestfit_packing": packing.op1,
    "op2_url_filter": url_filter.op2,
    "op3_license_scan": license_scan.op3,
    "op4_ngram_jaccard_join": jaccard_join.op4,
    "op5_warc_archive": warc.op5,
    "op6_language_id": language_id.op6,
    "op7_source_mixing": mixing.op7,
    "op8_nearest_neighbours": projection_search.op8,
    "op9_embedding_near_copies": cap_filters.op9,
    "op10_lm_score": lm_score.op10,
    "op11_prefix_trie": prefix_trie.op11,
    "op12_quality_outliers": quality_outliers.op12,
    "op13_periodic_runs": periodic_runs.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_archive": warc.OP5_SQL,
}
