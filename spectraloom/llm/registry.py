"""The queries of this subpackage and their SQL, where SQL can express them."""

from spectraloom.llm import (
    collocations,
    compression_classifier,
    jaccard_join,
    license_scan,
    media_columns,
    merkle,
    mixing,
    packing,
    quality_rules,
    sharding,
    simhash,
    token_counts,
    url_filters,
)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_media_columns": media_columns.op2_media_columns,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_sharding": sharding.op4_sharding,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_quality_classifier": compression_classifier.op6_quality_classifier,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_packing": packing.op8_packing,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_mixing": mixing.op10_mixing,
    "op11_simhash": simhash.op11_simhash,
    "op12_collocations": collocations.op12_collocations,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE_SQL = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op9_url_filters": url_filters.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
