"""The registered corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from lotwise.llm import (
    exact_dedup,
    html_text,
    license_scan,
    minhash_dedup,
    mixing,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    url_filter,
    warc_zip,
    whitening,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_warc": warc_zip.op2_warc,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_mixing": mixing.op4_mixing,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
    "op7_html_text": html_text.op7_html_text,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_packing": packing.op10_packing,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op2_warc": warc_zip.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
}
