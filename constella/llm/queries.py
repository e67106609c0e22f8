"""The queries of this subpackage and the SQL that DuckDB runs for those that SQL can express."""

from constella.llm import decontaminate, html_text, language, licenses, ngram_join, packing, pii, quality, secrets, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_warc": warc.query,
    "op3_html_extraction": html_text.query,
    "op4_license_scans": licenses.query,
    "op5_language_id": language.query,
    "op6_quality_rules": quality.query,
    "op7_packing": packing.query,
    "op8_secret_scans": secrets.query,
    "op9_pii": pii.query,
    "op10_benchmark_decontamination": decontaminate.query,
}

ORACLE_SQL = {
    "op8_secret_scans": secrets.ORACLE_SQL,
    "op1_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op10_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "op2_warc": warc.ORACLE_SQL,
}
