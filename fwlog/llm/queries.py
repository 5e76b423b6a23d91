"""Queries of this package by name, and the SQL of those that SQL can express."""

from fwlog.llm import filter_audit, importance_resampling, source_mixing, topk_search, url_reputation, warc_revisit
from fwlog.llm.collision_search import op13_nearest_neighbours
from fwlog.llm.embedding_dedup import op10_embedding_dedup
from fwlog.llm.filter_audit import op11_filter_audit
from fwlog.llm.importance_resampling import op12_importance_resampling
from fwlog.llm.language_id import op4_language_id
from fwlog.llm.license_scan import op5_license_scan
from fwlog.llm.sentencepiece_bpe import op8_sentencepiece
from fwlog.llm.simhash_dedup import op6_simhash_dedup
from fwlog.llm.topk_search import op7_exact_topk
from fwlog.llm.source_mixing import op9_source_mixing
from fwlog.llm.toxicity import op1_toxicity
from fwlog.llm.url_reputation import op2_url_reputation
from fwlog.llm.warc_revisit import op3_warc_revisit

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_url_reputation, op3_warc_revisit, op4_language_id, op5_license_scan, op6_simhash_dedup, op7_exact_topk,
        op8_sentencepiece, op9_source_mixing, op10_embedding_dedup, op11_filter_audit,
        op12_importance_resampling, op13_nearest_neighbours,
    )
}

ORACLES = {
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_importance_resampling": importance_resampling.ORACLE,
    "op2_url_reputation": url_reputation.ORACLE,
    "op3_warc_revisit": warc_revisit.ORACLE,
    "op7_exact_topk": topk_search.ORACLE,
    "op9_source_mixing": source_mixing.ORACLE,
}
