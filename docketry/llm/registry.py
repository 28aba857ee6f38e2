"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from docketry.llm import byte_bpe, centroid_clustering, chat_templates, decontamination, embedding_whitening, line_dedup, packing, quality_crf, quality_rules, simhash_dedup, toxicity, url_filters, warc

QUERIES = {
    f.__name__: f
    for f in (
        simhash_dedup.op1_simhash_dedup,
        quality_rules.op2_quality_rules,
        line_dedup.op3_line_dedup,
        packing.op4_packing,
        url_filters.op5_url_filters,
        warc.op6_warc,
        toxicity.op7_toxicity,
        quality_crf.op8_quality_classifier,
        chat_templates.op9_chat_formatting,
        decontamination.op10_benchmark_decontamination,
        centroid_clustering.op11_centroid_clustering,
        embedding_whitening.op12_embedding_whitening,
        byte_bpe.op13_byte_bpe,
    )
}

SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op5_url_filters": url_filters.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op9_chat_formatting": chat_templates.OP9_SQL,
    "op10_benchmark_decontamination": decontamination.OP10_SQL,
    "op11_centroid_clustering": centroid_clustering.OP11_SQL,
}
