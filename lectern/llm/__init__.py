"""Corpus operators for training-data pipelines: their queries and oracle SQL.

The rest of the library never imports this subpackage.
"""

from __future__ import annotations

from . import collocations, embedding_dedup, html_extract, mixing, packing, phrase_dedup, quality, simhash, sketches, suffix_dedup, tries, url_filters, warc


def queries():
    """Query name -> function of (spark, sf_dir)."""
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
        "op3_html_extraction": html_extract.op3_html_extraction,
        "op4_warc": warc.op4_warc,
        "op5_mixing": mixing.op5_mixing,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_phrase_dedup": phrase_dedup.op7_phrase_dedup,
        "op8_url_filters": url_filters.op8_url_filters,
        "op9_simhash": simhash.op9_simhash,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_document_fingerprints": sketches.op11_document_fingerprints,
        "op12_source_divergence": tries.op12_source_divergence,
        "op13_phrase_collocations": collocations.op13_phrase_collocations,
        "quality_common_lines": quality.quality_common_lines,
    }


def oracle_sql():
    """Query name -> DuckDB SQL, where SQL can express the query."""
    return {
        "op2_embedding_dedup": embedding_dedup.OP2_SQL,
        "op4_warc": warc.OP4_SQL,
        "op6_suffix_dedup": suffix_dedup.OP6_SQL,
        "op7_phrase_dedup": phrase_dedup.OP7_SQL,
        "op8_url_filters": url_filters.OP8_SQL,
        "op10_quality_rules": quality.OP10_SQL,
        "op11_document_fingerprints": sketches.OP11_SQL,
        "op12_source_divergence": tries.OP12_SQL,
        "op13_phrase_collocations": collocations.OP13_SQL,
        "quality_common_lines": quality.COMMON_LINES_SQL,
    }
