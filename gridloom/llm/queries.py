"""Queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, htmlextract, jaccard, langid, packing, pii, quality, suffix, topk, urlfilter
from gridloom.llm._spark import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_pii_crf": lambda s, d: pii.op1(docs(s, d)),
        "op2_topk_fagin": lambda s, d: topk.op2(table(s, d, "embeddings")),
        "op3_url_templates": lambda s, d: urlfilter.op3(table(s, d, "pages")),
        "op4_best_fit_packing": lambda s, d: packing.op4(docs(s, d)),
        "op5_language_id": lambda s, d: langid.op5(docs(s, d)),
        "op6_ngram_jaccard": lambda s, d: jaccard.op6(docs(s, d)),
        "op7_quality_weak_labels": lambda s, d: quality.op7(docs(s, d)),
        "op8_suffix_dedup": lambda s, d: suffix.op8(docs(s, d)),
        "op9_decontamination": lambda s, d: decontaminate.op9(docs(s, d), table(s, d, "benchmark")),
        "op10_html_main_text": lambda s, d: htmlextract.op10(table(s, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    from gridloom.llm.oracles import SQL

    return SQL
