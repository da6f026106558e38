"""Registered queries of the corpus operators, over the whole tables of a data folder."""

from __future__ import annotations

from wardmap.llm.conversation_repair import damage_report
from wardmap.llm.decontaminate import contamination_report
from wardmap.llm.exact_copies import copy_report
from wardmap.llm.extraction import extracted
from wardmap.llm.licences import licence_scan
from wardmap.llm.mixing import mixture_report
from wardmap.llm.near_copies import near_copy_report
from wardmap.llm.packing import packed
from wardmap.llm.quality import quality_report
from wardmap.llm.quotations import conversations
from wardmap.llm.surrogates import pseudonymised, session_key
from wardmap.llm.tables import table
from wardmap.llm.vector_codes import code_report
from wardmap.llm.warc import archive_report

QUERIES = {
    "op1_decontaminate": lambda spark, d: contamination_report(
        table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_licences": lambda spark, d: licence_scan(table(spark, d, "documents")),
    "op3_pack_tokens": lambda spark, d: packed(table(spark, d, "documents")),
    "op4_quality_rules": lambda spark, d: quality_report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_surrogates": lambda spark, d: pseudonymised(table(spark, d, "documents"), session_key(spark)),
    "op6_jaccard_join": lambda spark, d: near_copy_report(table(spark, d, "documents")),
    "op7_mix_sources": lambda spark, d: mixture_report(table(spark, d, "documents")),
    "op10_html_text": lambda spark, d: extracted(table(spark, d, "pages")),
    "op8_warc": lambda spark, d: archive_report(table(spark, d, "pages")),
    "op9_quotations": lambda spark, d: conversations(table(spark, d, "conversations")),
    "op11_vector_codes": lambda spark, d: code_report(table(spark, d, "embeddings")),
    "op12_exact_copies": lambda spark, d: copy_report(table(spark, d, "documents")),
    "op13_conversation_repair": lambda spark, d: damage_report(table(spark, d, "conversations")),
}
