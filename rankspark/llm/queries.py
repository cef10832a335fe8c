"""The operators as named queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import divergence, host_rules, interval_search, tool_calls
from .common import table
from .decontamination import decontamination_hits
from .html_extraction import extract
from .lm_scoring import lm_scores
from .mixing import mix
from .pii import pii
from .quality import quality
from .simhash_dedup import simhash_components
from .toxicity import toxicity
from .url_filter import url_filter


def op1_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tool_calls(spark, sf_dir):
    parts = tool_calls.conversation_calls(table(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(*parts).withColumn("errors", F.array_join("errors", ","))


def op4_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op5_simhash_dedup(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"), shingle_words=3, radius=2)


def op6_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_host_rules(spark, sf_dir):
    rows = host_rules.host_rules(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_pii(spark, sf_dir):
    return pii(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    _, documents = mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark, sf_dir):
    return decontamination_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op12_ranked_search(spark, sf_dir):
    return interval_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_quality, op3_tool_calls, op4_html_extraction, op5_simhash_dedup, op6_toxicity, op7_host_rules,
        op8_pii, op9_mixing, op10_decontamination, op11_url_filter, op12_ranked_search, op13_divergence,
    )
}
LLM_ORACLE = {
    "op3_tool_calls": tool_calls.SQL,
    "op7_host_rules": host_rules.SQL,
    "op12_ranked_search": interval_search.SQL,
    "op13_divergence": divergence.SQL,
}
