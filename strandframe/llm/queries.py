"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.llm import bpe_automaton, langid, lm_score, media, packing, quality_ledger, simhash, suffix_dedup, token_planes, tokens, url_templates
from strandframe.llm.common import scratch_path, table


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)


def op2_token_planes(spark, sf_dir):
    return token_planes.write_and_read(table(spark, sf_dir, "documents"), tokens.default_path("word_bpe_49k.json"), scratch_path(spark, "planes"))


def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_ledger(spark, sf_dir):
    found = quality_ledger.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_ablations(spark, sf_dir):
    """What each rule of the policy adds to the others, from the ledger."""
    return quality_ledger.ablations(quality_ledger.ledger(table(spark, sf_dir, "documents")))


def op5_language_codes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs.where(~langid.held_out())))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_media_columns(spark, sf_dir):
    return media.media_digests(media.media_table(table(spark, sf_dir, "documents")))


def op7_url_templates(spark, sf_dir):
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))


def op9_bpe_automaton(spark, sf_dir):
    return bpe_automaton.round_trip_digests(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))


def op10_lm_difference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs, lm_score.good_documents(table(spark, sf_dir, "labels"))))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_planes": op2_token_planes,
    "op3_simhash": op3_simhash,
    "op4_quality_ledger": op4_quality_ledger,
    "op5_language_codes": op5_language_codes,
    "op6_media_columns": op6_media_columns,
    "op7_url_templates": op7_url_templates,
    "op8_packing": op8_packing,
    "op9_bpe_automaton": op9_bpe_automaton,
    "op10_lm_difference": op10_lm_difference,
    "quality_ablations": quality_ablations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_ledger": quality_ledger.verdict_sql(),
    "quality_ablations": quality_ledger.ablation_sql(),
    "op7_url_templates": url_templates.sql(),
}
