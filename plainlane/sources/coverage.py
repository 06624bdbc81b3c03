"""The rule coverage table: 53 rules, how far each is checked, and by which codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule, semantic key, status and codes.
RULES = """
1.1 permitted_word_classes partial STE-LEX-001,STE-LEX-002,STE-TERM-001
1.2 approved_part_of_speech partial STE-GRAM-001
1.3 approved_meaning partial STE-CTX-001
1.4 approved_verb_adjective_forms partial STE-FORM-001
1.5 technical_noun_categories context_required -
1.6 unapproved_word_as_technical_noun partial STE-TERM-001
1.7 technical_noun_not_verb partial STE-TERM-003
1.8 governed_technical_noun_approval partial STE-TERM-002
1.9 short_clear_technical_noun context_required -
1.10 no_regional_slang_jargon_technical_nouns partial STE-CTX-002
1.11 consistent_technical_noun_for_item context_required -
1.12 technical_verb_categories context_required -
1.13 technical_verb_not_noun partial STE-TERM-004
1.14 american_english_spelling partial STE-CTX-003
2.1 multiword_noun_max_three_words partial STE-NOUN-001
2.2 long_technical_noun_clarification implemented STE-NOUN-002
3.1 dictionary_verb_forms_only partial STE-FORM-001
3.2 allowed_verb_forms_and_tenses partial STE-VERB-001,STE-VERB-002,STE-VERB-005,STE-VERB-006
3.3 past_participle_as_adjective partial STE-VERB-001,STE-VERB-003,STE-VERB-004,STE-GRAM-003
3.4 no_complex_auxiliary_constructions partial STE-VERB-001,STE-VERB-002,STE-VERB-003,STE-VERB-004,STE-VERB-005,STE-VERB-006
3.5 ing_only_technical_noun_or_modifier partial STE-GRAM-002,STE-VERB-005,STE-VERB-006,STE-VERB-007
3.6 active_voice_with_unknown_agent_exception partial STE-GRAM-003
3.7 approved_verb_for_action partial STE-GRAM-001
4.1 short_clear_sentences partial STE-LEN-001,STE-LEN-002
4.2 no_omission_or_contractions partial STE-SYN-001
4.3 vertical_list_for_complex_text partial STE-LIST-001,STE-LIST-002,STE-LIST-003,STE-LIST-004
4.4 connect_related_sentences context_required -
4.5 articles_or_demonstratives_before_nouns context_required -
5.1 procedural_sentence_max_20_words implemented STE-LEN-001
5.2 one_instruction_unless_simultaneous partial STE-PROC-003
5.3 imperative_procedural_instructions partial STE-PROC-001,STE-PROC-004
5.4 condition_first_then_comma partial STE-PROC-002
5.5 notes_information_not_instructions partial STE-NOTE-001,STE-NOTE-002
6.1 gradual_information partial STE-DISC-001
6.2 key_words_phrases_logical_structure context_required -
6.3 descriptive_sentence_max_25_words implemented STE-LEN-002
6.4 paragraphs_for_related_information context_required -
6.5 one_topic_per_paragraph partial STE-PARA-002
6.6 paragraph_max_six_sentences implemented STE-PARA-001
7.1 risk_level_word_or_symbol partial STE-SAFE-003
7.2 safety_command_or_condition_first partial STE-SAFE-001,STE-SAFE-002
7.3 explain_risk_or_result context_required -
8.1 no_semicolon implemented STE-PUNC-001
8.2 hyphen_directly_related_words partial STE-PUNC-002
8.3 allowed_parenthesis_uses partial STE-PUNC-003
8.4 vertical_list_colon_ends_count_unit implemented STE-LEN-001,STE-LEN-002
8.5 parenthetical_text_counts_one_word implemented STE-LEN-001,STE-LEN-002
8.6 specified_elements_count_one_word implemented STE-LEN-001,STE-LEN-002
8.7 hyphenated_words_count_one_word implemented STE-LEN-001,STE-LEN-002
9.1 different_sentence_construction_when_replacement_insufficient context_required -
9.2 use_approved_words_correctly partial STE-CTX-001
9.3 no_phrasal_verbs partial STE-PHRASE-001
9.4 consistent_terminology_and_wording context_required -
"""
STATUSES = ["implemented", "partial", "context_required", "not_implemented"]


def rules(spark: SparkSession) -> DataFrame:
    """(rule, semantic_key, status, codes)."""
    rows = [(r, k, s, [] if c == "-" else c.split(",")) for r, k, s, c in (line.split() for line in RULES.strip().splitlines())]
    return spark.createDataFrame(rows, "rule string, semantic_key string, status string, codes array<string>")


def status_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("status").agg(F.count(F.lit(1)).alias("n_rules"))


def problems(table: DataFrame) -> DataFrame:
    """(rule, problem): repeated rules or keys, unknown statuses, statuses that do not fit their codes."""
    twice = lambda c, p: table.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("rule").alias("first")).where("n > 1").select(F.col("first").alias("rule"), F.lit(p).alias("problem"))
    bad = [
        table.where(~F.col("status").isin(*STATUSES)).select("rule", F.lit("unknown status").alias("problem")),
        table.where(F.col("status").isin("implemented", "partial") & (F.size("codes") == 0)).select("rule", F.lit("no codes").alias("problem")),
        table.where(F.col("status").isin("context_required", "not_implemented") & (F.size("codes") > 0)).select("rule", F.lit("codes without a check").alias("problem")),
        table.where(~F.coalesce(F.col("rule").rlike("^[1-9]\\.[0-9]{1,2}$"), F.lit(False))).select("rule", F.lit("bad rule number").alias("problem")),
    ]
    out = twice("rule", "repeated rule").unionByName(twice("semantic_key", "repeated key"))
    for b in bad:
        out = out.unionByName(b)
    return out
