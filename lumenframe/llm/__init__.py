"""Operations of a training-data pipeline, as Spark jobs."""

from __future__ import annotations


def queries():
    from .brown import op6_brown_lm
    from .chat import op5_chat_format
    from .decontaminate import op8_decontaminate
    from .exact_bytes import op4_suffix_dedup
    from .jaccard import op12_ngram_jaccard
    from .langid import op9_language_id
    from .lines import op10_line_dedup
    from .mixing import op2_mixing
    from .negatives import op13_hard_negatives
    from .passages import op3_substring_dedup
    from .quality import op1_quality_rules
    from .resampling import op11_importance_resampling
    from .simhash import op7_simhash

    return {
        "op7_simhash": op7_simhash,
        "op1_quality_rules": op1_quality_rules,
        "op2_mixing": op2_mixing,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_chat_format": op5_chat_format,
        "op6_brown_lm": op6_brown_lm,
        "op8_decontaminate": op8_decontaminate,
        "op9_language_id": op9_language_id,
        "op10_line_dedup": op10_line_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_ngram_jaccard": op12_ngram_jaccard,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql():
    from .chat import OP5_SQL
    from .decontaminate import OP8_SQL
    from .exact_bytes import OP4_SQL
    from .jaccard import OP12_SQL
    from .lines import OP10_SQL
    from .mixing import OP2_SQL
    from .negatives import OP13_SQL
    from .passages import OP3_SQL
    from .quality import OP1_SQL
    from .resampling import OP11_SQL

    return {
        "op1_quality_rules": OP1_SQL,
        "op2_mixing": OP2_SQL,
        "op3_substring_dedup": OP3_SQL,
        "op4_suffix_dedup": OP4_SQL,
        "op5_chat_format": OP5_SQL,
        "op8_decontaminate": OP8_SQL,
        "op10_line_dedup": OP10_SQL,
        "op11_importance_resampling": OP11_SQL,
        "op12_ngram_jaccard": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
