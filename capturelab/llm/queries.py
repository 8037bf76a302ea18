"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from . import bpe, chat_format, conversation_repair, decontaminate, html_text, language_model, near_dup, periodic_runs, pii, quality_model, quality_rules, secrets, warc

QUERIES = {
    f.__name__: f
    for f in (
        secrets.op1_secret_scan,
        decontaminate.op2_benchmark_decontamination,
        quality_rules.op3_quality_rules,
        pii.op4_pii_lstm_crf,
        warc.op5_warc_round_trip,
        bpe.op6_byte_bpe,
        html_text.op7_html_text,
        language_model.op8_deleted_interpolation,
        quality_model.op9_quality_classifier,
        near_dup.op10_minhash_near_dup,
        chat_format.op11_chat_format,
        conversation_repair.op12_conversation_repair,
        periodic_runs.op13_periodic_runs,
    )
}

ORACLES = {
    "op2_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op5_warc_round_trip": warc.ORACLE_SQL,
    "op10_minhash_near_dup": near_dup.ORACLE_SQL,
    "op11_chat_format": chat_format.ORACLE_SQL,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
}
