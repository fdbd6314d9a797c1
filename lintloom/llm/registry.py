"""The queries of the thirteen operators, and the SQL of those that SQL can express."""

from lintloom.llm import bpe_ops, chat, language, license_scan, merkle, near_dup, ogg, packing, quality, repeats, topk, toxicity, va_codes

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity, bpe_ops.op2_bpe_round_trip, ogg.op3_ogg_media, quality.op4_quality, chat.op5_chat_format,
        near_dup.op6_near_duplicates, topk.op7_top_k, packing.op8_pack_windows, language.op9_language, license_scan.op10_license_scan,
        va_codes.op11_va_codes, repeats.op12_repeated_passages, merkle.op13_merkle_manifest,
    )
}
ORACLE = {
    "op5_chat_format": chat.ORACLE, "op6_near_duplicates": near_dup.ORACLE, "op7_top_k": topk.ORACLE, "op11_va_codes": va_codes.ORACLE,
    "op12_repeated_passages": repeats.ORACLE, "op13_merkle_manifest": merkle.ORACLE,
}
