"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from rangeloom.llm import audit, bpe, codes, exact, language, licenses, mixing, neardup, packing, quality, secrets, substrings, warc


def queries() -> dict:
    return {
        "op1_word_crf": language.op1_word_crf,
        "op2_odd_sketches": neardup.op2_odd_sketches,
        "op3_digest_index": exact.op3_digest_index,
        "op4_containment_join": licenses.op4_containment_join,
        "op5_salvage_reader": warc.op5_salvage_reader,
        "op6_bpe_transducer": bpe.op6_bpe_transducer,
        "op7_randomness_battery": secrets.op7_randomness_battery,
        "op8_block_mix": mixing.op8_block_mix,
        "op9_de_bruijn": substrings.op9_de_bruijn,
        "op10_compression_bands": quality.op10_compression_bands,
        "op11_refined_audit": audit.op11_refined_audit,
        "op12_bm25_packing": packing.op12_bm25_packing,
        "op13_screened_codes": codes.op13_screened_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_digest_index": exact.OP3_SQL, "op5_salvage_reader": warc.OP5_SQL, "op8_block_mix": mixing.OP8_SQL, "op11_refined_audit": audit.OP11_SQL, "op13_screened_codes": codes.OP13_SQL}
