"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quillwork.llm import bpe, collocations, decontaminate, exactsubstr, langid, pii, quality, repair, sharding, simhash, tokenfile, topk, toxicity


def queries() -> dict:
    return {
        "op1_bitsliced_simhash": simhash.op1_bitsliced_simhash,
        "op10_suffix_arrays": exactsubstr.op10_suffix_arrays,
        "op11_quotient_collocations": collocations.op11_quotient_collocations,
        "op12_crf_quality": quality.op12_crf_quality,
        "op13_conversation_repair": repair.op13_conversation_repair,
        "op2_deobfuscated_pii": pii.op2_deobfuscated_pii,
        "op3_compression_toxicity": toxicity.op3_compression_toxicity,
        "op4_nra_topk": topk.op4_nra_topk,
        "op5_bit_packed_tokens": tokenfile.op5_bit_packed_tokens,
        "op6_hash_tree_shards": sharding.op6_hash_tree_shards,
        "op7_ppm_language": langid.op7_ppm_language,
        "op8_sentencepiece_bpe": bpe.op8_sentencepiece_bpe,
        "op9_spaced_seeds": decontaminate.op9_spaced_seeds,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op11_quotient_collocations": collocations.OP11_SQL, "op4_nra_topk": topk.OP4_SQL, "op6_hash_tree_shards": sharding.OP6_SQL, "op9_spaced_seeds": decontaminate.OP9_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
