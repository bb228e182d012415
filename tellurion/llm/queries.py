"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from tellurion.llm import byte_bpe, collocations, conversation_repair, exact_dedup, hnsw, license_scan, line_dedup, minhash_dedup, packing, quality, secret_scan, sentencepiece_codec, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op3_hnsw": hnsw.op3_hnsw,
    "op10_quality": quality.op10_quality,
    "op7_vector_best_fit": packing.op7_vector_best_fit,
    "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
    "op5_warc": warc.op5_warc,
    "op9_license_scan": license_scan.op9_license_scan,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_collocations": collocations.op12_collocations,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op6_minhash_dedup": minhash_dedup.SQL,
    "op5_warc": warc.SQL,
    "op9_license_scan": license_scan.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_collocations": collocations.SQL,
}
