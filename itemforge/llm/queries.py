"""The operators' queries and their SQL twins."""

from itemforge.llm import align, bpe, counts, hnsw, jaccard, langid, lines, merkle, mixing, quality, token_files, topk, warc

QUERIES = {
    "op1_tokens": token_files.op1_tokens,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_hnsw": hnsw.op4_hnsw,
    "op5_warc": warc.op5_warc,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_topk": topk.op7_topk,
    "op8_lines": lines.op8_lines,
    "op9_langid": langid.op9_langid,
    "op10_bpe": bpe.op10_bpe,
    "op11_align": align.op11_align,
    "op12_merkle": merkle.op12_merkle,
    "op13_counts": counts.op13_counts,
}
SQL = {
    "op3_mixing": mixing.SQL,
    "op5_warc": warc.SQL,
    "op7_topk": topk.SQL,
    "op12_merkle": merkle.SQL,
}
