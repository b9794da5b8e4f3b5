"""The corpus queries by name, and the SQL of those that SQL can express."""

from tidelog.llm import bpe, decontam, langid, linededup, minhash, secretscan, shard, substring, tokencount, topk

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_pivot_topk": topk.op3_pivot_topk,
    "op4_repeated_passages": substring.op4_repeated_passages,
    "op5_language": langid.op5_language,
    "op6_secret_scan": secretscan.op6_secret_scan,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_section_tokens": tokencount.op8_section_tokens,
    "op9_feistel_shards": shard.op9_feistel_shards,
    "op10_bbit_minhash": minhash.op10_bbit_minhash,
}

ORACLES = {
    "op1_decontaminate": decontam.ORACLE,
    "op3_pivot_topk": topk.ORACLE,
    "op4_repeated_passages": substring.ORACLE,
    "op6_secret_scan": secretscan.ORACLE,
    "op9_feistel_shards": shard.ORACLE,
    "op10_bbit_minhash": minhash.ORACLE,
}
