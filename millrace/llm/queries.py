"""The subpackage's queries by name, with DuckDB SQL where it can express them."""

from __future__ import annotations

from millrace.llm import decision_list, drr_packing, feistel_shards, line_blocks, line_spread, oph_minhash, suffix_decontam, token_files, url_reputation, warc_fixity

QUERIES = {
    "op1_url_reputation": url_reputation.op1_url_reputation,
    "op2_feistel_shards": feistel_shards.op2_feistel_shards,
    "op3_merkle_fixity": warc_fixity.op3_merkle_fixity,
    "op4_decision_list": decision_list.op4_decision_list,
    "op5_line_blocks": line_blocks.op5_line_blocks,
    "op6_oph_minhash": oph_minhash.op6_oph_minhash,
    "op7_suffix_decontam": suffix_decontam.op7_suffix_decontam,
    "op8_token_files": token_files.op8_token_files,
    "op9_drr_packing": drr_packing.op9_drr_packing,
    "op10_line_spread": line_spread.op10_line_spread,
}

ORACLES = {
    "op1_url_reputation": url_reputation.ORACLE_SQL,
    "op2_feistel_shards": feistel_shards.ORACLE_SQL,
    "op3_merkle_fixity": warc_fixity.ORACLE_SQL,
    "op5_line_blocks": line_blocks.ORACLE_SQL,
    "op6_oph_minhash": oph_minhash.ORACLE_SQL,
    "op7_suffix_decontam": suffix_decontam.ORACLE_SQL,
    "op10_line_spread": line_spread.ORACLE_SQL,
}
