"""Queries of this subpackage for ``__spark_entry__.py``, and the SQL of those that SQL can express."""

from __future__ import annotations

from rootgraph.llm import decontaminate, embeddings, importance, language, lines, minhash, packing, privacy, sharding, suffixes, syncmers, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_dart_minhash": minhash.op2_dart_minhash,
    "op3_simhash_lines": lines.op3_simhash_lines,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_language_id": language.op6_language_id,
    "op7_sanitise": privacy.op7_sanitise,
    "op8_minimax_shards": sharding.op8_minimax_shards,
    "op9_inverted_multi_index": embeddings.op9_inverted_multi_index,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_closed_syncmers": syncmers.op11_closed_syncmers,
    "op12_importance": importance.op12_importance,
}

ORACLE_SQL = {
    "op1_warc": warc.ORACLE,
    "op5_suffix_dedup": suffixes.ORACLE,
    "op9_inverted_multi_index": embeddings.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op12_importance": importance.ORACLE,
}
