"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from sonoframe.llm import collocation, extraction, fertility, fingerprint, lines, mixing, neardup, packing, repair, sharding, toxicity, urls, viterbi

QUERIES = {
    "op1_fertility": fertility.op1_fertility,
    "op2_merkle": fingerprint.op2_merkle,
    "op3_minimum_cut": extraction.op3_minimum_cut,
    "op4_segment_join": lines.op4_segment_join,
    "op5_rendezvous": sharding.op5_rendezvous,
    "op6_temperature": mixing.op6_temperature,
    "op7_pattern_grammar": toxicity.op7_pattern_grammar,
    "op8_bounded_space": packing.op8_bounded_space,
    "op9_weighted_sampling": neardup.op9_weighted_sampling,
    "op10_count_viterbi": viterbi.op10_count_viterbi,
    "op11_collocations": collocation.op11_collocations,
    "op12_earley": repair.op12_earley,
    "op13_digest_array": urls.op13_digest_array,
}
ORACLES = {"op5_rendezvous": sharding.ORACLE_SQL, "op11_collocations": collocation.ORACLE_SQL, "op12_earley": repair.ORACLE_SQL, "op13_digest_array": urls.ORACLE_SQL}
