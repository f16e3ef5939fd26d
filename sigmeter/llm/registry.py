"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import collocations, exact_dedup, jaccard_join, language, lexical, licences, neighbours, packing, pieces, pii, quality, topk, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_quality": quality.op2_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_pii": pii.op4_pii,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_topk": topk.op6_topk,
    "op7_packing": packing.op7_packing,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_licences": licences.op9_licences,
    "op10_language": language.op10_language,
    "op11_lexical": lexical.op11_lexical,
    "op12_collocations": collocations.op12_collocations,
    "op13_neighbours": neighbours.op13_neighbours,
}

ORACLE = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op6_topk": topk.OP6_SQL,
    "op11_lexical": lexical.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
