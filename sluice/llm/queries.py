"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, decontaminate, jaccard, langid, mixing, oracle, repair, secrets, substrings, suffixes, urls, vectors, warc, wrappers

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_extract": wrappers.op2_extract,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_urls": urls.op4_urls,
    "op5_vectors": vectors.op5_vectors,
    "op6_language": langid.op6_language,
    "op7_mixing": mixing.op7_mixing,
    "op8_secrets": secrets.op8_secrets,
    "op9_substrings": substrings.op9_substrings,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_alignment": alignment.op11_alignment,
    "op12_suffixes": suffixes.op12_suffixes,
    "op13_conversations": repair.op13_conversations,
}
SQL = {
    "op3_jaccard": oracle.JACCARD,
    "op5_vectors": oracle.VECTORS,
    "op7_mixing": mixing.SQL,
    "op9_substrings": oracle.SUBSTRINGS,
    "op12_suffixes": oracle.SUFFIXES,
    "op13_conversations": oracle.REPAIR,
}
