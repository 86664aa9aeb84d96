"""The dealt operators' queries: opN_<name>, and SQL where it can express them."""

from __future__ import annotations

from . import jaccard, licenses, media, mixing, packing, phrase_dedup, suffix_dedup, toxicity, vector_file, warc

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_warc": warc.op4_warc,
    "op5_media": media.op5_media,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_phrase_dedup": phrase_dedup.op8_phrase_dedup,
    "op9_vector_file": vector_file.op9_vector_file,
    "op10_mixing": mixing.op10_mixing,
}

SQL = {
    "op2_jaccard": jaccard.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op4_warc": warc.SQL,
    "op8_phrase_dedup": phrase_dedup.SQL,
    "op9_vector_file": vector_file.SQL,
    "op10_mixing": mixing.SQL,
}
