"""The queries of this package by name, with SQL where SQL can express them."""

from __future__ import annotations

from . import exact_trie, html_crf, langid, lattice_hash, maxent, media, minhash, mixing, pieces, prefix_trie, quality, resample, warc

QUERIES = {
    "op1_warc_derivatives": warc.op1,
    "op2_hyperminhash_dedup": minhash.op2,
    "op3_crf_main_text": html_crf.op3,
    "op4_sentencepiece": pieces.op4,
    "op5_e8_lattice_dedup": lattice_hash.op5,
    "op6_bayes_quality": quality.op6,
    "op7_maxent_score": maxent.op7,
    "op8_cross_parsing": langid.op8,
    "op10_image_copies": media.op10,
    "op9_systematic_mix": mixing.op9,
    "op11_trie_resample": resample.op11,
    "op12_prefix_owners": prefix_trie.op12,
    "op13_patricia_dedup": exact_trie.op13,
}
SQL = {
    "op1_warc_derivatives": warc.OP1_SQL,
    "op9_systematic_mix": mixing.OP9_SQL,
    "op11_trie_resample": resample.OP11_SQL,
    "op12_prefix_owners": prefix_trie.OP12_SQL,
    "op13_patricia_dedup": exact_trie.OP13_SQL,
}
