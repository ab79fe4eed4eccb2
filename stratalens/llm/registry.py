"""The registered queries of this subpackage and their SQL."""

from . import edit_counts, hilbert_shards, language_id, merkle, ngram_join, packing, phrase_index, piece_codec, quality, simhash, spelling, suffix_repeats, warc
from .oracles import ORACLES  # noqa: F401

QUERIES = {
    "op1_hilbert_shards": hilbert_shards.query,
    "op2_ngram_join": ngram_join.query,
    "op3_preference_quality": quality.query,
    "op4_simhash": simhash.query,
    "fingerprint_neighbours": simhash.neighbours_query,
    "op5_edit_counts": edit_counts.query,
    "op6_language_evidence": language_id.query,
    "op7_suffix_repeats": suffix_repeats.query,
    "op8_phrase_index": phrase_index.query,
    "op9_zip_warc": warc.query,
    "op10_cutting_stock": packing.query,
    "op11_piece_backtracking": piece_codec.query,
    "op12_merkle_manifest": merkle.query,
    "op13_spelling_variants": spelling.query,
}
