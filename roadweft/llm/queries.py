"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from roadweft.llm import jaccard, mixing, quotes, substring
from roadweft.llm.fingerprints import op9_fingerprints
from roadweft.llm.flac_media import op5_media_flac
from roadweft.llm.jaccard import op2_ngram_jaccard_join
from roadweft.llm.language import op10_language_id
from roadweft.llm.mixing import op1_mixing
from roadweft.llm.packing import op3_packing
from roadweft.llm.quality import op4_quality_classifier
from roadweft.llm.quotes import op7_quotation_linking
from roadweft.llm.substring import op6_substring_dedup
from roadweft.llm.token_files import op8_token_output

QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_ngram_jaccard_join, op3_packing, op4_quality_classifier, op5_media_flac, op6_substring_dedup, op7_quotation_linking, op8_token_output, op9_fingerprints, op10_language_id)
} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {"op1_mixing": mixing.ORACLE, "op2_ngram_jaccard_join": jaccard.ORACLE, "op6_substring_dedup": substring.ORACLE, "op7_quotation_linking": quotes.ORACLE} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
