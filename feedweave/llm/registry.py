"""Queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from feedweave.llm import centroid_clusters, embedding_dedup, lexical_search, minhash_dedup, topk_search, warc_revisits
from feedweave.llm.language_id import op10_language_id
from feedweave.llm.license_scan import op6_license_scan
from feedweave.llm.packing import op5_packing
from feedweave.llm.piece_encoding import op3_piece_encoding
from feedweave.llm.ppm_score import op1_ppm_score
from feedweave.llm.token_counts import op11_token_counts
from feedweave.llm.toxicity import op4_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_ppm_score, warc_revisits.op2_warc_revisits, op3_piece_encoding, op4_toxicity, op5_packing,
        op6_license_scan, embedding_dedup.op7_embedding_near_dedup, minhash_dedup.op8_minhash_near_dedup, topk_search.op9_exact_top_k, op10_language_id,
        op11_token_counts, centroid_clusters.op12_centroid_clusters, lexical_search.op13_lexical_search,
    )
}
# Models and token ids are beyond SQL: those operators are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisits": warc_revisits.ORACLE, "op7_embedding_near_dedup": embedding_dedup.ORACLE, "op8_minhash_near_dedup": minhash_dedup.ORACLE,
    "op9_exact_top_k": topk_search.ORACLE, "op12_centroid_clusters": centroid_clusters.ORACLE, "op13_lexical_search": lexical_search.ORACLE,
}
