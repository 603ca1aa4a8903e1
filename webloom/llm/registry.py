"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from webloom.llm import bpe, centroids, langid, lexical, ngramjoin, packing, pii, quality, secrets, urlfilter, vectors, wrappers

QUERIES = {
    "op1_html": wrappers.op1_html,
    "op2_pii": pii.op2_pii,
    "op3_near_vectors": vectors.op3_near_vectors,
    "op4_langid": langid.op4_langid,
    "op5_jaccard": ngramjoin.op5_jaccard,
    "op6_urls": urlfilter.op6_urls,
    "op7_packing": packing.op7_packing,
    "op8_neighbours": vectors.op8_neighbours,
    "op9_secrets": secrets.op9_secrets,
    "op10_bpe": bpe.op10_bpe,
    "op11_quality": quality.op11_quality,
    "op12_centroids": centroids.op12_centroids,
    "op13_search": lexical.op13_search,
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_vectors": vectors.SQL3,
    "op5_jaccard": ngramjoin.SQL,
    "op6_urls": urlfilter.sql(),
    "op12_centroids": centroids.sql(),
    "op13_search": lexical.SQL,
}
