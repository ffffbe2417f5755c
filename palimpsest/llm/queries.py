"""Queries of this package by name, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import op4_embedding_dedup
from .language_id import op5_language_id
from .language_model import op3_language_model
from .media import op9_media
from .mixing import op7_mixing
from .packing import op2_packing
from .quality import op1_quality
from .simhash import op6_simhash
from .token_store import op10_token_store
from .toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_language_model": op3_language_model,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_media": op9_media,
    "op10_token_store": op10_token_store,
}

# Exact cosines of all pairs of a label, and everything that links reach. The query's tables miss a pair at the threshold
# with a chance of 2 %; on tables as small as those that this runs on, in practice none.
SQL: dict[str, str] = {
    "op4_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 usable AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 link AS (SELECT a.vec_id AS one, b.vec_id AS other FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 reach AS (SELECT vec_id, vec_id AS via FROM v UNION SELECT r.vec_id, l.other FROM reach r JOIN link l ON l.one = r.via),
 least AS (SELECT vec_id, min(via) AS component_id FROM reach GROUP BY vec_id),
 n AS (SELECT one, count(*) AS n_links FROM link GROUP BY one)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n ON one = vec_id""",
}
