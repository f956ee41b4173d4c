"""Registered queries of this subpackage and their SQL twins, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.decontaminate import op2_decontamination
from quarrylight.llm import licenses, ngram_join, vectors
from quarrylight.llm.langid import op4_language_id
from quarrylight.llm.packing import op6_best_fit_packing
from quarrylight.llm.quality import op8_quality
from quarrylight.llm.runtime import ship
from quarrylight.llm.simple8b import op3_token_output
from quarrylight.llm.surrogates import op5_pii_surrogates
from quarrylight.llm.toxicity import op1_toxicity


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_token_output": op3_token_output,
    "op4_language_id": op4_language_id,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_quality": op8_quality,
    "op9_embedding_near_dedup": vectors.op9_embedding_near_dedup,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}

SQL: dict[str, str] = {
    "op7_license_scan": licenses.sql_twin(),
    "op9_embedding_near_dedup": vectors.SQL,
    "op10_ngram_join": ngram_join.SQL,
    "op2_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT rid, item_id, places.n, i FROM places JOIN win ON places.n = win.n AND places.phrase = win.phrase),
hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS j FROM occ) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
""",
}
