"""Query op5: links and components of embeddings of one label at a cosine of 0.98 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .lattice import near_vectors


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT a, min(r) AS component_id FROM reach GROUP BY 1),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(component_id AS BIGINT) AS component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id"""

QUERIES = {"op5_near_vectors": op5_near_vectors}
ORACLE_SQL = {"op5_near_vectors": SQL}
