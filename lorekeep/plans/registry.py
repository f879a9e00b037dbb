"""Queries by name: a function of the tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import AS_OF, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The derived entities in SQL.
VIEWS = {
    "patterns": f"""SELECT d.doc_id AS id, string_split(text, chr(10))[1] AS problem, text AS solution, lang || '.' || source AS domain,
  [lang, source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END] AS tags,
  (d.doc_id * 37 % 101) / 100.0::DOUBLE AS reward, (d.doc_id * 53 % 97) / 96.0::DOUBLE AS confidence, (d.doc_id * 29 % 89) / 88.0::DOUBLE AS effectiveness,
  d.doc_id * 13 % 40 AS usage_count, d.doc_id * 7 % (d.doc_id * 13 % 40 + 1) AS success_count,
  CASE WHEN d.doc_id * 13 % 40 > 0 THEN (d.doc_id * 7 % (d.doc_id * 13 % 40 + 1)) / (d.doc_id * 13 % 40)::DOUBLE ELSE 0.0::DOUBLE END AS success_rate,
  d.doc_id * 11 % 130 AS reuse_count, coalesce(quality, 1) = 1 AS success, (d.doc_id % 11) / 10.0::DOUBLE AS surprise,
  CASE WHEN d.doc_id % 17 <> 0 THEN 's' || (d.doc_id % 50) END AS session_id, CASE WHEN d.doc_id % 7 <> 0 THEN d.doc_id // 2 END AS parent_id,
  (d.doc_id * 17 % 400)::INT AS created_days, (d.doc_id * 5 % 200)::INT AS updated_days,
  TIMESTAMP '{AS_OF}' - to_days((d.doc_id * 17 % 400)::INT) AS created_at, TIMESTAMP '{AS_OF}' - to_days((d.doc_id * 5 % 200)::INT) AS updated_at,
  d.doc_id % 23 = 0 AS archived, CASE WHEN d.doc_id % 19 <> 0 THEN ['reflex', 'crystal', 'booster'][(d.doc_id % 3 + 1)::INT] END AS tier,
  md5(string_split(text, chr(10))[1] || chr(10) || text) AS content_hash, n_chars, quality, toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "outcomes": """SELECT event_id, ts, user_id, event_type, value, props,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'partial' ELSE 'neutral' END AS outcome,
  event_id % 97 AS pattern_id, 'u' || (user_id % 40) AS session_id FROM events""",
    "predictions": """SELECT d.doc_id AS id, lang AS domain, ((d.doc_id * 31 + n_chars) % 1000) / 1000.0::DOUBLE AS probability, (d.doc_id * 17 % 101) / 100.0::DOUBLE AS confidence,
  CASE WHEN quality IS NULL THEN CASE WHEN d.doc_id % 9 = 0 THEN 'expired' ELSE 'pending' END ELSE 'resolved' END AS status, quality = 1 AS outcome,
  d.doc_id * 3 % 20 + 1 AS min_days, d.doc_id * 3 % 20 + 1 + d.doc_id % 45 AS max_days, d.doc_id * 7 % 60 + 1 AS resolution_days, d.doc_id * 5 % 90 AS age_days, d.doc_id % 6 AS n_evidence
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "edges": """SELECT src, dst, CASE (src + dst) % 3 WHEN 0 THEN 'similar' WHEN 1 THEN 'depends' ELSE 'refines' END AS kind, n / (n + 2.0::DOUBLE) AS strength,
  (src * 7 + dst) % 180 AS age_days, (src + dst) % 2 = 0 AS auto_created
FROM (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY ALL) WHERE src <> dst""",
    "vectors": "SELECT vec_id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings",
}


def with_views(sql: str) -> str:
    """The statement with the derived entities that it names as leading common tables."""
    sql = sql.replace("count_if(", "count(1) FILTER (WHERE ")  # counts as BIGINT
    used = [k for k in VIEWS if re.search(rf"\b{k}\b", sql)]
    if not used:
        return sql
    views = ", ".join(f"{k} AS ({VIEWS[k]})" for k in used)
    sql = sql.strip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(lead):
            return f"{lead}{views}, {sql[len(lead) :]}"
    return f"WITH {views} {sql}"


def reachable(spark: SparkSession) -> SparkSession:
    """Python workers find this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name."""

    def put(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(reachable(spark), sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return put
