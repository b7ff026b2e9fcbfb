"""Query of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.common import table
from tidepanel.llm.minhash import MinHashPlan, near_duplicates

PLAN = MinHashPlan(shingle=2, percent=80)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), PLAN)


def links_sql(shingle: int, percent: int, source: str = "documents") -> str:
    """DuckDB common table expressions that end in ``grouped``: doc_id, n_shingles, component_id."""
    return f"""
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source}),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {shingle - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 2}, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a),
grouped AS (SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id
  FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) m ON m.a = w.doc_id)"""


QUERIES = {"op10_minhash_dedup": op10_minhash_dedup}
SQL = {"op10_minhash_dedup": f"WITH RECURSIVE {links_sql(2, 80)}\nSELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM grouped"}
