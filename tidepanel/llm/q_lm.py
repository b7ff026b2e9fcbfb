"""Query of language-model scoring, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import table
from tidepanel.llm.lm_scoring import BACKOFF, backoff_scores


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff_scores(table(spark, sf_dir, "documents"), order=2)
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


QUERIES = {"op1_stupid_backoff": op1_stupid_backoff}
SQL = {"op1_stupid_backoff": f"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
spots AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prev FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
size AS (SELECT count(*) AS n FROM spots),
own AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS doc_n,
  count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY doc_id, word) AS c1,
  count(*) OVER (PARTITION BY prev, word) - count(*) OVER (PARTITION BY doc_id, prev, word) AS c2 FROM spots),
ctx AS (SELECT DISTINCT doc_id, word, c1 FROM own),
scored AS (SELECT o.doc_id, CASE WHEN o.prev IS NOT NULL AND o.c2 > 0 THEN ln(o.c2 / greatest(p.c1, 1))
  ELSE ln((o.c1 + 1) / (s.n - o.doc_n + 1)) + CASE WHEN o.prev IS NULL THEN 0 ELSE ln({BACKOFF}) END END AS l
  FROM own o CROSS JOIN size s LEFT JOIN ctx p ON p.doc_id = o.doc_id AND p.word = o.prev),
sums AS (SELECT doc_id, count(*) AS n, sum(l) AS l FROM scored GROUP BY doc_id)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, round(coalesce(s.l, 0.0), 4) AS log_score, round(s.l / s.n, 4) AS mean_log_score
FROM words w LEFT JOIN sums s ON s.doc_id = w.doc_id"""}
