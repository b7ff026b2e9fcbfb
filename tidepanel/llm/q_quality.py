"""Query of the quality rules, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.common import table
from tidepanel.llm.quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, TAIL, quality_report


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def rules_sql() -> str:
    """The threshold table as a DuckDB condition."""
    parts = []
    for r in RULES:
        bounds = [f"1000 * {r.top} >= {r.least} * {r.bottom}" if r.least is not None else "", f"1000 * {r.top} <= {r.most} * {r.bottom}" if r.most is not None else ""]
        parts.append(f"({r.bottom} = 0 OR ({' AND '.join(b for b in bounds if b)}))")
    return " AND ".join(parts)


def counts_sql(source: str, key: str = "doc_id") -> str:
    """DuckDB common table expressions that end in ``judged``: the counts and decisions for ``source``."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
texts AS (SELECT {key}, coalesce(text, '') AS t FROM {source}),
split_words AS (SELECT {key}, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
spots AS (SELECT {key}, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT {key}, w, unnest(range(1, len(w) - 1)) AS i FROM split_words WHERE len(w) >= 3)),
repeated AS (SELECT {key}, i FROM (SELECT {key}, i, count(*) OVER (PARTITION BY {key}, g) AS c FROM spots) WHERE c >= 2),
covered AS (SELECT {key}, count(*) AS n FROM (SELECT DISTINCT {key}, i + unnest([0, 1, 2]) AS j FROM repeated) GROUP BY {key}),
counted AS (SELECT s.{key}, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: lower(rtrim(x, '{TAIL}')) IN ({stop})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines
  FROM split_words s LEFT JOIN covered c ON s.{key} = c.{key}),
failed AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM counted),
judged AS (SELECT *, (NOT base_failed AND {rules_sql()}) AS kept FROM failed)"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL = {"op9_quality_rules": f"WITH {counts_sql('documents')}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed, kept FROM judged"}
