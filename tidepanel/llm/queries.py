"""The registered queries of the text operators, and the SQL of those that SQL can express.

All modules are imported here, at once, so that an entry point that finds a library missing leaves out the subpackage as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import q_alignment, q_byte_network, q_lm, q_minhash, q_neighbours, q_quality, q_sharding, q_tokens, q_toxicity, q_urls, q_whitening

MODULES = (q_tokens, q_quality, q_sharding, q_minhash, q_toxicity, q_lm, q_urls, q_neighbours, q_alignment, q_whitening, q_byte_network)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: query for m in MODULES for name, query in m.QUERIES.items()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
