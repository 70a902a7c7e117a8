"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from windlake.llm import bpe, divergence, exact_dedup, filter_audit, gif, near_dedup, ngram_join, packing, passage_dedup, secret_scan, sharding, token_rollup, toxicity

MODULES = [sharding, passage_dedup, exact_dedup, packing, secret_scan, toxicity, gif, near_dedup, token_rollup, bpe, ngram_join, divergence, filter_audit]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
