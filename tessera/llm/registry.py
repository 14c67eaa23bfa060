"""The subpackage's queries and their SQL."""

from __future__ import annotations

from tessera.llm import chat, decontaminate, fingerprint, near_dup, packing, pii, secrets, shuffle, token_store, toxicity

_MODULES = (secrets, pii, toxicity, chat, near_dup, token_store, shuffle, fingerprint, packing, decontaminate)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
