"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quarry.llm import bloomlm, chains, cotraining, decontaminate, maxscore, mixing, pii, rans, simhash, suffix

_MODULES = (decontaminate, simhash, mixing, pii, rans, suffix, cotraining, bloomlm, chains, maxscore)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.SQL.items()}
