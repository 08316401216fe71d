"""All queries and oracles outside the llm subpackage."""

from __future__ import annotations

from sealwork.plans import evidence, problems


def queries() -> dict:
    return evidence.QUERIES | problems.QUERIES


def oracle_sql() -> dict:
    return evidence.ORACLES | problems.ORACLES
