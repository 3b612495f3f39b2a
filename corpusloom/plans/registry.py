"""Registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from corpusloom.plans import corpus_files, oracle, queries

QUERIES = queries.QUERIES | corpus_files.QUERIES
ORACLE = oracle.ORACLE | corpus_files.oracle(oracle.LINES, oracle.LINE_COUNT)

__all__ = ["ORACLE", "QUERIES"]
